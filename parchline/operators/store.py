"""The relational tier over DataFrames: versioned tables, filters, pages, upserts, state transitions, statistics.

Tables are append-only parquet with a ``version`` column; the current state is the latest version of
every key. Nothing overwrites a path that is being read.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ("pending", "processing", "completed", "failed", "skipped")


class Table:
    """Versioned rows of one key column under a path."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def append(self, rows: DataFrame, version: int, deleted: bool = False) -> None:
        rows.withColumns({"version": F.lit(version), "deleted": F.lit(deleted)}).write.mode("append").parquet(self.path)

    def current(self) -> DataFrame:
        """Latest version of each key, tombstones left out: one aggregation with partial maxima."""
        rows = self.spark.read.parquet(self.path)
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), "version").alias("r"))
        return last.select("r.*").where("NOT deleted").drop("version", "deleted")

    def delete(self, keys: DataFrame, version: int) -> None:
        self.append(self.current().join(keys, self.key, "left_semi"), version, deleted=True)

    def update(self, keys: DataFrame, changes: dict, version: int) -> DataFrame:
        rows = self.current().join(keys, self.key, "left_semi").withColumns({k: F.lit(v) for k, v in changes.items()})
        self.append(rows, version)
        return rows


def page(df: DataFrame, order_by: str, skip: int = 0, limit: int = 100, descending: bool = True, tie: str | None = None) -> DataFrame:
    """Sorted page; the planner takes the top rows only."""
    keys = [F.col(order_by).desc() if descending else F.col(order_by)] + ([F.col(tie)] if tie else [])
    return df.orderBy(*keys).offset(skip).limit(limit)


def by_field(df: DataFrame, field: str, value) -> DataFrame:
    if field not in df.columns:
        raise ValueError(f"no column {field}")
    return df.where(F.col(field) == value)


def filter_by(df: DataFrame, conditions: dict) -> DataFrame:
    """All conditions; unknown columns are passed over."""
    tests = [F.col(k) == v for k, v in conditions.items() if k in df.columns]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def exists(df: DataFrame, field: str, value) -> bool:
    return not by_field(df, field, value).limit(1).isEmpty()


def count(df: DataFrame, conditions: dict | None = None) -> DataFrame:
    return filter_by(df, conditions or {}).agg(F.count(F.lit(1)).alias("n"))


def by_status(resumes: DataFrame, status: str, skip: int = 0, limit: int = 100) -> DataFrame:
    return page(resumes.where(F.col("status") == status), "uploaded_at", skip, limit, True, "resume_id")


def failed_for_retry(resumes: DataFrame, max_retries: int = 3) -> DataFrame:
    return resumes.where((F.col("status") == "failed") & (F.col("retry_count") < max_retries)).orderBy("uploaded_at", "resume_id")


def current_status(log: DataFrame) -> DataFrame:
    """State from an event log (resume_id, status, ts): latest status and how often it failed."""
    return log.groupBy("resume_id").agg(F.max_by("status", "ts").alias("status"), F.sum((F.col("status") == "failed").cast("bigint")).alias("retry_count"))


def with_candidates(resumes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Left outer join; the planner picks broadcast or sort-merge by size."""
    return resumes.join(candidates, "candidate_id", "left")


def statistics(resumes: DataFrame) -> DataFrame:
    return resumes.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 3).alias("avg_confidence"), F.round(F.avg("seconds"), 2).alias("avg_seconds"))


def totals(resumes: DataFrame) -> DataFrame:
    """Counts of every state and averages of completed rows, in one pass."""
    done = F.col("status") == "completed"
    return resumes.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "pending")],
        F.round(F.avg(F.when(done, F.col("confidence"))), 3).alias("avg_confidence"),
    )


def search_by_name(candidates: DataFrame, name: str, limit: int = 20) -> DataFrame:
    return candidates.where(F.col("full_name").ilike(f"%{name}%")).orderBy("full_name", "candidate_id").limit(limit)


def with_all_skills(candidates: DataFrame, skills: list[str], limit: int = 50) -> DataFrame:
    wanted = F.array(*[F.lit(s) for s in skills])
    return candidates.where(F.size(F.array_except(wanted, "skills_normalized")) == 0).orderBy("candidate_id").limit(limit)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """New values over old ones where they aren't null; of several new rows of a key the latest counts."""
    fresh = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), order).alias("n"))
    both = old.join(fresh, key, "full_outer")
    names = [c for c in old.columns if c != key]
    return both.select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in names])


def new_documents(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming files whose digest isn't known, one of each digest."""
    return incoming.dropDuplicates(["content_md5"]).join(known.select("content_md5").distinct(), "content_md5", "left_anti")


def candidate_rows(records: DataFrame) -> DataFrame:
    """Records as candidate rows: naive sum of durations, current else first job, first degree, all skills."""
    r = F.col("record")
    current = F.coalesce(F.get(F.filter(r["experience"], lambda j: j["is_current"]), F.lit(0)), F.get(r["experience"], F.lit(0)))
    return records.select(
        "doc_id",
        r["contact"]["full_name"].alias("full_name"),
        r["contact"]["email"].alias("email"),
        r["contact"]["phone"].alias("phone"),
        F.aggregate(r["experience"], F.lit(0.0), lambda s, j: s + F.coalesce(j["duration_years"], F.lit(0.0))).alias("experience_years_sum"),
        current["job_title"].alias("current_title"),
        current["company"].alias("current_company"),
        F.get(r["education"], F.lit(0))["degree"].alias("degree"),
        r["skills"]["all"].alias("skills_normalized"),
        (r["contact"]["full_name"].isNotNull() & r["contact"]["email"].isNotNull() & (F.size(r["experience"]) > 0) & (F.size(r["skills"]["all"]) > 0)).alias("has_complete_profile"),
    )


def normalized_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The nine relations of one record set: two wide ones, seven normalised children."""
    def child(name: str) -> DataFrame:
        return records.select("doc_id", F.posexplode(f"record.{name}").alias("pos", "e")).select("doc_id", "pos", "e.*")

    skills = records.select("doc_id", F.posexplode("record.skills.all").alias("pos", "skill"))
    return {
        "extractions": records.select("doc_id", F.to_json("record").alias("data")),
        "candidates": candidate_rows(records),
        "contacts": records.select("doc_id", "record.contact.*"),
        "experience": child("experience"),
        "education": child("education"),
        "skills": skills,
        "certifications": child("certifications"),
        "projects": child("projects"),
        "languages": child("languages"),
    }


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. Where the session names none, a local master gets one of its own; a cluster fails."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        found = tempfile.mkdtemp(prefix="parchline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/parchline/{name}-{uuid.uuid4().hex}"


def stored_path(df: DataFrame, name: str) -> str:
    """``df`` written to a new folder of the shared directory."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: heavy rows are made once, however many readers follow."""
    return df.sparkSession.read.schema(df.schema).parquet(stored_path(df, name))


def write_all(tables: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Every table to its own folder in place of what was there, independently: one failure doesn't stop the others. Returns errors by table."""
    errors = {}
    for name, df in tables.items():
        try:
            df.write.mode("overwrite").parquet(f"{root}/{name}")
        except Exception as error:  # noqa: BLE001
            errors[name] = str(error)
    return errors


def list_page(resumes: DataFrame, order_by: str, number: int, size: int, tie: str) -> DataFrame:
    """Page ``number`` (from 1), newest first, each row with the total and whether pages follow; the total comes from one row that is broadcast."""
    whole = resumes.agg(F.count(F.lit(1)).alias("total"))
    rows = page(resumes, order_by, (number - 1) * size, size, True, tie)
    total = whole.first()["total"]
    return rows.withColumns({"total": F.lit(total).cast("bigint"), "has_next": F.lit(number * size < total)})


def by_email(candidates: DataFrame, email: str) -> DataFrame:
    return candidates.where(F.lower(F.trim("email")) == email.strip().lower())


def uploaded_between(rows: DataFrame, day: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows of the days from ``first`` to ``last``, both included; those whose day can't be read stay."""
    d = F.try_to_timestamp(F.col(day).cast("string")).cast("date")
    inside = F.lit(True)
    if first:
        inside = inside & (d >= F.lit(first).cast("date"))
    if last:
        inside = inside & (d <= F.lit(last).cast("date"))
    return rows.where(d.isNull() | inside)


def with_properties(resumes: DataFrame) -> DataFrame:
    """Derived columns of a résumé row: state flags, size in KB, a name to show."""
    return resumes.withColumns(
        {
            "is_processed": F.col("status") == "completed",
            "is_failed": F.col("status") == "failed",
            "size_kb": F.round(F.col("file_size") / 1024, 2),
            "display_name": F.coalesce("original_filename", "stored_filename"),
        }
    )


def load_results(rows: DataFrame, schema, ids: DataFrame | None = None, status: str = "completed") -> DataFrame:
    """``rows`` with the record of their JSON ``data``: those of ``ids``, else those of a status; what isn't JSON is passed over."""
    chosen = rows.join(ids, ids.columns[0], "left_semi") if ids is not None else rows.where(F.col("status") == status)
    whole = chosen.where(F.try_parse_json("data").isNotNull())
    return whole.withColumn("record", F.from_json("data", schema, {"mode": "PERMISSIVE"})).where("record IS NOT NULL").drop("data")


class Log:
    """Append-only log of stages: resume_id, stage, success, seconds, started_at."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def by_resume(self, resume_id) -> DataFrame:
        return self.rows().where(F.col("resume_id") == resume_id).orderBy("started_at")

    def failed(self, resume_id) -> DataFrame:
        return self.by_resume(resume_id).where("NOT success")

    def statistics(self) -> DataFrame:
        return self.rows().groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("failed"), F.round(F.avg("seconds"), 3).alias("avg_seconds"))

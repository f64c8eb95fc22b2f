"""Export projections and writers: flat rows, modes, workbook sheets, skills matrix, audit lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dims import EXPORT_COLUMNS

# Export modes, and what the names of numeric columns hold.
NUMERIC = ("years", "confidence", "gpa")
MODES = ("summary", "experience", "education", "full")


def _joined(c: Column) -> Column:
    return F.array_join(c, ", ")


def flat(records: DataFrame) -> DataFrame:
    """The 22 flat fields of a record: first job and degree, joined lists."""
    r = F.col("record")
    job, degree = F.get(r["experience"], F.lit(0)), F.get(r["education"], F.lit(0))
    fields = {
        **{k: r["contact"][k] for k in ("full_name", "email", "phone", "linkedin", "github", "city", "country")},
        "summary": r["summary"],
        "total_experience_years": r["total_experience_years"],
        "latest_job_title": job["job_title"],
        "latest_company": job["company"],
        "latest_start_date": job["start_date"],
        "latest_end_date": job["end_date"],
        "highest_degree": degree["degree"],
        "field_of_study": degree["field_of_study"],
        "institution": degree["institution"],
        "graduation_date": degree["graduation_date"],
        "all_skills": _joined(r["skills"]["all"]),
        "technical_skills": _joined(r["skills"]["technical"]),
        "certifications": _joined(F.transform(r["certifications"], lambda c: c["name"])),
        "spoken_languages": _joined(F.transform(r["languages"], lambda x: x["language"])),
        "overall_confidence": F.col("confidence.overall") if "confidence" in records.columns else F.lit(None).cast("double"),
    }
    return records.select("doc_id", *[v.alias(k) for k, v in fields.items()])


def formatted(c: Column, kind: str) -> Column:
    """Cell text: Yes/No, one decimal, or the text; empty for null."""
    if kind == "boolean":
        out = F.when(c, "Yes").otherwise("No")
    elif kind in ("double", "float"):
        out = F.format_string("%.1f", F.round(c, 1))
    else:
        out = c.cast("string")
    return F.coalesce(F.when(c.isNull(), F.lit("")).otherwise(out), F.lit(""))


def mapped(flat_rows: DataFrame, mapping: dict[str, tuple[str, int]] = EXPORT_COLUMNS) -> DataFrame:
    """Projection to export headers by a field-to-header mapping."""
    kinds = dict(flat_rows.dtypes)
    return flat_rows.select(*[formatted(F.col(f), kinds[f]).alias(h) for f, (h, _) in mapping.items()])


def exploded(records: DataFrame, part: str) -> DataFrame:
    """One row for each job or degree with contact fields beside it; a contact-only row where there is none."""
    base = records.select("doc_id", F.col("record.contact.full_name").alias("full_name"), F.col("record.contact.email").alias("email"), F.posexplode_outer(f"record.{part}").alias("pos", "e"))
    return base.select("doc_id", "full_name", "email", "pos", "e.*")


def full(records: DataFrame) -> DataFrame:
    """Flat fields and the nested lists as JSON."""
    nested = records.select(F.col("doc_id").alias("id"), *[F.to_json(f"record.{p}").alias(f"{p}_json") for p in ("experience", "education", "certifications", "projects")])
    return flat(records).join(nested, F.col("doc_id").eqNullSafe(F.col("id"))).drop("id")


def export_csv(records: DataFrame, path: str, mode: str = "summary") -> None:
    """CSV folder of one mode; quotes only where needed. The table stays distributed."""
    if mode not in MODES:
        raise ValueError(f"mode {mode}: one of {MODES}")
    rows = {"summary": lambda: mapped(flat(records)), "experience": lambda: _text_only(exploded(records, "experience")), "education": lambda: _text_only(exploded(records, "education")), "full": lambda: full(records)}[mode]()
    rows.write.option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)


def _text_only(df: DataFrame) -> DataFrame:
    return df.select(*[_joined(F.col(c)).alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes])


def coerced(df: DataFrame) -> DataFrame:
    """Columns named after years, confidence or a grade as numbers; what isn't one becomes null. Dates stay text."""
    numeric = [c for c in df.columns if any(k in c.lower() for k in NUMERIC)]
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in numeric})


def skills_matrix(skills: DataFrame, key: str = "person_id", skill: str = "skill", columns: list[str] | None = None) -> DataFrame:
    """Pivot of persons by skills with a check mark; give ``columns`` to spare the pass that finds them."""
    wide = skills.groupBy(key).pivot(skill, columns) if columns else skills.groupBy(key).pivot(skill)
    return wide.agg(F.first(F.lit("✓")))


def overview(records: DataFrame) -> DataFrame:
    """Statistics sheet: total, shares of filled fields and averages, in one pass, then one row for each."""
    r = F.col("record")
    flags = {"with_email": r["contact"]["email"].isNotNull(), "with_phone": r["contact"]["phone"].isNotNull(), "with_experience": F.size(r["experience"]) > 0, "with_education": F.size(r["education"]) > 0, "with_skills": F.size(r["skills"]["all"]) > 0}
    one = records.agg(
        F.count(F.lit(1)).cast("double").alias("total"),
        *[F.count_if(v).cast("double").alias(k) for k, v in flags.items()],
        F.round(F.avg(F.size(r["skills"]["all"])), 1).alias("avg_skills"),
        F.round(F.avg(F.size(r["experience"])), 1).alias("avg_jobs"),
    )
    return one.unpivot([], one.columns, "metric", "value")


def sheets(records: DataFrame) -> dict[str, DataFrame]:
    """The workbook's relations, with bands for striping and confidence colours."""
    flat_rows = flat(records)
    band = F.when(F.col("overall_confidence") >= 0.85, "high").when(F.col("overall_confidence") >= 0.6, "medium").otherwise("low")
    return {
        "Summary": flat_rows.withColumn("confidence_band", band),
        "Experience": exploded(records, "experience"),
        "Education": exploded(records, "education"),
        "Skills Matrix": skills_matrix(records.select(F.col("doc_id").alias("person_id"), F.explode("record.skills.all").alias("skill"))),
        "Statistics": overview(records),
    }


def export_workbook(records: DataFrame, path: str) -> None:
    """An xlsx file where an Excel library is installed; the sheets pass through the driver, so this is for reports."""
    import pandas as pd

    with pd.ExcelWriter(path) as book:
        for name, df in sheets(records).items():
            df.toPandas().to_excel(book, sheet_name=name, index=False)


def audit(df: DataFrame, path: str, event: str) -> None:
    """Append JSON lines of an event."""
    df.withColumns({"event": F.lit(event), "at": F.current_timestamp()}).write.mode("append").json(path)

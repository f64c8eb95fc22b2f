"""Optional repairs of assembled records, and the record-level validation with its warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import CERT_URLS
from ..functions import regexes as R
from ..functions import text as T
from ..functions import validate as V
from ..functions.dates import let, parse_date, parse_range
from .match import _map, quick_normalize


def repair_date(c: Column) -> Column:
    out = F.regexp_replace(c, r"\b(\d{1,2})[/\-.](\d{4})\b", "$1/$2")
    return F.regexp_replace(out, r"(?i)\b(?:presant|present|current|till date|till now)\b", "Present")


def repair_phone(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[^\d+\-()\s]", ""))


def split_skills(xs: Column) -> Column:
    """Compound entries apart, ordered distinct."""
    parts = F.flatten(F.transform(xs, lambda x: F.split(x, r"[,;/|•·]")))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def cert_url(name: Column) -> Column:
    """Page of a certificate: exact name, else the first known name inside it or around it."""
    low = F.lower(F.trim(name))
    near = F.get(F.filter(F.array(*[F.lit(k) for k in CERT_URLS]), lambda k: (F.length(low) > 2) & (F.contains(low, k) | F.contains(k, low))), F.lit(0))
    return F.coalesce(F.try_element_at(_map(CERT_URLS), low), F.try_element_at(_map(CERT_URLS), near))


def recovered_summary(text: Column) -> Column:
    """Summary paragraph behind its heading, 50 to 600 characters."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, r"(?is)(?:summary|objective|profile|about me)\s*[:\n]\s*(.{50,600}?)(?:\n\s*\n|$)", 1), r"\s+", " ")), F.lit(""))


def headerless_jobs(lines: Column) -> Column:
    """Lines with a title word that have a date range between the line before and two lines after."""
    near = lambda i: F.array_join(F.slice(lines, F.greatest(F.lit(1), i), F.lit(4)), " ")
    return F.filter(lines, lambda x, i: x.rlike(R.TITLE_WORD) & ~x.rlike(R.BULLET_POINT) & near(i).rlike(R.DATE_RANGE))


def recovered_jobs(text: Column, as_of: str) -> Column:
    """Jobs of the lines that ``headerless_jobs`` finds: the line as title, the date range near it."""
    lines = F.split(text, "\n")

    def job(x: Column, i: Column) -> Column:
        near = F.array_join(F.slice(lines, F.greatest(F.lit(1), F.array_position(lines, x)).cast("int"), F.lit(4)), " ")
        return let(
            parse_range(near, as_of),
            lambda span: F.struct(
                T.clean_line(F.regexp_replace(x, R.DATE_RANGE, "")).alias("job_title"),
                F.lit(None).cast("string").alias("company"),
                F.lit(None).cast("string").alias("location"),
                span["start_date"].alias("start_date"),
                span["end_date"].alias("end_date"),
                span["duration_years"].alias("duration_years"),
                F.coalesce(span["is_current"], F.lit(False)).alias("is_current"),
                F.lit(None).cast("string").alias("description"),
                F.array().cast("array<string>").alias("responsibilities"),
            ),
        )

    return F.transform(headerless_jobs(lines), job)


def enhance(df: DataFrame, as_of: str, record: str = "record", text: str = "text") -> DataFrame:
    """``record`` with repairs and a report of what changed; ``df`` has the text beside it.

    Records without jobs get those of headerless lines. Compound skills are taken apart; unknown ones that are like a known one go
    by its name.
    """
    r = F.col(record)
    before = F.size(r["skills"]["all"])
    skills = quick_normalize(split_skills(r["skills"]["all"]), keep_unknown=True)
    certs = F.transform(r["certifications"], lambda c: c.withField("url", cert_url(c["name"])))
    found = F.when(F.size(r["experience"]) > 0, r["experience"]).otherwise(recovered_jobs(F.col(text), as_of))
    jobs = F.transform(
        found,
        lambda j: j.withField("start_date", repair_date(j["start_date"])).withField("end_date", repair_date(j["end_date"])).withField("job_title", T.clean_line(j["job_title"])),
    )
    out = (
        r.withField("summary", F.coalesce(r["summary"], recovered_summary(F.col(text))))
        .withField("contact", r["contact"].withField("phone", repair_phone(r["contact"]["phone"])).withField("email", F.lower(r["contact"]["email"])))
        .withField("skills", r["skills"].withField("all", skills))
        .withField("certifications", certs)
        .withField("experience", jobs)
    )
    report = F.struct(
        (r["summary"].isNull() & recovered_summary(F.col(text)).isNotNull()).cast("int").alias("sections_recovered"),
        (F.size(skills) - before).alias("skills_added"),
        F.size(F.filter(certs, lambda c: c["url"].isNotNull())).alias("urls_mapped"),
        (F.size(jobs) - F.size(r["experience"])).alias("jobs_recovered"),
    )
    return df.withColumns({record: out, "enhancement": report})


def validate_record(df: DataFrame, as_of: str, record: str = "record") -> DataFrame:
    """Invalid fields become null, empty entries go, reversed dates swap; ``warnings`` lists why."""
    r = F.col(record)
    checks = {"email": V.email(r["contact"]["email"]), "phone": V.phone(r["contact"]["phone"]), "linkedin": V.linkedin(r["contact"]["linkedin"]), "full_name": V.name(r["contact"]["full_name"]), "website": V.url(r["contact"]["website"])}
    contact_warnings = F.array(
        *[F.when(r["contact"][k].isNotNull() & ~v["valid"], F.concat(F.lit(f"contact.{k}: "), v["reason"])) for k, v in checks.items()]
    )

    def dated(j: Column) -> Column:
        span = F.struct(parse_date(j["start_date"], as_of).alias("a"), parse_date(j["end_date"], as_of).alias("b"))
        return F.struct(j.alias("j"), let(span, lambda p: F.coalesce(p["a"] > p["b"], F.lit(False))).alias("wrong"))

    def job(x: Column) -> Column:
        j = x["j"]
        return (
            j.withField("start_date", F.when(x["wrong"], j["end_date"]).otherwise(j["start_date"]))
            .withField("end_date", F.when(x["wrong"], j["start_date"]).otherwise(j["end_date"]))
            .withField("duration_years", F.when(j["duration_years"].between(0, 60), j["duration_years"]))
        )

    df = df.withColumn("parchline__jobs", F.transform(r["experience"], dated))
    checked = F.col("parchline__jobs")
    jobs = F.filter(F.transform(checked, job), lambda j: j["job_title"].isNotNull() | j["company"].isNotNull())
    job_warnings = F.transform(checked, lambda x, i: F.when(x["wrong"], F.concat(F.lit("experience["), i.cast("string"), F.lit("]: start after end"))))
    degrees = F.transform(r["education"], lambda e: e.withField("gpa", V.gpa(e["gpa"])["value"]))
    skills = F.filter(r["skills"]["all"], lambda s: V.skill(s)["valid"])
    length = F.length(r["summary"])
    other = F.array(
        F.when(length < 20, "summary: too short"),
        F.when(length > 2000, "summary: too long"),
        F.when(r["contact"]["email"].isNull() & r["contact"]["phone"].isNull(), "contact: no way to reach"),
        F.when((F.size(r["experience"]) == 0) & (F.size(r["education"]) == 0), "record: neither experience nor education"),
        F.when(r["total_experience_years"] > 60, "experience: over 60 years"),
    )
    contact = r["contact"]  # nested paths in withField would write the whole record twice for each field
    for k, v in checks.items():
        contact = contact.withField(k, v["value"])
    out = r.withField("contact", contact).withField("experience", jobs).withField("education", degrees)
    out = out.withField("skills", r["skills"].withField("all", skills)).withField("summary", F.left(r["summary"], F.lit(2000)))
    return df.withColumns({record: out, "warnings": F.array_compact(F.concat(contact_warnings, job_warnings, other))}).drop("parchline__jobs")

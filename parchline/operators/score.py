"""Confidence and completeness of assembled records, as arithmetic over nested columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .record import contact_confidence

# Weights of sections, fields and checks; levels.
SECTION_WEIGHTS = {"contact": 0.28, "experience": 0.25, "education": 0.18, "skills": 0.15, "summary": 0.06, "certifications": 0.04, "projects": 0.04}
CONTACT_WEIGHTS = {"full_name": 0.30, "email": 0.25, "phone": 0.20, "linkedin": 0.10, "city": 0.08, "country": 0.07}
EXPERIENCE_WEIGHTS = {"job_title": 0.35, "company": 0.30, "start_date": 0.15, "end_date": 0.10, "description": 0.10}
EDUCATION_WEIGHTS = {"degree": 0.35, "institution": 0.35, "graduation_date": 0.20, "field_of_study": 0.10}
CERTIFICATION_WEIGHTS = {"name": 0.50, "issuer": 0.30, "date": 0.20}
COMPLETENESS = {"name": 0.20, "email": 0.15, "experience": 0.20, "education": 0.15, "skills": 0.15, "phone": 0.05, "summary": 0.05, "certifications": 0.02, "linkedin": 0.02, "location": 0.01}
EARLY_WEIGHTS = {"contact": 0.30, "experience": 0.25, "education": 0.20, "skills": 0.15, "summary": 0.05, "certifications": 0.05}
HIGH, MEDIUM = 0.85, 0.60


def has(e: str) -> str:
    return f"coalesce({e} <> '', false)"


def some(e: str) -> str:
    return f"coalesce(size({e}) > 0, false)"


def level(score: str) -> str:
    return f"CASE WHEN {score} >= {HIGH} THEN 'high' WHEN {score} >= {MEDIUM} THEN 'medium' ELSE 'low' END"


def _fill(prefix: str, weights: dict[str, float], special: dict[str, str] | None = None) -> str:
    terms = (f"CASE WHEN {(special or {}).get(k) or has(f'{prefix}.{k}')} THEN {w}D ELSE 0D END" for k, w in weights.items())
    return " + ".join(terms)


def _mean(array: str, fill: str) -> str:
    return f"aggregate(transform({array}, x -> {fill}), 0D, (s, x) -> s + x) / size({array})"


def scores(record: str = "record") -> dict[str, str]:
    """SQL of every section's score."""
    r = record
    jobs = _fill("x", EXPERIENCE_WEIGHTS, {"end_date": "(coalesce(x.end_date <> '', false) OR coalesce(x.is_current, false))", "description": "(coalesce(x.description <> '', false) OR coalesce(size(x.responsibilities) > 0, false))"})
    kinds = " + ".join(f"CASE WHEN {some(f'{r}.skills.{k}')} THEN 1 ELSE 0 END" for k in ("technical", "frameworks", "databases", "tools", "soft"))
    n = f"size({r}.skills.all)"
    project = "CASE WHEN coalesce(x.name <> '', false) THEN 0.4D ELSE 0D END + CASE WHEN coalesce(x.description <> '', false) THEN 0.3D ELSE 0D END + CASE WHEN coalesce(size(x.technologies) > 0, false) THEN 0.3D ELSE 0D END"
    length = f"char_length({r}.summary)"
    raw = {
        "contact": _fill(f"{r}.contact", CONTACT_WEIGHTS),
        "summary": f"CASE WHEN NOT {has(f'{r}.summary')} THEN 0D WHEN {length} >= 200 THEN 1D WHEN {length} >= 100 THEN 0.8D WHEN {length} >= 50 THEN 0.6D ELSE 0.3D END",
        "experience": f"CASE WHEN {some(f'{r}.experience')} THEN least(1D, {_mean(f'{r}.experience', jobs)} + least(size({r}.experience), 3) / 3D * 0.1D) ELSE 0D END",
        "education": f"CASE WHEN {some(f'{r}.education')} THEN {_mean(f'{r}.education', _fill('x', EDUCATION_WEIGHTS))} ELSE 0D END",
        "skills": f"CASE WHEN NOT {some(f'{r}.skills.all')} THEN 0D ELSE least(1D, CASE WHEN {n} >= 15 THEN 1D WHEN {n} >= 10 THEN 0.85D WHEN {n} >= 5 THEN 0.65D WHEN {n} >= 3 THEN 0.45D ELSE 0.25D END + ({kinds}) / 5D * 0.1D) END",
        "certifications": f"CASE WHEN {some(f'{r}.certifications')} THEN {_mean(f'{r}.certifications', _fill('x', CERTIFICATION_WEIGHTS))} ELSE 0D END",
        "projects": f"CASE WHEN {some(f'{r}.projects')} THEN {_mean(f'{r}.projects', project)} ELSE 0D END",
    }
    return {k: f"round({v}, 3)" for k, v in raw.items()}


def coverage(record: str = "record") -> str:
    r = record
    tests = [f"({has(f'{r}.contact.full_name')} OR {has(f'{r}.contact.email')})", has(f"{r}.summary"), some(f"{r}.experience"), some(f"{r}.education"), some(f"{r}.skills.all"), some(f"{r}.certifications"), some(f"{r}.projects"), some(f"{r}.languages")]
    return "round(({}) / 8D, 3)".format(" + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for t in tests))


def confidence(df: DataFrame, record: str = "record") -> DataFrame:
    """``confidence``: scores by section, section_coverage, overall and level."""
    each = scores(record)
    cols = ", ".join(f"'{k}', {v}" for k, v in each.items())
    out = df.withColumn("confidence", F.expr(f"named_struct({cols}, 'section_coverage', {coverage(record)})"))
    total = " + ".join(f"confidence.{k} * {w}D" for k, w in SECTION_WEIGHTS.items())
    out = out.withColumn("parchline__overall", F.expr(f"least(1D, {total} + confidence.section_coverage * 0.05D)"))
    whole = F.struct("confidence.*", F.round("parchline__overall", 3).alias("overall"), F.expr(level("parchline__overall")).alias("level"))
    return out.withColumn("confidence", whole).drop("parchline__overall")


def completeness(df: DataFrame, record: str = "record") -> DataFrame:
    """``completeness``: score, level, missing and present of ten weighted checks."""
    r = record
    tests = {
        "name": has(f"{r}.contact.full_name"),
        "email": has(f"{r}.contact.email"),
        "phone": has(f"{r}.contact.phone"),
        "summary": has(f"{r}.summary"),
        "experience": some(f"{r}.experience"),
        "education": some(f"{r}.education"),
        "skills": some(f"{r}.skills.all"),
        "certifications": some(f"{r}.certifications"),
        "linkedin": has(f"{r}.contact.linkedin"),
        "location": f"({has(f'{r}.contact.city')} OR {has(f'{r}.contact.country')})",
    }
    score = " + ".join(f"CASE WHEN {t} THEN {COMPLETENESS[k]}D ELSE 0D END" for k, t in tests.items())
    pick = lambda want: "array_compact(array({}))".format(", ".join(f"CASE WHEN {'' if want else 'NOT '}({t}) THEN '{k}' END" for k, t in tests.items()))
    return df.withColumn(
        "completeness",
        F.expr(f"named_struct('score', round({score}, 3), 'level', {level(f'round({score}, 6)')}, 'missing', {pick(False)}, 'present', {pick(True)})"),
    )


def at_extraction(df: DataFrame, record: str = "record") -> DataFrame:
    """``early``: scores by what extraction filled, before any validation; null sections count as empty."""
    r = record
    share = lambda part, test: f"CASE WHEN {some(f'{r}.{part}')} THEN round(size(filter({r}.{part}, x -> {test})) / size({r}.{part}), 2) ELSE 0D END"
    parts = {
        "summary": f"CASE WHEN {has(f'{r}.summary')} THEN 0.8D ELSE 0D END",
        "experience": share("experience", f"{has('x.job_title')} AND {has('x.company')}"),
        "education": share("education", f"{has('x.degree')} OR {has('x.institution')}"),
        "skills": f"CASE WHEN {some(f'{r}.skills.all')} THEN least(1D, size({r}.skills.all) / 10D) ELSE 0D END",
        "certifications": f"CASE WHEN {some(f'{r}.certifications')} THEN 0.8D ELSE 0D END",
    }
    contact = F.coalesce(contact_confidence(F.col(f"{r}.contact")), F.lit(0.0)).alias("contact")
    out = df.withColumn("early", F.struct(contact, *[F.expr(e).alias(k) for k, e in parts.items()]))
    total = " + ".join(f"early.{k} * {w}D" for k, w in EARLY_WEIGHTS.items())
    return out.withColumn("early", F.struct("early.*", F.expr(f"round({total}, 3)").alias("overall")))


def compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two scored extractions of the same documents: both overall scores, the better one (``a`` if they are equal) and the difference."""
    each = a.select(key, F.col("confidence.overall").alias("a")).join(b.select(key, F.col("confidence.overall").alias("b")), key)
    return each.select(key, "a", "b", F.when(F.col("a") >= F.col("b"), "a").otherwise("b").alias("better"), F.round(F.abs(F.col("a") - F.col("b")), 3).alias("difference"))

"""Record queries over a corpus of résumés that is written from the tables: a text for each customer, a job for each order.

The texts are made in Spark; the SQL never sees them. It says what a record must hold by the tables' own
values, so a line that is cut, matched, dated or scored wrongly makes the two differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..functions import text as T
from ..operators import enhance, layout, record, score, segment, store
from ..sources import documents
from .catalogue import AS_OF, _table, query

_FIRST = ["Anna", "Boris", "Clara", "David", "Elena", "Felix", "Greta", "Henry"]
_LAST = ["Miller", "Schmidt", "Lopez", "Durand", "Rossi", "Novak", "Jensen", "Brown"]
_CITIES = ["Berlin", "Paris", "Toronto", "Vienna", "Oslo"]
_COUNTRIES = ["Germany", "France", "Canada", "Austria", "Norway"]
#: A job's title as it is written, and its normal form.
_TITLES = {"Software Engineer": "Software Engineer", "Data Analyst": "Data Analyst", "Business Analyst": "Business Analyst", "Senior Data Engineer": "Senior Data Engineer", "sre": "Site Reliability Engineer"}
_DEGREES = ["Master of Science in Computer Science", "Bachelor of Arts in Economics", "MBA"]


def _pick(values: list[str], index: str) -> str:
    """SQL of both dialects: the value at an index from 0."""
    return "(CASE {} END)".format(" ".join(f"WHEN ({index}) % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)))


_WHO = f"c_custkey AS c, {_pick(_FIRST, 'c_custkey')} AS first, {_pick(_LAST, 'CAST(floor(c_custkey / 8) AS BIGINT)')} AS last, {_pick(_CITIES, 'c_nationkey')} AS city, {_pick(_COUNTRIES, 'c_nationkey')} AS country, c_nationkey % 3 AS kind"


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the corpus."""
    people = _table(spark, sf_dir, "customer").selectExpr(*_columns(_WHO))
    jobs = _table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS c",
        f"concat({_pick(list(_TITLES), 'o_orderkey')}, ' | Firm ', o_orderkey % 50, ' | ', {_pick(_CITIES, 'o_orderkey')}, '\\n', date_format(o_orderdate, 'MMM yyyy'), ' - ', "
        "CASE WHEN o_orderstatus = 'P' THEN 'Present' ELSE date_format(add_months(trunc(o_orderdate, 'month'), cast(o_orderkey % 40 AS int)), 'MMM yyyy') END, "
        "'\\n- Shipped release ', o_orderkey % 1000, CASE WHEN o_orderkey % 2 = 0 THEN concat('\\n- Led review ', o_orderkey % 10) ELSE '' END) AS line",
        "struct(-unix_timestamp(o_orderdate) AS late, o_orderkey AS k) AS place",
    )
    jobs = jobs.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("jobs"))
    text = (
        "concat_ws('\\n', concat(first, ' ', last), CASE WHEN c % 5 <> 0 THEN concat(lower(first), '.', lower(last), c, '@mail.org') END, "
        "CASE WHEN c % 7 <> 0 THEN concat('+1 (555) 2', lpad(c % 100, 2, '0'), '-', lpad(c % 10000, 4, '0')) END, "
        "CASE WHEN c % 3 = 0 THEN concat('linkedin.com/in/', lower(first), '-', lower(last)) END, concat(city, ', ', country), "
        "CASE WHEN c % 4 <> 0 THEN concat('\\nPROFESSIONAL SUMMARY\\nPractitioner number ', c, ' who builds data platforms and services for teams.') END, "
        "CASE WHEN jobs IS NOT NULL THEN concat('\\nWORK EXPERIENCE\\n', array_join(transform(jobs, x -> x.line), '\\n')) END, "
        f"CASE WHEN c % 6 <> 5 THEN concat('\\nEDUCATION\\n', {_pick(_DEGREES, 'kind')}, '\\nTechnical University of ', city, '\\n2010 - 2012\\nGPA: 3.', c % 10, '/4.0') END, "
        "concat('\\nSKILLS\\nLanguages: Python', CASE WHEN c % 2 = 0 THEN ', k8s' ELSE '' END, CASE WHEN c % 3 = 0 THEN ', postgresq' ELSE '' END, CASE WHEN c % 5 = 0 THEN ', Zzyx' ELSE '' END, "
        "CASE WHEN c % 7 = 0 THEN '\\nOther: Docker Swarm' ELSE '' END, CASE WHEN c % 11 = 0 THEN '\\n- scikitlearn' ELSE '' END), "
        "CASE WHEN c % 4 = 1 THEN '\\nCERTIFICATIONS\\nAWS Certified Solutions Architect - 2021\\nPMP, 2019' END, "
        "CASE WHEN c % 9 = 0 THEN '\\nPROJECTS\\nParchment Index\\nTechnologies: Spark, Airflow\\n- Searches old letters quickly' END, "
        "CASE WHEN c % 2 = 1 THEN '\\nLANGUAGES\\nEnglish (Native), German (Fluent)' END)"
    )
    return people.join(jobs, "c", "left").selectExpr("c AS doc_id", f"{text} AS text")


def _columns(select: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, ch in enumerate(select + ","):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(select[last:i])
            last = i + 1
    return out


_MADE: dict[tuple[str, str], str] = {}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, record, confidence, completeness of the corpus; made once for each application and folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MADE:
        docs = store.stored(resumes(spark, sf_dir), "resumes")
        made = store.stored(record.extract(docs, AS_OF).join(docs, "doc_id"), "resume-records")
        scored = score.completeness(score.confidence(made))
        _MADE[key] = store.stored_path(scored, "resume-scores")
    return spark.read.parquet(_MADE[key])


#: What the tables say of persons (one row each) and of their jobs.
_PEOPLE = f"""WITH p AS (SELECT {_WHO} FROM customer),
j AS (SELECT o_custkey AS c, o_orderkey AS k, {_pick(list(_TITLES.values()), 'o_orderkey')} AS job_title, concat('Firm ', o_orderkey % 50) AS company, {_pick(_CITIES, 'o_orderkey')} AS location,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS a, o_orderstatus = 'P' AS is_current,
  CASE WHEN o_orderstatus = 'P' THEN DATE '{AS_OF}' ELSE CAST(date_trunc('month', o_orderdate) + to_months(CAST(o_orderkey % 40 AS INT)) AS DATE) END AS b,
  row_number() OVER (PARTITION BY o_custkey ORDER BY date_trunc('month', o_orderdate) DESC, o_orderdate DESC, o_orderkey) - 1 AS pos FROM orders),
d AS (SELECT *, round(date_diff('month', a, b) / 12.0e0, 1) AS years, strftime(a, '%b %Y') AS start_date, CASE WHEN is_current THEN 'Present' ELSE strftime(b, '%b %Y') END AS end_date FROM j),
n AS (SELECT c, count(*) AS jobs, sum(years) AS sum_years, arg_min(job_title, pos) AS first_title, arg_min(company, pos) AS first_company, arg_min(start_date, pos) AS first_start,
  arg_min(job_title, pos) FILTER (is_current) AS current_title FROM d GROUP BY c),
f AS (SELECT p.*, concat(first, ' ', last) AS full_name, CASE WHEN c % 5 <> 0 THEN concat(lower(first), '.', lower(last), c, '@mail.org') END AS email,
  CASE WHEN c % 7 <> 0 THEN concat('+1 (555) 2', lpad(CAST(c % 100 AS VARCHAR), 2, '0'), '-', lpad(CAST(c % 10000 AS VARCHAR), 4, '0')) END AS phone,
  CASE WHEN c % 3 = 0 THEN concat('https://linkedin.com/in/', lower(first), '-', lower(last)) END AS linkedin,
  CASE WHEN c % 4 <> 0 THEN concat('Practitioner number ', c, ' who builds data platforms and services for teams.') END AS summary,
  coalesce(n.jobs, 0) AS jobs, n.sum_years, n.first_title, n.first_company, n.first_start, n.current_title,
  c % 6 <> 5 AS edu, c % 4 = 1 AS cert, c % 9 = 0 AS proj, c % 2 = 1 AS lang,
  concat('python', CASE WHEN c % 2 = 0 THEN ',kubernetes' ELSE '' END, CASE WHEN c % 3 = 0 THEN ',postgresql' ELSE '' END, CASE WHEN c % 7 = 0 THEN ',docker' ELSE '' END, CASE WHEN c % 11 = 0 THEN ',scikit-learn' ELSE '' END,
    CASE WHEN c % 4 = 1 THEN ',aws' ELSE '' END, CASE WHEN c % 9 = 0 THEN ',spark,airflow' ELSE '' END) AS skills FROM p LEFT JOIN n USING (c)) """


@query(_PEOPLE + "SELECT c AS doc_id, full_name, email, phone, linkedin, city, country, round(0.3 + CASE WHEN email IS NULL THEN 0 ELSE 0.25e0 END + CASE WHEN phone IS NULL THEN 0 ELSE 0.2e0 END + CASE WHEN linkedin IS NULL THEN 0 ELSE 0.1e0 END + 0.1e0 + 0.05e0, 2) AS confidence FROM f")
def record_contacts(spark, sf_dir):
    made = records(spark, sf_dir).select("doc_id", "record.contact")
    fields = [F.col(f"contact.{k}").alias(k) for k in ("full_name", "email", "phone", "linkedin", "city", "country")]
    return made.select("doc_id", *fields, record.contact_confidence(F.col("contact")).alias("confidence"))


@query(_PEOPLE + "SELECT c AS doc_id, pos, job_title, company, location, start_date, end_date, years AS duration_years, is_current, CASE WHEN k % 2 = 0 THEN concat('Shipped release ', k % 1000, '|Led review ', k % 10) ELSE concat('Shipped release ', k % 1000) END AS responsibilities FROM d")
def record_jobs(spark, sf_dir):
    each = records(spark, sf_dir).select("doc_id", F.posexplode("record.experience").alias("pos", "j")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "j.*")
    return each.withColumn("responsibilities", F.array_join("responsibilities", "|")).drop("description")


@query(_PEOPLE + "SELECT c AS doc_id, CASE kind WHEN 0 THEN 'Master Of Science' WHEN 1 THEN 'Bachelor Of Arts' ELSE 'Master of Business Administration' END AS degree, CASE kind WHEN 0 THEN 'Computer Science' WHEN 1 THEN 'Economics' END AS field_of_study, concat('Technical University of ', city) AS institution, '2010' AS start_date, '2012' AS graduation_date, concat('3.', c % 10, '/4.0') AS gpa FROM f WHERE edu")
def record_education(spark, sf_dir):
    return records(spark, sf_dir).select("doc_id", F.explode("record.education").alias("e")).select("doc_id", "e.*").drop("location")


@query(_PEOPLE + "SELECT c AS doc_id, skills, 'python' AS technical, CASE WHEN c % 11 = 0 THEN 'scikit-learn' ELSE '' END AS frameworks, CASE WHEN c % 3 = 0 THEN 'postgresql' ELSE '' END AS databases FROM f")
def record_skills(spark, sf_dir):
    """Listed skills by the whole ladder (exact, alias, key, similar, part), those under .60 dropped, then mined ones."""
    names = {"skills": "all", "technical": "technical", "frameworks": "frameworks", "databases": "databases"}
    return records(spark, sf_dir).select("doc_id", *[F.array_join(f"record.skills.{v}", ",").alias(k) for k, v in names.items()])


@query(_PEOPLE + "SELECT c AS doc_id, name, issuer, date, CASE name WHEN 'PMP' THEN 'https://www.pmi.org/certifications/project-management-pmp' ELSE 'https://aws.amazon.com/certification/certified-solutions-architect-associate/' END AS url FROM f, (VALUES ('AWS Certified Solutions Architect', 'Aws', '2021'), ('PMP', NULL, '2019')) t(name, issuer, date) WHERE cert")
def record_certifications(spark, sf_dir):
    """Certificates of enhanced records, with the pages of those that are known."""
    made = enhance.enhance(records(spark, sf_dir), AS_OF).select("doc_id", F.explode("record.certifications").alias("x"))
    return made.select("doc_id", "x.name", "x.issuer", "x.date", "x.url")


@query(_PEOPLE + "SELECT c AS doc_id, 'Parchment Index' AS name, 'Spark,Airflow' AS technologies, 'Searches old letters quickly' AS description FROM f WHERE proj")
def record_projects(spark, sf_dir):
    each = records(spark, sf_dir).select("doc_id", F.explode("record.projects").alias("x"))
    return each.select("doc_id", "x.name", F.array_join("x.technologies", ",").alias("technologies"), "x.description")


@query(_PEOPLE + "SELECT c AS doc_id, language, proficiency FROM f, (VALUES ('English', 'Native'), ('German', 'Fluent')) t(language, proficiency) WHERE lang")
def record_languages(spark, sf_dir):
    return records(spark, sf_dir).select("doc_id", F.explode("record.languages").alias("x")).select("doc_id", "x.*")


@query(
    _PEOPLE
    + """, o AS (SELECT *, max(b) OVER (PARTITION BY c ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d),
    i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM o),
    s AS (SELECT c, island, min(a) AS a, max(b) AS b FROM i GROUP BY 1, 2), t AS (SELECT c, round(sum(date_diff('day', a, b)) / 365.25, 1) AS years FROM s GROUP BY 1)
    SELECT c AS doc_id, summary, coalesce(years, 0) AS total_experience_years, concat('contact', CASE WHEN edu THEN ',education' ELSE '' END, CASE WHEN jobs > 0 THEN ',experience' ELSE '' END, CASE WHEN lang THEN ',languages' ELSE '' END,
      CASE WHEN proj THEN ',projects' ELSE '' END, ',skills', CASE WHEN c % 4 <> 0 THEN ',summary' ELSE '' END) AS sections FROM f LEFT JOIN t USING (c) WHERE NOT cert"""
)
def record_totals(spark, sf_dir):
    """Summary, years of experience with overlaps once, and detected sections of records without certificates."""
    made = records(spark, sf_dir).where("size(record.certifications) = 0")
    return made.select("doc_id", "record.summary", "record.total_experience_years", F.array_join("record.sections_detected", ",").alias("sections"))


_SCORED = (
    _PEOPLE
    + """, s AS (SELECT *, round(0.3e0 + CASE WHEN email IS NULL THEN 0 ELSE 0.25e0 END + CASE WHEN phone IS NULL THEN 0 ELSE 0.2e0 END + CASE WHEN linkedin IS NULL THEN 0 ELSE 0.1e0 END + 0.08e0 + 0.07e0, 3) AS contact,
      CASE WHEN jobs > 0 THEN 1e0 ELSE 0e0 END AS experience, CASE WHEN NOT edu THEN 0e0 WHEN kind = 2 THEN 0.9e0 ELSE 1e0 END AS education,
      len(string_split(skills, ',')) AS n, CASE WHEN summary IS NULL THEN 0e0 ELSE 0.6e0 END AS about, CASE WHEN cert THEN 0.85e0 ELSE 0e0 END AS certs, CASE WHEN proj THEN 1e0 ELSE 0e0 END AS projects,
      round((2 + CAST(summary IS NOT NULL AS INT) + CAST(jobs > 0 AS INT) + CAST(edu AS INT) + CAST(cert AS INT) + CAST(proj AS INT) + CAST(lang AS INT)) / 8.0e0, 3) AS coverage FROM f),
    k AS (SELECT *, round(least(1, CASE WHEN n >= 15 THEN 1e0 WHEN n >= 10 THEN 0.85e0 WHEN n >= 5 THEN 0.65e0 WHEN n >= 3 THEN 0.45e0 ELSE 0.25e0 END + (1 + CAST(c % 11 = 0 AS INT) + CAST(c % 3 = 0 AS INT)) / 5.0e0 * 0.1e0), 3) AS skill FROM s),
    w AS (SELECT *, least(1, contact * 0.28e0 + experience * 0.25e0 + education * 0.18e0 + skill * 0.15e0 + about * 0.06e0 + certs * 0.04e0 + projects * 0.04e0 + coverage * 0.05e0) AS whole FROM k) """
)


@query(_SCORED + "SELECT c AS doc_id, contact, about AS summary, experience, education, skill AS skills, certs AS certifications, projects, coverage AS section_coverage, round(whole, 3) AS overall, CASE WHEN whole >= 0.85 THEN 'high' WHEN whole >= 0.6 THEN 'medium' ELSE 'low' END AS level FROM w")
def record_scores(spark, sf_dir):
    return records(spark, sf_dir).select("doc_id", "confidence.*")


@query(
    _PEOPLE
    + """, t AS (SELECT c, 0.2e0 + CASE WHEN email IS NULL THEN 0 ELSE 0.15e0 END + CASE WHEN phone IS NULL THEN 0 ELSE 0.05e0 END + CASE WHEN summary IS NULL THEN 0 ELSE 0.05e0 END + CASE WHEN jobs > 0 THEN 0.2e0 ELSE 0 END
      + CASE WHEN edu THEN 0.15e0 ELSE 0 END + 0.15e0 + CASE WHEN cert THEN 0.02e0 ELSE 0 END + CASE WHEN linkedin IS NULL THEN 0 ELSE 0.02e0 END + 0.01e0 AS v,
      concat(CASE WHEN email IS NULL THEN 'email,' ELSE '' END, CASE WHEN phone IS NULL THEN 'phone,' ELSE '' END, CASE WHEN summary IS NULL THEN 'summary,' ELSE '' END, CASE WHEN jobs = 0 THEN 'experience,' ELSE '' END,
      CASE WHEN NOT edu THEN 'education,' ELSE '' END, CASE WHEN NOT cert THEN 'certifications,' ELSE '' END, CASE WHEN linkedin IS NULL THEN 'linkedin,' ELSE '' END) AS missing FROM f)
    SELECT c AS doc_id, round(v, 3) AS score, CASE WHEN round(v, 6) >= 0.85 THEN 'high' WHEN round(v, 6) >= 0.6 THEN 'medium' ELSE 'low' END AS level, missing FROM t"""
)
def record_completeness(spark, sf_dir):
    missing = F.array_join(F.transform("completeness.missing", lambda x: F.concat(x, F.lit(","))), "")
    return records(spark, sf_dir).select("doc_id", "completeness.score", "completeness.level", missing.alias("missing"))


@query(_PEOPLE + "SELECT c AS doc_id, CAST(CASE WHEN email IS NULL AND phone IS NULL THEN 1 ELSE 0 END + CASE WHEN jobs = 0 AND NOT edu THEN 1 ELSE 0 END AS BIGINT) AS n_warnings, email, phone, CAST(len(string_split(skills, ',')) AS BIGINT) AS n_skills FROM f")
def record_warnings(spark, sf_dir):
    """Validated records: warnings, and fields that pass the checks (all of these texts' do)."""
    made = enhance.validate_record(records(spark, sf_dir), AS_OF)
    return made.select("doc_id", F.size("warnings").cast("bigint").alias("n_warnings"), "record.contact.email", "record.contact.phone", F.size("record.skills.all").cast("bigint").alias("n_skills"))


@query(_PEOPLE + "SELECT c AS doc_id, full_name, email, round(coalesce(sum_years, 0), 1) AS experience_years_sum, coalesce(current_title, first_title) AS current_title, CASE WHEN NOT edu THEN NULL WHEN kind = 0 THEN 'Master Of Science' WHEN kind = 1 THEN 'Bachelor Of Arts' ELSE 'Master of Business Administration' END AS degree, email IS NOT NULL AND jobs > 0 AS has_complete_profile FROM f")
def candidate_rows(spark, sf_dir):
    made = store.candidate_rows(records(spark, sf_dir))
    return made.select("doc_id", "full_name", "email", F.round("experience_years_sum", 1).alias("experience_years_sum"), "current_title", "degree", "has_complete_profile")


# --- exports ---


@query(_PEOPLE + "SELECT c AS doc_id, full_name, coalesce(email, '') AS email, coalesce(first_title, '') AS latest_job_title, coalesce(first_company, '') AS latest_company, coalesce(first_start, '') AS latest_start_date, replace(skills, ',', ', ') AS all_skills, CASE WHEN cert THEN 'AWS Certified Solutions Architect, PMP' ELSE '' END AS certifications, CASE WHEN lang THEN 'English, German' ELSE '' END AS spoken_languages FROM f")
def export_summary(spark, sf_dir):
    """The export's mapped projection, under its field names."""
    flat = sinks.flat(records(spark, sf_dir))
    names = ("full_name", "email", "latest_job_title", "latest_company", "latest_start_date", "all_skills", "certifications", "spoken_languages")
    rows = sinks.mapped(flat, {k: sinks.EXPORT_COLUMNS[k] for k in names} | {"doc_id": ("doc_id", 10)})
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(f"`{sinks.EXPORT_COLUMNS[k][0]}`").alias(k) for k in names])


@query(_PEOPLE + "SELECT f.c AS doc_id, full_name, email, pos, d.job_title, d.company FROM f LEFT JOIN d ON d.c = f.c")
def export_experience(spark, sf_dir):
    rows = sinks.exploded(records(spark, sf_dir), "experience")
    return rows.select("doc_id", "full_name", "email", F.col("pos").cast("bigint").alias("pos"), "job_title", "company")


@query(_PEOPLE + """SELECT c AS doc_id, CASE WHEN cert THEN '[{"name":"AWS Certified Solutions Architect","issuer":"Aws","date":"2021"},{"name":"PMP","date":"2019"}]' ELSE '[]' END AS certifications_json, CASE WHEN proj THEN '[{"name":"Parchment Index","description":"Searches old letters quickly","technologies":["Spark","Airflow"]}]' ELSE '[]' END AS projects_json FROM f""")
def export_full(spark, sf_dir):
    return sinks.full(records(spark, sf_dir)).select("doc_id", "certifications_json", "projects_json")


@query(
    _PEOPLE
    + """, o AS (SELECT CAST(count(*) AS DOUBLE) AS total, CAST(count(email) AS DOUBLE) AS with_email, CAST(count(phone) AS DOUBLE) AS with_phone, CAST(count(*) FILTER (jobs > 0) AS DOUBLE) AS with_experience, CAST(count(*) FILTER (edu) AS DOUBLE) AS with_education,
      CAST(count(*) AS DOUBLE) AS with_skills, round(avg(len(string_split(skills, ','))), 1) AS avg_skills, round(avg(jobs), 1) AS avg_jobs FROM f) SELECT metric, value FROM (UNPIVOT o ON COLUMNS(*) INTO NAME metric VALUE value)"""
)
def export_statistics(spark, sf_dir):
    return sinks.overview(records(spark, sf_dir))


@query(_PEOPLE + "SELECT 'experience' AS name, (SELECT count(*) FROM d) AS n UNION ALL SELECT 'education', count(*) FILTER (edu) FROM f UNION ALL SELECT 'certifications', 2 * count(*) FILTER (cert) FROM f UNION ALL SELECT 'languages', 2 * count(*) FILTER (lang) FROM f UNION ALL SELECT 'projects', count(*) FILTER (proj) FROM f UNION ALL SELECT 'contacts', count(*) FROM f UNION ALL SELECT 'skills', CAST(sum(len(string_split(skills, ','))) AS BIGINT) FROM f")
def normalized_counts(spark, sf_dir):
    """Rows of the normalised relations after they were written twice: a second write changes nothing."""
    tables = {k: v for k, v in store.normalized_tables(records(spark, sf_dir)).items() if k not in ("extractions", "candidates")}
    root = store.new_folder(spark, "normalized")
    for _ in (1, 2):
        errors = store.write_all(tables, root)
        if errors:
            raise RuntimeError(str(errors))
    out = None
    for name in tables:
        one = spark.read.parquet(f"{root}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")).select("name", "n")
        out = one if out is None else out.unionByName(one)
    return out


# --- sections and blocks of the corpus ---


@query(
    _PEOPLE
    + """SELECT c AS doc_id, CAST(2 + CAST(email IS NOT NULL AS INT) + CAST(phone IS NOT NULL AS INT) + CAST(linkedin IS NOT NULL AS INT) AS BIGINT) AS n_contact, (SELECT CAST(coalesce(sum(3 + CAST(k % 2 = 0 AS INT)), 0) AS BIGINT) FROM d WHERE d.c = f.c) AS n_experience,
    CAST(CASE WHEN edu THEN 4 ELSE 0 END AS BIGINT) AS n_education FROM f"""
)
def section_lines(spark, sf_dir):
    """Lines of sections, from blocks made of the texts."""
    cut = segment.segment_blocks(documents.text_blocks(records(spark, sf_dir).select("doc_id", "text")))
    counts = [F.count_if(F.col("section") == s).alias(f"n_{s}") for s in ("contact", "experience", "education")]
    return cut.groupBy("doc_id").agg(*counts)


@query(_PEOPLE + "SELECT c AS doc_id, full_name AS name FROM f")
def name_blocks(spark, sf_dir):
    return segment.name_block(documents.text_blocks(records(spark, sf_dir).select("doc_id", "text")))


@query(_PEOPLE + "SELECT c AS doc_id, concat(CASE WHEN c % 4 <> 0 THEN 'PROFESSIONAL SUMMARY,' ELSE '' END, 'SKILLS', CASE WHEN jobs > 0 THEN ',WORK EXPERIENCE' ELSE '' END) AS headers FROM f")
def found_headers(spark, sf_dir):
    """Headers by their score: capitals, bold and size against a document's dominant size."""
    found = segment.find_headers(documents.text_blocks(records(spark, sf_dir).select("doc_id", "text")))
    found = found.where("text IN ('SKILLS', 'PROFESSIONAL SUMMARY', 'WORK EXPERIENCE')")
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("text")).alias("h")).select("doc_id", F.array_join("h", ",").alias("headers"))


@query(
    """WITH r AS (SELECT n_regionkey AS k, n_nationkey AS n, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row_idx FROM nation)
    SELECT CAST(k AS BIGINT) AS doc_id, row_idx, CASE WHEN n % 2 = 0 THEN concat(n, ' | ', name) ELSE concat(n, ' | ') END AS line FROM r"""
)
def html_table_rows(spark, sf_dir):
    """Rows of HTML tables, one for each region; odd rows lack a cell, the second header is blank."""
    cell = F.expr("concat('<tr><td>', n_nationkey, '</td>', CASE WHEN n_nationkey % 2 = 0 THEN concat('<td> ', n_name, '</td>') ELSE '' END, '</tr>')")
    rows = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("bigint").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", cell.alias("x")))).alias("r"))
    pages = rows.selectExpr("doc_id", "concat('<p>x</p><table><tr><th>key</th><th></th></tr>', array_join(transform(r, y -> y.x), ''), '</table>') AS html")
    return documents.table_text(documents.html_tables(pages)).select("doc_id", F.col("row_idx").cast("bigint").alias("row_idx"), "line")


# --- texts ---


@query(
    r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text, chr(160), ' '), chr(9), ' '), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), ' {2,}', ' ', 'g') AS t FROM documents WHERE NOT regexp_matches(text, '[a-z]l[A-Z]|[^\x00-\x7E\xA0-\xFF]|[«»æÆ\xAD]')),
    l AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), chr(10))) AS x, generate_subscripts(string_split(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), 1) AS i FROM c),
    k AS (SELECT doc_id, x, i, length(trim(x)) AS n, length(regexp_replace(trim(x), '[^\p{L}\p{N}]', '', 'g')) AS a FROM l),
    j AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) FILTER (NOT (n > 0 AND ((n <= 3 AND a = 0) OR (n < 10 AND a < n * 0.2)))) AS t FROM k GROUP BY doc_id)
    SELECT doc_id, md5(regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '')) AS clean_md5 FROM j"""
)
def cleaned_texts(spark, sf_dir):
    """The cleaning chain over documents in the characters that both dialects spell alike."""
    docs = _table(spark, sf_dir, "documents").where(~F.col("text").rlike("[a-z]l[A-Z]|[^\\x00-\\x7E\\u00A0-\\u00FF]|[«»æÆ\\u00AD]"))
    return docs.select("doc_id", F.md5(T.clean(F.col("text"))).alias("clean_md5"))


@query(
    r"""SELECT doc_id, CASE WHEN length(text) > 500 THEN concat(rtrim(substr(text, 1, 497)), '...') ELSE text END AS short,
    md5(regexp_replace(text, '(?im)(https?://|www\.)[^\s]+', '', 'g')) AS no_urls_md5,
    md5(regexp_replace(text, '(?m)^[ \t]*[•●◦‣▸▹►▻*+>-][ \t]+', '- ', 'g')) AS bullets_md5 FROM documents"""
)
def text_helpers(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.truncate(F.col("text")).alias("short"), F.md5(T.remove_urls(F.col("text"))).alias("no_urls_md5"), F.md5(T.normalize_bullets(F.col("text"))).alias("bullets_md5"))


# --- layout ---

_BLOCKS = "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS block_seq, CAST((l_partkey * 7 + l_linenumber * 131) % 480 AS DOUBLE) AS x0, CAST((l_suppkey * 13 + l_linenumber * 97) % 780 AS DOUBLE) AS y0, concat('block ', CAST(l_partkey % 50 AS VARCHAR)) AS text FROM lineitem"


@query(
    f"""WITH b AS ({_BLOCKS}), s AS (SELECT *, CASE WHEN x0 >= 300 THEN 1 ELSE 0 END AS side, round_even(y0 / 10, 0) * 10 AS y FROM b),
    g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, side ORDER BY y, x0, block_seq, text) > 10 THEN 1 ELSE 0 END AS jump FROM s),
    n AS (SELECT *, sum(jump) OVER (PARTITION BY doc_id, side ORDER BY y, x0, block_seq, text ROWS UNBOUNDED PRECEDING) AS line_no FROM g)
    SELECT doc_id, CAST(side AS BIGINT) AS side, CAST(line_no AS BIGINT) AS line_no, string_agg(text, ' ' ORDER BY y, x0, block_seq, text) AS line FROM n GROUP BY 1, 2, 3"""
)
def word_lines(spark, sf_dir):
    from .catalogue import derived

    made = layout.lines_from_words(derived(spark, sf_dir, "blocks"), 300.0)
    return made.select("doc_id", F.col("side").cast("bigint").alias("side"), F.col("line_no").cast("bigint").alias("line_no"), "line")


@query(
    f"""WITH RECURSIVE b AS ({_BLOCKS}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, block_seq, text) AS rn FROM b),
    w AS (SELECT doc_id, rn, y0 AS anchor, 1 AS line, x0, block_seq, text FROM o WHERE rn = 1
      UNION ALL SELECT o.doc_id, o.rn, CASE WHEN o.y0 - w.anchor <= 15 THEN w.anchor ELSE o.y0 END, w.line + CASE WHEN o.y0 - w.anchor <= 15 THEN 0 ELSE 1 END, o.x0, o.block_seq, o.text FROM w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1)
    SELECT doc_id, CAST(line AS BIGINT) AS row, string_agg(text, '  ' ORDER BY x0, block_seq, text) AS line FROM w GROUP BY doc_id, line"""
)
def anchored_lines(spark, sf_dir):
    """Rows of blocks whose anchor moves with the row, as lines of cells."""
    from .catalogue import derived

    return layout.adaptive_text(derived(spark, sf_dir, "blocks")).select("doc_id", F.col("row").cast("bigint").alias("row"), "line")


@query(f"WITH b AS ({_BLOCKS}) SELECT doc_id, string_agg(text, ' ' ORDER BY round_even(y0 / 15, 0), CASE WHEN x0 < 270 THEN 'left' WHEN x0 > 330 THEN 'right' ELSE 'full' END, x0, block_seq) AS text FROM b GROUP BY doc_id")
def full_texts(spark, sf_dir):
    from .catalogue import WIDTH, derived

    return layout.full_text(layout.page_order(layout.column_tags(derived(spark, sf_dir, "blocks", "place"), WIDTH), place="place"))


# --- the relational tier ---


@query(
    """WITH r AS (SELECT o_orderkey AS resume_id, CASE WHEN o_orderkey % 10 = 0 THEN 'skipped' WHEN o_orderstatus = 'O' THEN 'completed' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'pending' END AS status FROM orders WHERE o_orderkey % 7 <> 0)
    SELECT status, count(*) AS n, CAST(sum(resume_id) AS BIGINT) AS ids FROM r GROUP BY status"""
)
def versioned_rows(spark, sf_dir):
    """A versioned table after an append, an update of every tenth key and a deletion of every seventh."""
    from .catalogue import derived

    rows = derived(spark, sf_dir, "resumes").select("resume_id", "status")
    table = store.Table(spark, store.new_folder(spark, "versioned"), "resume_id")
    table.append(rows, 1)
    table.update(rows.where("resume_id % 10 = 0").select("resume_id"), {"status": "skipped"}, 2)
    table.delete(rows.where("resume_id % 7 = 0").select("resume_id"), 3)
    return table.current().groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("resume_id").alias("ids"))


@query("SELECT o_orderkey AS resume_id, (SELECT count(*) FROM orders) AS total, 150 < (SELECT count(*) FROM orders) AS has_next FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def listed_page(spark, sf_dir):
    from .catalogue import derived

    return store.list_page(derived(spark, sf_dir, "resumes"), "uploaded_at", 3, 50, "resume_id").select("resume_id", "total", "has_next")


@query("SELECT c_custkey AS candidate_id FROM customer WHERE c_custkey = 42")
def candidate_by_email(spark, sf_dir):
    from .catalogue import derived

    return store.by_email(derived(spark, sf_dir, "candidates"), "  C42@Mail.org ").select("candidate_id")


@query("SELECT event_type AS stage, count(*) AS n, count(*) FILTER (value < 20) AS failed, round(avg(value), 3) AS avg_seconds FROM events GROUP BY 1")
def stage_logs(spark, sf_dir):
    """Extraction logs: appended in two halves, read back, statistics by stage."""
    log = store.Log(spark, store.new_folder(spark, "log"))
    events = _table(spark, sf_dir, "events").selectExpr("user_id AS resume_id", "event_type AS stage", "value >= 20 AS success", "value AS seconds", "ts AS started_at")
    log.append(events.where("resume_id % 2 = 0"))
    log.append(events.where("resume_id % 2 = 1"))
    return log.statistics()


@query("SELECT o_orderkey AS resume_id, o_orderstatus = 'O' AS is_processed, o_orderstatus = 'F' AS is_failed, round((o_orderkey % 100000) / 1024.0e0, 2) AS size_kb, concat('Resume ', o_orderkey) AS display_name FROM orders")
def resume_properties(spark, sf_dir):
    from .catalogue import derived

    rows = derived(spark, sf_dir, "resumes").selectExpr("resume_id", "status", "resume_id % 100000 AS file_size", "cast(null AS string) original_filename", "concat('Resume ', resume_id) AS stored_filename")
    return store.with_properties(rows).select("resume_id", "is_processed", "is_failed", "size_kb", "display_name")


@query("SELECT o_orderkey AS resume_id FROM orders WHERE o_orderkey % 11 = 0 OR CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'")
def uploaded_between(spark, sf_dir):
    """Inclusive by day; rows whose day can't be read stay."""
    from .catalogue import derived

    rows = derived(spark, sf_dir, "resumes").selectExpr("resume_id", "CASE WHEN resume_id % 11 = 0 THEN 'no day' ELSE date_format(uploaded_at, 'yyyy-MM-dd HH:mm:ss') END AS day")
    return store.uploaded_between(rows, "day", "1995-01-01", "1996-06-30").select("resume_id")


@query(_PEOPLE + "SELECT c AS doc_id, full_name, jobs AS n_jobs FROM f WHERE c % 3 = 0")
def loaded_results(spark, sf_dir):
    """Result records written as JSON and loaded again by their ids; rows that aren't JSON are passed over."""
    made = records(spark, sf_dir)
    rows = made.selectExpr("doc_id", "'completed' AS status", "CASE WHEN doc_id % 3 = 1 THEN 'no json' ELSE to_json(record) END AS data")
    loaded = store.load_results(rows, made.schema["record"].dataType, ids=made.where("doc_id % 3 < 2").select("doc_id"))
    return loaded.select("doc_id", "record.contact.full_name", F.size("record.experience").cast("bigint").alias("n_jobs"))

"""Queries over the engine's operators, with their SQL counterparts.

Operators of records that the test tables lack run on relations derived from them by plain
arithmetic, the same text in both dialects (``DERIVED``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import sinks
from ..functions import dates as D
from ..functions import language as L
from ..functions import regexes as R
from ..functions import text as T
from ..functions import validate as V
from ..operators import layout, match, record, score, segment, store
from ..sources import tables
from ..streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-01-01"
WIDTH, HEIGHT = 600.0, 800.0

#: Relations that both dialects derive alike: table and select list.
DERIVED = {
    "resumes": (
        "orders",
        "o_orderkey AS resume_id, o_custkey AS candidate_id, CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'F' THEN 'failed' ELSE 'pending' END AS status, "
        "o_orderdate AS uploaded_at, CAST(o_orderkey % 1000 AS DOUBLE) / 1000 AS confidence, CAST(o_orderkey % 97 AS DOUBLE) / 4 AS seconds, CAST(o_orderkey % 5 AS INT) AS retry_count",
    ),
    "candidates": ("customer", "c_custkey AS candidate_id, c_name AS full_name, concat('c', CAST(c_custkey AS VARCHAR(20)), '@mail.org') AS email, c_mktsegment AS segment"),
    "blocks": (
        "lineitem",
        "l_orderkey AS doc_id, 1 AS page_num, CAST(l_linenumber AS INT) AS block_seq, CAST((l_partkey * 7 + l_linenumber * 131) % 480 AS DOUBLE) AS x0, "
        "CAST((l_suppkey * 13 + l_linenumber * 97) % 780 AS DOUBLE) AS y0, CAST((l_partkey * 7 + l_linenumber * 131) % 480 + 40 + (l_partkey % 5) * 120 AS DOUBLE) AS x1, "
        "CAST(9 + (l_partkey % 7) AS DOUBLE) AS font_size, l_partkey % 4 = 0 AS is_bold, concat('block ', CAST(l_partkey % 50 AS VARCHAR(20))) AS text",
    ),
    "jobs": ("orders", "o_custkey AS person_id, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INT) AS end_date, o_orderkey AS job_id"),
    "steps": ("events", "user_id, ts, event_id, event_type, event_type AS text, value"),
    "skills": ("lineitem JOIN part ON l_partkey = p_partkey", "l_orderkey AS person_id, CAST(l_linenumber AS INT) AS pos, split_part(p_name, ' ', 2) AS skill"),
}


def derived(spark: SparkSession, sf_dir: str, name: str, place: str | None = None) -> DataFrame:
    """A derived relation; ``place`` names a column for the rows' places in the table."""
    source, columns = DERIVED[name]
    if name == "skills":
        both = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
        return both.select(*_expressions(columns))
    at = [tables.place(sf_dir, source).alias(place)] if place else []
    return _table(spark, sf_dir, source).select(*_expressions(columns), *at)


def _expressions(columns: str) -> list:
    out, depth, last = [], 0, 0
    for i, c in enumerate(columns + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(F.expr(columns[last:i].replace("VARCHAR(20)", "STRING")))
            last = i + 1
    return out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read(spark, sf_dir, name, spread=name == "documents")


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n}_syn AS (SELECT {DERIVED[n][1]} FROM {DERIVED[n][0]})" for n in names)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- scalar text, contact and validation ---

_EMAIL = "lower(regexp_extract(substr(text, 1, 600), '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}', 0))"


@query(
    f"""WITH c AS (SELECT doc_id, nullif({_EMAIL}, '') AS email FROM documents)
    SELECT doc_id, email, CASE WHEN email IS NULL THEN 'empty' WHEN regexp_matches(email, '^(test|example|dummy|noreply)@') THEN 'placeholder_email'
      WHEN len(string_split(email, '@')) <> 2 THEN 'missing_at' ELSE 'ok' END AS reason,
      CASE WHEN email IS NULL THEN 0e0 ELSE 25e-2 END AS confidence FROM c"""
)
def contact_slice(spark, sf_dir):
    """First e-mail of every document's top, its verdict and the share of confidence it gives."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 600).alias("top"))
    found = docs.select("doc_id", F.nullif(F.lower(F.regexp_extract("top", R.EMAIL, 0)), F.lit("")).alias("email"))
    return found.select("doc_id", "email", V.email(F.col("email"))["reason"].alias("reason"), F.when(F.col("email").isNull(), 0.0).otherwise(0.25).alias("confidence"))


@query(
    """WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS t FROM documents),
    n AS (SELECT doc_id, t, length(t) AS n, length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) AS a FROM l)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (n > 0 AND ((n <= 3 AND a = 0) OR (n < 10 AND a < n * 0.2))) AS n_noise FROM n GROUP BY doc_id"""
)
def noise_lines(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    noise = F.filter(lines, lambda x: T.is_noise_line(x))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), F.size(noise).cast("bigint").alias("n_noise"))


@query(
    """SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, chr(9), ' '), ' {2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS clean_md5 FROM documents"""
)
def whitespace_normal_form(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_whitespace(F.col("text"))).alias("clean_md5"))


@query(
    """SELECT doc_id, length(translate(text, '“”’–—•', '""''---')) AS n, md5(translate(text, '“”’–—•', '""''---')) AS h FROM documents WHERE NOT regexp_matches(text, '[ﬀﬁﬂﬃﬄæÆœŒ‘‚‛‟„″′«»―−‐‑‣◦▪●○■□ĲĳﬅŌ]')"""
)
def character_maps(spark, sf_dir):
    """Every document by the whole map; the SQL spells six characters and leaves out texts that hold others."""
    docs = _table(spark, sf_dir, "documents")
    made = T.replace_special(F.col("text"))
    return docs.select("doc_id", F.length(made).cast("bigint").alias("n"), F.md5(made).alias("h"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    f AS (SELECT doc_id, t, i, row_number() OVER (PARTITION BY doc_id, lower(t) ORDER BY i) AS rn FROM l WHERE trim(t) <> '')
    SELECT doc_id, count(*) AS n_kept, md5(string_agg(t, chr(10) ORDER BY i)) AS kept_md5 FROM f WHERE rn = 1 GROUP BY doc_id"""
)
def distinct_lines(spark, sf_dir):
    """First place of every line, case aside, in reading order."""
    lines = segment.lines_of(_table(spark, sf_dir, "documents")).where("trim(text) <> ''")
    first = F.row_number().over(W.partitionBy("doc_id", F.lower("text")).orderBy("line_no"))
    kept = lines.withColumn("rn", first).where("rn = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return kept.select("doc_id", "n_kept", F.expr("md5(array_join(transform(l, x -> x.text), '\\n'))").alias("kept_md5"))


@query("SELECT md5(text) AS content_md5, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_copies(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("content_md5"))
    return docs.agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 1) QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def unseen_documents(spark, sf_dir):
    """Duplicate-digest rejection: even ids against odd ones, first of each digest."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("content_md5"))
    fresh = docs.where("doc_id % 2 = 0").groupBy("content_md5").agg(F.min("doc_id").alias("doc_id"))
    return store.new_documents(fresh, docs.where("doc_id % 2 = 1")).select("doc_id")


_LANG = " + ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ws)})))" for ws in L.WORDS.values())


@query(
    "WITH s AS (SELECT doc_id, text, regexp_split_to_array(lower(text), '[^a-zà-ÿ]+') AS w FROM documents), c AS (SELECT doc_id, length(text) AS n, "
    + ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ws)}))) AS {k}" for k, ws in L.WORDS.items())
    + """ FROM s), b AS (SELECT *, greatest(en, de, fr, es) AS top, en + de + fr + es AS total FROM c),
    r AS (SELECT *, n >= 50 AND total > 0 AND round(top / total, 3) >= 0.5 AS sure FROM b)
    SELECT doc_id, CASE WHEN NOT sure THEN 'en' WHEN en = top THEN 'en' WHEN de = top THEN 'de' WHEN fr = top THEN 'fr' ELSE 'es' END AS language, coalesce(sure, false) AS reliable FROM r"""
)
def language(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", L.detect(F.col("text")).alias("l")).select("doc_id", "l.language", "l.reliable")


def _case(index: str, values: list) -> str:
    """SQL of both dialects: the value at an index from 0."""
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}e0" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(CASE {} END)".format(" ".join(f"WHEN {index} = {i} THEN {lit(v)}" for i, v in enumerate(values)))


@query(
    """SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 3 THEN CAST(o_orderdate AS DATE) WHEN 4 THEN CAST(o_orderdate AS DATE) WHEN 5 THEN CAST(date_trunc('year', o_orderdate) AS DATE)
    ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS VARCHAR) AS parsed FROM orders"""
)
def date_points(spark, sf_dir):
    """Every order's date written in one of six ways and read again."""
    ways = ["MMM yyyy", "MMMM yyyy", "MM/yyyy", "yyyy-MM-dd", "MMMM d, yyyy", "yyyy"]
    s = F.coalesce(*[F.when(F.col("o_orderkey") % 6 == i, F.date_format("o_orderdate", w)) for i, w in enumerate(ways)])
    return _table(spark, sf_dir, "orders").select("o_orderkey", D.parse_date(s, AS_OF).cast("string").alias("parsed"))


@query(
    f"""WITH r AS (SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS a, CAST(date_trunc('month', o_orderdate) + to_months(CAST(o_orderkey % 50 AS INT)) AS DATE) AS b FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN strftime(a, '%Y') ELSE strftime(a, '%b %Y') END AS start_date, CASE o_orderkey % 3 WHEN 0 THEN strftime(b, '%b %Y') WHEN 1 THEN strftime(b, '%Y') ELSE 'Present' END AS end_date,
      CASE o_orderkey % 3 WHEN 0 THEN round((o_orderkey % 50) / 12.0e0, 1) WHEN 1 THEN CAST(year(b) - year(a) AS DOUBLE) ELSE round(date_diff('month', a, DATE '{AS_OF}') / 12.0e0, 1) END AS duration_years, o_orderkey % 3 = 2 AS is_current FROM r"""
)
def date_ranges(spark, sf_dir):
    """Every order as a range of months, of years, or up to now, inside a sentence."""
    end = F.expr("add_months(o_orderdate, cast(o_orderkey % 50 AS int))")
    month, year = lambda c: F.date_format(c, "MMM yyyy"), lambda c: F.date_format(c, "yyyy")
    kind = F.col("o_orderkey") % 3
    s = F.when(kind == 0, F.concat(month("o_orderdate"), F.lit(" - "), month(end))).when(kind == 1, F.concat(year("o_orderdate"), F.lit(" – "), year(end))).otherwise(F.concat(month("o_orderdate"), F.lit(" to now")))
    span = D.parse_range(F.concat(F.lit("Firm, "), s, F.lit(" (full time)")), AS_OF)
    return _table(spark, sf_dir, "orders").select("o_orderkey", span.alias("p")).select("o_orderkey", *[F.col(f"p.{k}").alias(k) for k in ("start_date", "end_date", "duration_years", "is_current")])


@query(
    f"""SELECT c_custkey, {_case('c_custkey % 4', ['ok', 'placeholder_email', 'invalid_format', 'empty'])} AS email, {_case('c_custkey % 4', ['ok', 'too_short', 'repeating_digits', 'too_long'])} AS phone,
    {_case('c_custkey % 3', ['ok', 'exceeds_scale', 'not_numeric'])} AS gpa, {_case('c_custkey % 3', ['ok', 'too_short', 'contains_digits'])} AS name, {_case('c_custkey % 3', ['ok', 'missing_scheme', 'no_tld'])} AS url,
    {_case('c_custkey % 3', ['ok', 'too_old', 'too_far_in_future'])} AS date, {_case('c_custkey % 2', ['ok', 'username_too_short'])} AS linkedin, {_case('c_custkey % 2', ['ok', 'too_short'])} AS skill FROM customer"""
)
def validators(spark, sf_dir):
    """Contact values of every customer, good and bad by the key."""
    given = _table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "CASE c_custkey % 4 WHEN 0 THEN concat('User', c_custkey, '@Mail.org') WHEN 1 THEN 'test@mail.org' WHEN 2 THEN concat('user', c_custkey) END email",
        "CASE c_custkey % 4 WHEN 0 THEN concat('+1 505 ', lpad(c_custkey, 7, '0')) WHEN 1 THEN '123' WHEN 2 THEN '1111111111' ELSE '12345678901234567' END phone",
        "CASE c_custkey % 3 WHEN 0 THEN concat('3.', c_custkey % 10, '/4.0') WHEN 1 THEN '4.5/4.0' ELSE 'abc' END gpa",
        "CASE c_custkey % 3 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'A' ELSE concat('R', c_custkey) END name",
        "CASE c_custkey % 3 WHEN 0 THEN concat('www.site.org/', c_custkey) WHEN 1 THEN 'site.org' ELSE 'http://host/x' END url",
        "CASE c_custkey % 3 WHEN 0 THEN 'Mar 2010' WHEN 1 THEN 'Mar 1940' ELSE '2035' END date",
        "CASE c_custkey % 2 WHEN 0 THEN concat('linkedin.com/in/user', c_custkey) ELSE 'linkedin.com/in/a' END linkedin",
        "CASE c_custkey % 2 WHEN 0 THEN 'sql' ELSE 'c' END skill",
    )
    tests = {"email": V.email, "phone": V.phone, "gpa": V.gpa, "name": V.name, "url": V.url, "date": lambda c: V.date(c, AS_OF), "linkedin": V.linkedin, "skill": V.skill}
    return given.select("c_custkey", *[f(F.col(k))["reason"].alias(k) for k, f in tests.items()])


@query("SELECT c_custkey, concat('comprehensive ', c_custkey, chr(10), 'well-', chr(10), 'Known', chr(10), 'ab-', chr(10), 'c') AS joined FROM customer")
def dehyphenated(spark, sf_dir):
    given = F.expr("concat('compre-\nhensive ', c_custkey, '\nwell-\nKnown\na-\nb-\nc')")
    return _table(spark, sf_dir, "customer").select("c_custkey", T.dehyphenate(given).alias("joined"))


_ROLES = ["Software Engineer", "Data Scientist", "DevOps Engineer", "Business Analyst", "UX Designer", "Cloud Architect", "Scrum Master"]
#: Written and normal form of a rank before a title, and its career level.
_RANKS = [("", "", "mid"), ("Senior ", "Senior ", "senior"), ("Jr. ", "Junior ", "junior"), ("Principal ", "Principal ", "lead"), ("VP ", "VP ", "executive")]
_ROLE, _RANK = "p_partkey % 7", "CAST(floor(p_partkey / 7) AS BIGINT) % 5"


@query(f"SELECT concat({_case(_RANK, [r[1] for r in _RANKS])}, {_case(_ROLE, _ROLES)}) AS normalized, {_case(_RANK, [r[2] for r in _RANKS])} AS career_level, 1e0 AS confidence, count(*) AS n FROM part GROUP BY 1, 2")
def titles(spark, sf_dir):
    """A title for each part, normalised once and joined back."""
    given = _table(spark, sf_dir, "part").selectExpr(f"concat({_case(_RANK, [r[0] for r in _RANKS])}, {_case(_ROLE, _ROLES)}) original")
    made = given.join(match.normalize_titles(given, "original"), "original")
    return made.groupBy("normalized", "career_level", "confidence").agg(F.count(F.lit(1)).alias("n"))


_SKILLS = [("Python", "python", 1.0, "exact"), ("k8s", "kubernetes", 0.95, "alias"), ("nodejs", "node.js", 0.95, "alias"), ("scikitlearn", "scikit-learn", 0.92, "normalized"), ("pyton", "python", 0.909, "fuzzy"), ("learning machine", "machine learning", 1.0, "fuzzy"), ("advanced docker swarm ops", "docker", 0.7, "substring"), ("zzz", "zzz", 0.5, "unmatched")]
_SKILL_ROWS = f"SELECT {_case('p_partkey % 8', [x[1] for x in _SKILLS])} AS matched, {_case('p_partkey % 8', [x[2] for x in _SKILLS])} AS score, {_case('p_partkey % 8', [x[3] for x in _SKILLS])} AS method FROM part"


def _matches(spark, sf_dir) -> DataFrame:
    given = _table(spark, sf_dir, "part").selectExpr(f"{_case('p_partkey % 8', [x[0] for x in _SKILLS])} original")
    return given.join(match.match_skills(given, "original"), "original")


@query(f"SELECT matched, score, method, count(*) AS n FROM ({_SKILL_ROWS}) GROUP BY 1, 2, 3")
def skill_ladder(spark, sf_dir):
    """A skill for each part: look-ups, similarity and parts of names."""
    return _matches(spark, sf_dir).groupBy("matched", "score", "method").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS total, round(avg(score), 3) AS average, count(*) FILTER (score >= 0.85) AS high_confidence, count(*) FILTER (score < 0.6) AS low_confidence, count(*) FILTER (method = 'fuzzy') AS fuzzy FROM ({_SKILL_ROWS})")
def method_histogram(spark, sf_dir):
    return match.match_statistics(_matches(spark, sf_dir)).select("total", "average", "high_confidence", "low_confidence", F.col("by_method")["fuzzy"].alias("fuzzy"))


_HEADERS = [("Work Experience", 12.0, True, "experience"), ("Education", 14.0, False, "education"), ("SKILLS 2024", 11.0, False, "skills"), ("Jan 2020 - Present", 14.0, True, None), ("x" * 90, 14.0, True, None), ("Certificates:", 11.0, False, "certifications")]


@query(f"SELECT p_partkey, {_case('p_partkey % 6', [h[3] for h in _HEADERS])} AS section FROM part")
def header_decisions(spark, sf_dir):
    """A block for each part, a header of a section or none."""
    rows = _table(spark, sf_dir, "part").selectExpr("p_partkey", *[f"{_case('p_partkey % 6', [h[i] for h in _HEADERS])} {k}" for i, k in enumerate(("text", "font_size", "is_bold"))])
    return rows.select("p_partkey", segment.header_section(F.col("text"), F.col("font_size"), F.col("is_bold"), F.lit(False)).alias("section"))


# --- relational tier ---


@query(_with("resumes") + " SELECT resume_id, candidate_id FROM resumes_syn ORDER BY uploaded_at DESC, resume_id LIMIT 50 OFFSET 100")
def resumes_page(spark, sf_dir):
    return store.page(derived(spark, sf_dir, "resumes"), "uploaded_at", 100, 50, True, "resume_id").select("resume_id", "candidate_id")


@query(_with("resumes") + " SELECT resume_id, status FROM resumes_syn WHERE status = 'pending' ORDER BY uploaded_at DESC, resume_id LIMIT 100")
def resumes_by_status(spark, sf_dir):
    return store.by_status(derived(spark, sf_dir, "resumes"), "pending").select("resume_id", "status")


@query(_with("resumes") + " SELECT resume_id, retry_count FROM resumes_syn WHERE status = 'failed' AND retry_count < 3")
def failed_for_retry(spark, sf_dir):
    return store.failed_for_retry(derived(spark, sf_dir, "resumes")).select("resume_id", "retry_count")


@query(_with("resumes") + " SELECT count(*) AS n FROM resumes_syn WHERE status = 'completed' AND retry_count = 2")
def filtered_count(spark, sf_dir):
    return store.count(derived(spark, sf_dir, "resumes"), {"status": "completed", "retry_count": 2, "no_such_column": 1})


@query(_with("resumes") + " SELECT status, count(*) AS n, round(avg(confidence), 3) AS avg_confidence, round(avg(seconds), 2) AS avg_seconds FROM resumes_syn GROUP BY status")
def status_statistics(spark, sf_dir):
    return store.statistics(derived(spark, sf_dir, "resumes"))


@query(_with("resumes") + " SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending, round(avg(confidence) FILTER (status = 'completed'), 3) AS avg_confidence FROM resumes_syn")
def service_totals(spark, sf_dir):
    return store.totals(derived(spark, sf_dir, "resumes"))


@query(_with("resumes", "candidates") + " SELECT resume_id, candidate_id, full_name, status FROM resumes_syn LEFT JOIN candidates_syn USING (candidate_id)")
def resumes_with_candidates(spark, sf_dir):
    joined = store.with_candidates(derived(spark, sf_dir, "resumes"), derived(spark, sf_dir, "candidates"))
    return joined.select("resume_id", "candidate_id", "full_name", "status")


@query(_with("candidates") + " SELECT candidate_id, full_name FROM candidates_syn WHERE full_name ILIKE '%#00000001%' ORDER BY full_name, candidate_id LIMIT 20")
def name_search(spark, sf_dir):
    return store.search_by_name(derived(spark, sf_dir, "candidates"), "#00000001").select("candidate_id", "full_name")


@query(
    _with("resumes", "candidates")
    + " SELECT candidate_id FROM candidates_syn WHERE candidate_id IN (SELECT candidate_id FROM resumes_syn WHERE status = 'failed') AND candidate_id NOT IN (SELECT candidate_id FROM resumes_syn WHERE status = 'pending')"
)
def semi_and_anti(spark, sf_dir):
    resumes = derived(spark, sf_dir, "resumes")
    people = derived(spark, sf_dir, "candidates").select("candidate_id")
    kept = people.join(resumes.where("status = 'failed'"), "candidate_id", "left_semi")
    return kept.join(resumes.where("status = 'pending'"), "candidate_id", "left_anti")


@query(
    _with("candidates")
    + """, n AS (SELECT candidate_id + 50 AS candidate_id, max_by(concat('new ', full_name), candidate_id) AS full_name FROM candidates_syn GROUP BY 1)
    SELECT coalesce(c.candidate_id, n.candidate_id) AS candidate_id, coalesce(n.full_name, c.full_name) AS full_name, c.segment AS segment FROM candidates_syn c FULL JOIN n ON n.candidate_id = c.candidate_id"""
)
def upserted_candidates(spark, sf_dir):
    old = derived(spark, sf_dir, "candidates").select("candidate_id", "full_name", "segment")
    new = old.select((F.col("candidate_id") + 50).alias("candidate_id"), F.concat(F.lit("new "), "full_name").alias("full_name"), F.col("candidate_id").alias("version"))
    return store.upsert(old, new, "candidate_id", "version")


@query("SELECT user_id AS resume_id, max_by(CASE event_type WHEN 'error' THEN 'failed' ELSE event_type END, event_id) AS status, count(*) FILTER (event_type = 'error') AS retry_count FROM events GROUP BY 1")
def latest_states(spark, sf_dir):
    log = _table(spark, sf_dir, "events").selectExpr("user_id resume_id", "CASE event_type WHEN 'error' THEN 'failed' ELSE event_type END status", "event_id ts")
    return store.current_status(log)


@query(_with("skills") + " SELECT person_id FROM skills_syn GROUP BY person_id HAVING count(DISTINCT skill) FILTER (skill IN ('ring', 'bolt')) = 2 ORDER BY person_id LIMIT 50")
def with_all_skills(spark, sf_dir):
    people = derived(spark, sf_dir, "skills").groupBy("person_id").agg(F.collect_set("skill").alias("skills_normalized"))
    return store.with_all_skills(people.withColumnRenamed("person_id", "candidate_id"), ["ring", "bolt"]).select(F.col("candidate_id").alias("person_id"))


@query(
    _with("skills")
    + """, f AS (SELECT *, row_number() OVER (PARTITION BY person_id, lower(skill) ORDER BY pos) AS rn FROM skills_syn)
    SELECT person_id, string_agg(skill, ',' ORDER BY pos, skill) AS skills FROM f WHERE rn = 1 GROUP BY person_id"""
)
def ordered_distinct_skills(spark, sf_dir):
    lists = derived(spark, sf_dir, "skills").groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("pos", "skill"))).alias("s"))
    return lists.select("person_id", F.array_join(T.distinct_ignoring_case(F.expr("transform(s, x -> x.skill)")), ",").alias("skills"))


@query(_with("skills") + " SELECT person_id, max(CASE skill WHEN 'ring' THEN '✓' END) AS ring, max(CASE skill WHEN 'bolt' THEN '✓' END) AS bolt, max(CASE skill WHEN 'gear' THEN '✓' END) AS gear FROM skills_syn GROUP BY person_id")
def skills_matrix(spark, sf_dir):
    return sinks.skills_matrix(derived(spark, sf_dir, "skills"), columns=["ring", "bolt", "gear"])


@query(_with("resumes") + " SELECT CAST(date_trunc('month', uploaded_at) AS DATE) AS day, status, count(*) AS n FROM resumes_syn WHERE CAST(uploaded_at AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY GROUPING SETS ((1, 2), (1))")
def uploads_between(spark, sf_dir):
    rows = derived(spark, sf_dir, "resumes").where("uploaded_at >= timestamp '1995-01-01' AND uploaded_at < timestamp '1997-01-01'")
    rows = rows.select(F.trunc("uploaded_at", "month").alias("day"), "status")
    both = rows.groupBy("day", "status").agg(F.count(F.lit(1)).alias("n"))
    return both.unionByName(both.groupBy("day").agg(F.sum("n").alias("n")).withColumn("status", F.lit(None).cast("string")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def set_operations(spark, sf_dir):
    a, b = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).subtract(_table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("k")))


# --- intervals, windows and sessions ---


@query(
    _with("jobs")
    + """, o AS (SELECT *, max(end_date) OVER (PARTITION BY person_id ORDER BY start_date, end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM jobs_syn),
    i AS (SELECT *, sum(CASE WHEN before IS NULL OR start_date > before THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY start_date, end_date ROWS UNBOUNDED PRECEDING) AS island FROM o),
    s AS (SELECT person_id, island, min(start_date) AS a, max(end_date) AS b FROM i GROUP BY 1, 2)
    SELECT person_id, round(sum(date_diff('day', a, b)) / 365.25, 1) AS total_years FROM s GROUP BY 1"""
)
def merged_experience(spark, sf_dir):
    return D.merged_years(derived(spark, sf_dir, "jobs"), "person_id", "start_date", "end_date", AS_OF)


@query(_with("jobs") + " SELECT person_id, round(sum(date_diff('day', start_date, end_date)) / 365.25, 1) AS years FROM jobs_syn GROUP BY 1")
def summed_experience(spark, sf_dir):
    return derived(spark, sf_dir, "jobs").groupBy("person_id").agg(F.round(F.sum(F.datediff("end_date", "start_date")) / 365.25, 1).alias("years"))


@query(_with("steps") + " SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS section FROM steps_syn")
def carried_sections(spark, sf_dir):
    """Carry-forward of the latest header, by user."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(w)
    return derived(spark, sf_dir, "steps").select("event_id", F.coalesce(last, F.lit(-1)).alias("section"))


@query(
    _with("steps")
    + """, e AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS entry FROM steps_syn)
    SELECT user_id, CAST(entry AS BIGINT) AS entry, count(*) AS n, string_agg(event_type, ',' ORDER BY ts, event_id) AS parts FROM e GROUP BY 1, 2"""
)
def entry_sessions(spark, sf_dir):
    rows = segment.sessions(derived(spark, sf_dir, "steps"), "user_id", ["ts", "event_id"], "event_type = 'error'")
    made = rows.groupBy("user_id", "entry").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("p"))
    return made.select("user_id", "entry", "n", F.expr("array_join(transform(p, x -> x.event_type), ',')").alias("parts"))


@query(_with("steps") + " SELECT event_id, first_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead FROM steps_syn")
def look_ahead(spark, sf_dir):
    rows = derived(spark, sf_dir, "steps").withColumn("text", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(""))
    return segment.next_filled(rows, "user_id", ["ts", "event_id"]).select("event_id", "ahead")


@query("SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_counts(spark, sf_dir):
    return ingest.windowed_counts(_table(spark, sf_dir, "events"), "ts", "event_type")


@query(
    """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def activity_sessions(spark, sf_dir):
    return ingest.sessions(_table(spark, sf_dir, "events"), "ts", "user_id")


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, round(sum(value), 2) AS total FROM events GROUP BY 1")
def drained_stream(spark, sf_dir):
    """A file stream drained through deduplication; what comes out has the table's rows, once, with their values."""
    from ..sources import streams

    rows = streams.drain_table(spark, sf_dir, "events.parquet", "event_id")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"), F.round(F.sum("value"), 2).alias("total"))


# --- layout ---

_TYPED = (
    _with("blocks")
    + """, h AS (SELECT doc_id, avg(CASE WHEN x0 / 600 < 0.45 THEN 1 ELSE 0 END) AS l, avg(CASE WHEN x0 / 600 > 0.55 THEN 1 ELSE 0 END) AS r,
      min(CASE WHEN x0 / 600 > 0.55 THEN x0 END) AS e, avg(CASE WHEN x0 > 390 THEN 1 ELSE 0 END) AS fr, avg(CASE WHEN x0 < 30 THEN 1 ELSE 0 END) AS fl, max(CASE WHEN x0 > 210 THEN 1 ELSE 0 END) AS m FROM blocks_syn GROUP BY 1),
    g AS (SELECT doc_id, b, count(x0) AS n FROM (SELECT DISTINCT doc_id FROM blocks_syn) CROSS JOIN range(4, 16) t(b) LEFT JOIN blocks_syn USING (doc_id)
      WHERE x0 IS NULL OR true GROUP BY doc_id, b),
    c AS (SELECT d.doc_id, t.b, count(s.x0) AS n FROM (SELECT DISTINCT doc_id FROM blocks_syn) d CROSS JOIN range(4, 16) t(b) LEFT JOIN blocks_syn s ON s.doc_id = d.doc_id AND least(CAST(floor(s.x0 * 20 / 600) AS INT), 19) = t.b GROUP BY 1, 2),
    k AS (SELECT doc_id, min_by(b, n * 100 + b) AS gap FROM c GROUP BY 1),
    typed AS (SELECT doc_id, CASE WHEN NOT (l > 0.2 AND r > 0.2) THEN 'single_column' WHEN (600 - e) / 600 < 0.35 THEN 'sidebar' ELSE 'two_column' END AS layout_type,
      CASE WHEN l > 0.2 AND r > 0.2 THEN (gap + 0.5) * 600 / 20 ELSE 300 END AS column_boundary, fr > 0.15 OR (fl > 0.10 AND m = 1) AS has_sidebar FROM h JOIN k USING (doc_id))"""
).replace(
    """g AS (SELECT doc_id, b, count(x0) AS n FROM (SELECT DISTINCT doc_id FROM blocks_syn) CROSS JOIN range(4, 16) t(b) LEFT JOIN blocks_syn USING (doc_id)
      WHERE x0 IS NULL OR true GROUP BY doc_id, b),
    """,
    "",
)


@query(_TYPED + " SELECT doc_id, layout_type, CAST(column_boundary AS DOUBLE) AS column_boundary, has_sidebar FROM typed")
def layout_types(spark, sf_dir):
    return layout.layout_type(derived(spark, sf_dir, "blocks"), WIDTH)


@query(
    _TYPED
    + """, p AS (SELECT *, CASE WHEN column_boundary < 240 THEN x0 < column_boundary ELSE x0 >= column_boundary END AND layout_type = 'sidebar' AS side,
      max(CASE WHEN x1 - x0 > 0.8 * column_boundary THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_num) = 1 AS any_full FROM blocks_syn JOIN typed USING (doc_id))
    SELECT doc_id, block_seq, CASE WHEN x1 - x0 > 420 THEN 'full' WHEN x0 < 0.9 * column_boundary THEN 'left' ELSE 'right' END AS layout_column,
      CASE WHEN side THEN 'sidebar' WHEN y0 < 160 THEN 'header' WHEN y0 > 720 THEN 'footer' ELSE 'body' END AS zone,
      row_number() OVER (PARTITION BY doc_id ORDER BY page_num, CASE WHEN layout_type = 'sidebar' THEN CAST(side AS INT) WHEN layout_type = 'two_column' AND NOT any_full THEN CAST(x0 >= column_boundary AS INT) ELSE 0 END, y0, x0, block_seq, text) AS reading_rank
    FROM p"""
)
def reading_order(spark, sf_dir):
    blocks = derived(spark, sf_dir, "blocks")
    placed = layout.place(blocks, layout.layout_type(blocks, WIDTH), WIDTH, HEIGHT)
    return placed.select("doc_id", "block_seq", "layout_column", "zone", F.col("reading_rank").cast("bigint").alias("reading_rank"))


@query(
    _with("blocks")
    + """, t AS (SELECT *, CASE WHEN x0 < 270 THEN 'left' WHEN x0 > 330 THEN 'right' ELSE 'full' END AS tag FROM blocks_syn)
    SELECT doc_id, block_seq, tag AS column_tag, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY round_even(y0 / 15, 0), tag, x0, block_seq) AS page_rank,
      CAST((page_num - 1) * 100000 + floor(y0 / 10) * 10 + CASE WHEN tag = 'right' THEN 1 ELSE 0 END AS BIGINT) AS weight FROM t"""
)
def page_order(spark, sf_dir):
    tagged = layout.reading_weight(layout.page_order(layout.column_tags(derived(spark, sf_dir, "blocks", "place"), WIDTH), place="place"))
    return tagged.select("doc_id", "block_seq", "column_tag", F.col("page_rank").cast("bigint").alias("page_rank"), "weight")


@query(
    _with("blocks")
    + """, s AS (SELECT doc_id, font_size AS size, count(*) AS n, min(block_seq) AS pos FROM blocks_syn GROUP BY 1, 2)
    SELECT doc_id, max_by(size, n * 1000 - pos + size / 1000) AS dominant FROM s GROUP BY 1"""
)
def dominant_fonts(spark, sf_dir):
    return segment.dominant_font(derived(spark, sf_dir, "blocks"))


@query(_with("blocks") + " SELECT doc_id, avg(CASE WHEN x0 < 120 THEN 1 ELSE 0 END) > 0.15 AND avg(CASE WHEN x0 > 180 THEN 1 ELSE 0 END) > 0.15 AS multicolumn FROM blocks_syn GROUP BY 1")
def multicolumn(spark, sf_dir):
    return layout.is_multicolumn(derived(spark, sf_dir, "blocks"), WIDTH)


@query(
    _with("blocks")
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(text) ORDER BY block_seq) AS rn FROM blocks_syn)
    SELECT doc_id, string_agg(text, '|' ORDER BY block_seq, text) AS texts FROM k WHERE rn = 1 GROUP BY 1"""
)
def read_through(spark, sf_dir):
    kept = layout.read_through(derived(spark, sf_dir, "blocks"), "block_seq").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_seq", "text"))).alias("b"))
    return kept.select("doc_id", F.expr("array_join(transform(b, x -> x.text), '|')").alias("texts"))


@query(
    """WITH p AS (SELECT doc_id, k, substr(text, k * 2000 + 1, 2000) AS t FROM (SELECT doc_id, text, unnest(range(0, length(text) // 2000 + 1)) AS k FROM documents WHERE text IS NOT NULL)),
    f AS (SELECT doc_id, count(*) AS page_count, count(*) FILTER (length(t) < 50 AND k % 2 = 1) AS s, round(avg(length(t)), 1) AS c, bool_or(length(t) - length(replace(t, 'e', '')) >= 100) AS has_tables FROM p GROUP BY 1)
    SELECT doc_id, page_count, CASE WHEN s = 0 THEN 'digital' WHEN s = page_count THEN 'scanned' ELSE 'mixed' END AS pdf_type, c AS avg_chars, has_tables FROM f"""
)
def pdf_types(spark, sf_dir):
    """Pages of 2,000 characters of every document: their text counts, odd ones are full of images, letters stand for drawings."""
    pages = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", F.explode(F.expr("sequence(0, char_length(text) DIV 2000)")).alias("k"))
    pages = pages.selectExpr("doc_id", "k", "substring(text, cast(k * 2000 + 1 AS int), 2000) t")
    facts = pages.selectExpr("doc_id", "char_length(t) text_chars", "CASE WHEN k % 2 = 1 THEN 0.9D ELSE 0D END image_share", "(char_length(t) - char_length(replace(t, 'e', ''))) DIV 10 drawings")
    return layout.pdf_type(facts).select("doc_id", "page_count", "pdf_type", "avg_chars", "has_tables")


# --- records: no SQL says these ---

_RESUME = "concat('PROFILE\\n', text, '\\n\\nSKILLS\\nTools: Python, k8s, ', source, '\\n\\nWORK EXPERIENCE\\nData Engineer | Firm ', doc_id % 7, '\\nJan 2018 - Mar 2021\\n- built things')"


@query()
def records(spark, sf_dir):
    """Typed, scored records of résumé-shaped texts made from the documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_RESUME).alias("text"))
    made = store.stored(record.extract(docs, AS_OF), "records")
    scored = score.completeness(score.confidence(made))
    return scored.select("doc_id", F.to_json("record").alias("record"), "confidence.overall", "confidence.level", F.col("completeness.score").alias("complete"))


from . import resumes as _resumes  # noqa: E402, F401  (registers its queries)
from . import texts as _texts  # noqa: E402, F401

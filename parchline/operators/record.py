"""From plain texts to typed records: contact, summary, entries, skills, languages; one nested column.

Stages. A document's lines are segmented and cut into entries by windows; every entry is one row, parsed once. What is
read from the whole text (contact, mined skills, the top's paragraph) is computed before any exchange, so texts
are not shuffled beside their lines. One exchange by doc_id serves segmentation, entries and assembly. Parsed entries are
written to the shared folder; distinct skills and titles then go through their similarity ladders and are joined
back, and one aggregation by doc_id assembles the record.

Defined results. A bad entry yields nulls, never a lost document. Null texts count as empty. Rows that share a doc_id count as
one document; a null id is an id of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dims import COUNTRIES, DEGREE_NAMES, DEGREE_RANK, FIELDS_OF_STUDY, ISSUERS
from ..functions import regexes as R
from ..functions import text as T
from ..functions.dates import let, normalize_date, parse_range
from .match import _map, categorize, group_related, is_valid_skill, match_skills, mine_skills, normalize_titles, parse_skill_lines
from .segment import segment_text
from .store import stored


def _nz(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def contact(text: Column, lines: Column) -> Column:
    """Contact struct of a text's first 600 characters; the name is the first line of two to four capitalised words."""
    return let(F.substring(text, 1, 600), lambda top: let(F.lower(top), lambda low: _contact(top, low, lines)))


def _contact(top: Column, low: Column, lines: Column) -> Column:
    mailed = F.contains(top, F.lit("@"))
    mail = F.when(mailed, F.lower(_nz(F.regexp_extract(top, R.EMAIL, 0))))
    raw_phone = F.regexp_replace(F.regexp_extract(F.when(mailed, F.regexp_replace(top, R.EMAIL, " ")).otherwise(top), R.PHONE, 0), r"[^\d+\-() ]", "")
    phone = let(raw_phone, lambda x: F.when(F.length(F.regexp_replace(x, r"\D", "")) >= 7, F.trim(x)))
    account = lambda pattern, loose: F.when(F.contains(low, F.lit(loose)), F.coalesce(_nz(F.regexp_extract(top, pattern, 1)), _nz(F.regexp_extract(top, rf"(?i)\b{loose}[:\s/]+([a-zA-Z0-9\-_%]{{3,}})", 1))))
    link = F.concat(F.lit("https://linkedin.com/in/"), account(R.LINKEDIN, "linkedin"))
    hub = F.concat(F.lit("https://github.com/"), account(R.GITHUB, "github"))
    urls = F.filter(F.regexp_extract_all(top, F.lit(R.WEBSITE), F.lit(0)), lambda u: ~u.rlike(r"(?i)linkedin|github|facebook|twitter|instagram|youtube"))
    site = F.get(F.transform(urls, lambda u: F.when(u.rlike("(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u))), F.lit(0))
    site = F.when(F.contains(low, F.lit("://")) | F.contains(low, F.lit("www.")), site)
    place = F.get(F.filter(F.split(top, "\n"), lambda x: ~x.contains("@") & x.rlike(r"^[A-Z][A-Za-z .'-]+,\s*[A-Za-z .]+(?:,\s*[A-Za-z .]+)?(?:\s+\d{5}(?:-\d{4})?)?$")), F.lit(0))
    split = let(place, lambda p: F.split(F.regexp_replace(p, r"\s+\d{5}(?:-\d{4})?$", ""), r"\s*,\s*"))
    located = let(split, lambda parts: F.struct(F.get(parts, F.lit(0)).alias("city"), F.when(F.lower(F.element_at(parts, -1)).isin(COUNTRIES), F.element_at(parts, -1)).alias("country")))
    address = _nz(F.regexp_extract(top, r"(?im)\b(\d{1,5}\s+[A-Za-z0-9 .]+(?:street|st|avenue|ave|road|rd|lane|ln|drive|dr|boulevard|blvd)\b\.?[^\n]*)", 1))
    made = lambda p: F.struct(
        full_name(lines).alias("full_name"),
        mail.alias("email"),
        phone.alias("phone"),
        link.alias("linkedin"),
        hub.alias("github"),
        site.alias("website"),
        address.alias("address"),
        p["city"].alias("city"),
        p["country"].alias("country"),
    )
    return let(located, made)


def full_name(lines: Column) -> Column:
    fits = F.filter(
        F.slice(F.filter(lines, lambda x: F.trim(x) != ""), 1, 5),
        lambda x: F.regexp_replace(x, r"(?i)^(?:dr|mr|mrs|ms|prof)\.?\s+", "").rlike(r"^[A-Z][\p{L}.'-]*(?:\s+[A-Z][\p{L}.'-]*){1,3}(?:,.*)?\s*$"),
    )
    plain = F.regexp_replace(F.get(fits, F.lit(0)), r"(?i)^(?:dr|mr|mrs|ms|prof)\.?\s+", "")
    return _nz(F.regexp_replace(plain, r",?\s*(?i:ph\.?d\.?|mba|m\.?sc\.?|b\.?sc\.?|md|pmp|cpa|esq)\.?\s*$", ""))


def contact_confidence(c: Column) -> Column:
    weights = {"full_name": 0.30, "email": 0.25, "phone": 0.20, "linkedin": 0.10, "city": 0.10, "country": 0.05}
    total = F.lit(0.0)
    for k, w in weights.items():
        total = total + F.when(c[k].isNotNull(), w).otherwise(0.0)
    return F.round(total, 2)


def summary(lines: Column) -> Column:
    """Prose lines of the section as one text of 30 to 1500 characters."""
    kept = F.filter(lines, lambda x: (F.length(F.trim(x)) >= 10) & ~T.has_email(x))
    return _cut(F.array_join(F.transform(kept, lambda x: F.trim(x)), " "))


def top_paragraph(lines: Column) -> Column:
    """A summary without a heading: the paragraph that begins with a line of eight words or more and no contact data, in the first 40 lines and above the first one in capitals."""
    prose = lambda x: (F.size(F.split(F.trim(x), r"\s+")) >= 8) & ~x.rlike(r"(?i)@|https?://|www\.|linkedin")

    def body(p: Column) -> Column:
        rest = F.slice(p["first"], p["begin"].cast("int"), F.lit(40))
        paragraph = lambda xs: F.slice(xs, F.lit(1), let(F.array_position(F.transform(xs, lambda x: F.trim(x) == ""), True), lambda n: F.when(n > 0, n - 1).otherwise(40)).cast("int"))
        return F.when(p["begin"] > 0, _cut(F.array_join(F.transform(let(rest, paragraph), lambda x: F.trim(x)), " ")))

    upper = F.slice(lines, 1, 40)
    above = let(upper, lambda xs: let(F.array_position(F.transform(xs, lambda x: T.is_all_caps(x)), True), lambda n: F.slice(xs, F.lit(1), F.when(n > 0, n - 1).otherwise(40).cast("int"))))
    placed = let(above, lambda first: F.struct(first.alias("first"), F.array_position(F.transform(first, prose), True).alias("begin")))
    return let(placed, body)


def _cut(whole: Column) -> Column:
    """30 to 1500 characters, cut at a word."""
    cut = F.when(F.length(whole) > 1500, F.concat(F.regexp_replace(F.left(whole, F.lit(1497)), r"\s+\S*$", ""), F.lit("..."))).otherwise(whole)
    return F.when(F.length(cut) >= 30, cut)


def _is_bullet(x: Column) -> Column:
    return x.rlike(R.BULLET_POINT)


def _dated(x: Column) -> Column:
    return T.has_date_range(x)


def _words(x: Column) -> Column:
    return F.size(F.split(F.trim(x), r"\s+"))


_PROJECT_FACTS = r"(?i)^\s*(?:technolog|tech stack|tools|built with|https?:|www)"
_CERT_NAMES = r"(?i)\b(?:certified|certification|certificate|license|accreditation|credential|professional|associate|practitioner|specialist|expert|foundation)\b"


def entry_rows(lines: DataFrame) -> DataFrame:
    """doc_id, section, entry, lines: filled lines of every section, those of jobs, degrees, certificates and projects cut into entries.

    A heading begins an entry when the entry before it is filled, that is, when a mark (a bullet, a date, a degree) stands in it.
    That entry's marks are those since the last heading, as a heading begins no entry only where no mark stands before it. So running maxima of the
    places of headings and marks decide, in one window.
    """
    t = F.col("text")
    by = lambda jobs, degrees, certificates, projects: F.when(F.col("section") == "experience", jobs).when(F.col("section") == "education", degrees).when(F.col("section") == "certifications", certificates).when(F.col("section") == "projects", projects)
    degree, bullet = t.rlike(R.DEGREE), _is_bullet(t)
    job = ~bullet & (_words(t) <= 12) & (t.rlike(R.TITLE_WORD) | t.rlike(r"\s[|@—–·•]\s")) & ~T.without_date_range(t).rlike(r"^\W*$")
    certificate = (t.rlike(_CERT_NAMES) | t.rlike(R.CERT_ABBREVIATIONS)) & ~t.rlike(r"(?i)^\s*(?:credential|license|expires?|issued|valid)\b")
    project = ~bullet & ~t.rlike(_PROJECT_FACTS) & (_words(t) <= 8)
    given = lines.where("trim(text) <> ''").withColumns(
        {
            "heading": F.coalesce(by(job, ~bullet & degree, certificate, project), F.lit(False)),
            "mark": F.coalesce(by(bullet | _dated(t), degree, F.lit(True), bullet | (_words(t) > 8) | t.rlike("(?i)technolog|https?:")), F.lit(False)),
        }
    )
    order = W.partitionBy("doc_id", "section").orderBy("line_no")
    before, so_far = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    placed = given.withColumn("n", F.row_number().over(order))
    placed = placed.withColumns(
        {
            "last_heading": F.max(F.when(F.col("heading") | (F.col("n") == 1), F.col("n"))).over(before),
            "last_mark": F.max(F.when(F.col("mark"), F.col("n"))).over(before),
        }
    )
    begins = F.expr("CASE WHEN n = 1 OR (heading AND last_mark >= last_heading) THEN 1 ELSE 0 END")
    numbered = placed.withColumn("entry", F.sum(begins).over(so_far))
    grouped = numbered.groupBy("doc_id", "section", "entry").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return grouped.select("doc_id", "section", "entry", F.expr("transform(l, x -> x.text)").alias("lines"))


def _period(e: Column) -> Column:
    """The text of an entry's period: its first date range, else a line's first two years, else a year and a word for the present."""
    years = lambda x: F.regexp_extract_all(x, F.lit(R.YEAR), F.lit(0))
    pairs = F.filter(F.transform(e, years), lambda y: F.size(y) >= 2)
    open_end = F.filter(e, lambda x: x.rlike(R.YEAR) & x.rlike(rf"(?i)\b{R.PRESENT}\b"))
    pair = let(F.get(pairs, F.lit(0)), lambda y: F.concat(F.get(y, F.lit(0)), F.lit(" - "), F.get(y, F.lit(1))))
    since = F.concat(F.get(years(F.get(open_end, F.lit(0))), F.lit(0)), F.lit(" - Present"))
    return F.coalesce(F.get(F.filter(e, _dated), F.lit(0)), pair, since)


def looks_like_company(x: Column) -> Column:
    """A legal suffix, or six words or less of which six tenths begin with a capital."""
    words = F.split(F.trim(x), r"\s+")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^[A-Z]")))
    return x.rlike(R.COMPANY_SUFFIX) | ((F.size(words) <= 6) & (capital >= 0.6 * F.size(words)))


def job(e: Column, as_of: str) -> Column:
    """A job of an entry's lines. A line with only a date range belongs to the heading before it."""
    def body(p: Column) -> Column:
        span, parts = p["span"], p["parts"]
        other = F.filter(F.slice(e, 2, 3), lambda y: ~_is_bullet(y) & ~_dated(y) & looks_like_company(y))
        points = F.transform(F.filter(F.slice(e, F.lit(2), F.size(e)), _is_bullet), lambda y: F.trim(F.regexp_replace(y, R.BULLET_POINT, "")))
        prose = F.filter(F.slice(e, F.lit(2), F.size(e)), lambda y: ~_is_bullet(y) & ~_dated(y) & (_words(y) > 5))
        return F.struct(
            _nz(F.get(parts, F.lit(0))).alias("job_title"),
            F.coalesce(_nz(F.get(parts, F.lit(1))), _nz(F.get(other, F.lit(0)))).alias("company"),
            _nz(F.get(parts, F.lit(2))).alias("location"),
            span["start_date"].alias("start_date"),
            span["end_date"].alias("end_date"),
            span["duration_years"].alias("duration_years"),
            F.coalesce(span["is_current"], F.lit(False)).alias("is_current"),
            _nz(F.array_join(prose, " ")).alias("description"),
            points.alias("responsibilities"),
            span["start"].alias("start"),
            span["end"].alias("end"),
        )

    plain = F.trim(F.regexp_replace(T.without_date_range(F.get(e, F.lit(0))), r"[(),|\s]+$", ""))
    parts = F.transform(F.split(plain, r"\s*[|@—–·•]\s*|\s+-\s+|\s+at\s+|,\s+"), lambda p: F.trim(p))
    return let(F.struct(parse_range(_period(e), as_of).alias("span"), parts.alias("parts")), body)


def degree_name(c: Column) -> Column:
    """Full name of an abbreviated degree, else title case."""
    key = F.regexp_replace(F.lower(F.trim(c)), r"\.$", "")
    return F.coalesce(F.try_element_at(_map(DEGREE_NAMES), key), T.title_case(F.trim(c)))


def degree_rank(c: Column) -> Column:
    out = F.lit(-1)
    for k, rank in reversed(DEGREE_RANK.items()):
        out = F.when(F.lower(F.regexp_replace(c, r"\.", "")).rlike(rf"\b{k}"), F.lit(rank)).otherwise(out)
    return out


def field_of_study(c: Column) -> Column:
    named = F.coalesce(_nz(F.regexp_extract(c, r"(?i)\b(?:in|of)\s+([A-Z][A-Za-z &]+?)(?:,|\(|\||-|$)", 1)), _nz(F.regexp_extract(c, r"\(([A-Z][A-Za-z &]+)\)", 1)))
    listed = let(F.lower(c), lambda low: F.get(F.filter(F.array(*[F.lit(f) for f in FIELDS_OF_STUDY]), lambda f: F.contains(low, f)), F.lit(0)))
    return F.coalesce(T.title_case(listed), named)


def degree(e: Column, as_of: str) -> Column:
    def body(p: Column) -> Column:
        whole, line, span = p["whole"], p["line"], p["span"]
        score, scale = F.regexp_extract(whole, R.GPA, 1), F.regexp_extract(whole, R.GPA, 2)
        school = F.get(F.filter(e, lambda x: x.rlike(R.INSTITUTION)), F.lit(0))
        return F.struct(
            degree_name(_nz(F.regexp_extract(line, R.DEGREE, 1))).alias("degree"),
            field_of_study(line).alias("field_of_study"),
            _nz(F.regexp_replace(F.regexp_replace(F.get(F.filter(F.split(school, r"\s*[|,]\s*"), lambda x: x.rlike(R.INSTITUTION)), F.lit(0)), R.YEAR, ""), r"[-–\s]+$", "")).alias("institution"),
            F.lit(None).cast("string").alias("location"),
            span["start_date"].alias("start_date"),
            F.coalesce(span["end_date"], _nz(F.regexp_extract(whole, R.YEAR, 0))).alias("graduation_date"),
            F.when(score != "", F.concat_ws("/", score, _nz(scale))).alias("gpa"),
        )

    whole = F.array_join(e, "\n")
    line = F.get(F.filter(e, lambda x: x.rlike(R.DEGREE)), F.lit(0))
    return let(F.struct(whole.alias("whole"), line.alias("line"), parse_range(whole, as_of).alias("span")), body)


def certificate(e: Column, as_of: str) -> Column:
    def body(p: Column) -> Column:
        whole, bare = p["whole"], p["bare"]
        when = _nz(F.regexp_extract(whole, rf"(?i)({R.MONTH}[\s.,]*(?:19|20)\d{{2}}|{R.YEAR})", 1))
        issuer = let(F.lower(whole), lambda low: F.get(F.filter(F.array(*[F.lit(i) for i in ISSUERS]), lambda i: F.contains(low, i)), F.lit(0)))
        return F.struct(
            _nz(F.regexp_replace(F.regexp_replace(bare, rf"(?i)[\s(,|-]*(?:{R.MONTH}[\s.,]*)?(?:19|20)\d{{2}}\)?.*$", ""), r"\s*[|–—-]\s*[^|–—-]*$", "")).alias("name"),
            T.title_case(issuer).alias("issuer"),
            normalize_date(when, as_of).alias("date"),
            _nz(F.regexp_extract(whole, r"(?i)(?:expires?|valid until|expiry)[:\s]+([A-Za-z]*\s*\d{4})", 1)).alias("expiry_date"),
            _nz(F.regexp_extract(whole, r"(?i)(?:credential|license|certificate)\s*(?:id|no|number|#)[:\s#]*([A-Za-z0-9-]+)", 1)).alias("credential_id"),
        )

    return let(F.struct(F.array_join(e, "\n").alias("whole"), F.regexp_replace(F.get(e, F.lit(0)), R.BULLET_POINT, "").alias("bare")), body)


def project(e: Column, as_of: str) -> Column:
    def body(p: Column) -> Column:
        whole, span = p["whole"], p["span"]
        label = F.regexp_extract(whole, r"(?im)(?:technologies|tech stack|tools|built with|stack)\s*[:\-]\s*(.+)$", 1)
        tech = F.filter(F.split(label, r"\s*[,;|]\s*"), lambda x: F.trim(x) != "")
        about = F.filter(F.slice(e, F.lit(2), F.size(e)), lambda y: ~y.rlike(_PROJECT_FACTS) & ~_dated(y))
        return F.struct(
            _nz(F.regexp_replace(F.regexp_replace(F.get(e, F.lit(0)), R.DATE_RANGE, ""), r"\s+[-–—|]\s+.*$", "")).alias("name"),
            _nz(F.array_join(F.transform(about, lambda y: F.trim(F.regexp_replace(y, R.BULLET_POINT, ""))), " ")).alias("description"),
            T.distinct_ignoring_case(F.concat(tech, mine_skills(whole))).alias("technologies"),
            _nz(F.regexp_extract(whole, R.WEBSITE, 0)).alias("url"),
            span["start_date"].alias("start_date"),
            span["end_date"].alias("end_date"),
        )

    whole = F.array_join(e, "\n")
    return let(F.struct(whole.alias("whole"), parse_range(whole, as_of).alias("span")), body)


def languages(lines: Column) -> Column:
    parts = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, R.BULLET_POINT, ""), r"\s*[,;|]\s*")))
    made = F.transform(
        F.filter(parts, lambda x: x.rlike(r"^\s*[A-Z][a-z]+")),
        lambda x: F.struct(F.regexp_extract(x, r"^\s*([A-Z][a-z]+)", 1).alias("language"), _nz(F.regexp_extract(x, r"[(:\-–]\s*([A-Za-z ]+)\)?", 1)).alias("proficiency")),
    )
    return made


def parsed_rows(docs: DataFrame, as_of: str, text: str = "text") -> DataFrame:
    """doc_id, section, entry and what the entry's section gives: job, degree, certificate, project; summary, listed skills, languages; sections' lines count."""
    given = docs.select("doc_id", F.coalesce(T.normalize_whitespace(F.col(text)), F.lit("")).alias("text"))
    rows = entry_rows(segment_text(given))
    e, section = F.col("lines"), F.col("section")
    jobs, degrees, certs = F.when(section == "experience", job(e, as_of)), F.when(section == "education", degree(e, as_of)), F.when(section == "certifications", certificate(e, as_of))
    return rows.select(
        "doc_id",
        "section",
        "entry",
        jobs.alias("job"),
        degrees.alias("degree"),
        certs.alias("certificate"),
        F.when(section == "projects", project(e, as_of)).alias("project"),
        F.when(section == "summary", summary(e)).alias("summary"),
        F.when(section == "skills", F.filter(parse_skill_lines(e), is_valid_skill)).alias("listed"),
        F.when(section == "languages", languages(e)).alias("languages"),
    )


def matched_lists(lists: DataFrame, key: str, items: str, threshold: float = 80, least: float = 0.60) -> DataFrame:
    """key, matched: every list's elements by the match ladder, in order, distinct; those under ``least`` go.

    Only distinct elements are compared; the join back has one row for each of them.
    """
    each = lists.select(key, F.posexplode(items).alias("pos", "original"))
    found = match_skills(each, "original", threshold).where(F.col("score") >= least).select("original", "matched")
    back = each.join(found, "original").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "matched"))).alias("m"))
    return back.select(key, F.expr("array_distinct(transform(m, x -> x.matched))").alias("matched"))


def skill_struct(every: Column) -> Column:
    """Skills by category; frameworks also hold the front-end and back-end groups."""
    none = F.array().cast("array<string>")

    def body(p: Column) -> Column:
        of = lambda k: F.coalesce(F.try_element_at(p["by"], F.lit(k)), none)
        group = lambda k: F.coalesce(F.try_element_at(p["groups"], F.lit(k)), none)
        return F.struct(
            of("programming_languages").alias("technical"),
            of("soft_skills").alias("soft"),
            of("tools").alias("tools"),
            F.array_union(of("frameworks"), F.array_union(group("frontend"), group("backend"))).alias("frameworks"),
            of("databases").alias("databases"),
            none.alias("languages"),
            p["all"].alias("all"),
        )

    return let(every, lambda xs: let(F.struct(categorize(xs).alias("by"), group_related(xs).alias("groups"), xs.alias("all")), body))


def normalized_titles(rows: DataFrame, least: float = 0.65) -> DataFrame:
    """``rows`` with the job titles that are known with confidence ``least`` in their normal form; only distinct titles are compared."""
    titles = normalize_titles(rows.select(F.col("job.job_title").alias("title")), "title").where(F.col("confidence") >= least)
    titles = titles.select(F.col("original").alias("title"), F.col("normalized"))
    joined = rows.withColumn("title", F.col("job.job_title")).join(titles, "title", "left")
    known = F.when(F.col("job").isNotNull(), F.col("job").withField("job_title", F.coalesce("normalized", "title")))
    return joined.withColumn("job", known).drop("title", "normalized")


def total_years(jobs: Column, as_of: str) -> Column:
    """Years covered by the jobs of one record, overlaps once: a fold over the intervals by start."""
    spans = F.filter(
        F.transform(jobs, lambda j: F.struct(j["start"].alias("s"), F.coalesce(j["end"], F.lit(as_of).cast("date")).alias("e"))),
        lambda x: x["s"].isNotNull() & (x["s"] <= x["e"]),
    )
    first = F.struct(F.lit(0).alias("days"), F.lit(None).cast("date").alias("until"))
    fold = F.aggregate(
        F.array_sort(spans),
        first,
        lambda a, x: F.struct(
            (a["days"] + F.greatest(F.lit(0), F.datediff(x["e"], F.when(a["until"].isNull(), x["s"]).otherwise(F.greatest(a["until"], x["s"]))))).alias("days"),
            F.when(a["until"].isNull(), x["e"]).otherwise(F.greatest(a["until"], x["e"])).alias("until"),
        ),
        lambda a: a["days"],
    )
    return F.round(fold / 365.25, 1)


def extract(docs: DataFrame, as_of: str, text: str = "text") -> DataFrame:
    """doc_id, record: the nested result of every document."""
    given = docs.select("doc_id", F.coalesce(T.normalize_whitespace(F.col(text)), F.lit("")).alias("text"))
    lines = F.split("text", "\n")
    facts = given.select("doc_id", contact(F.col("text"), lines).alias("contact"), mine_skills(F.col("text")).alias("mined"), top_paragraph(lines).alias("top"))
    facts = facts.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in ("contact", "mined", "top")])
    rows = stored(parsed_rows(docs, as_of, text), "entries")
    skills = matched_lists(rows.where("listed IS NOT NULL"), "doc_id", "listed")

    newest = F.coalesce(F.datediff(F.lit("1970-01-01").cast("date"), F.col("job.start")), F.lit(1 << 30))
    kept = lambda test, order, what: F.array_sort(F.collect_list(F.when(test, F.struct(order.alias("o"), "entry", F.col(what).alias("x")))))
    made = normalized_titles(rows).groupBy("doc_id").agg(
        kept(F.expr("job.job_title IS NOT NULL OR job.company IS NOT NULL"), newest, "job").alias("jobs"),
        kept(F.expr("degree.degree IS NOT NULL OR degree.institution IS NOT NULL"), -degree_rank(F.coalesce("degree.degree", F.lit(""))), "degree").alias("education"),
        kept(F.expr("certificate.name IS NOT NULL"), F.lit(0), "certificate").alias("certifications"),
        kept(F.expr("project.name IS NOT NULL"), F.lit(0), "project").alias("projects"),
        F.max("summary").alias("summary"),
        F.max("languages").alias("languages"),
        F.array_sort(F.collect_set("section")).alias("sections"),
    )
    made = made.selectExpr("doc_id", "summary", "languages", "sections", *[f"transform({c}, x -> x.x) {c}" for c in ("jobs", "education", "certifications", "projects")])
    joined = facts
    for side, name in ((made, "made_id"), (skills, "skills_id")):
        joined = joined.join(side.withColumnRenamed("doc_id", name), F.col("doc_id").eqNullSafe(F.col(name)), "left").drop(name)
    every = joined.withColumn("every", F.array_distinct(F.concat(F.coalesce("matched", F.array().cast("array<string>")), "mined")))
    whole = every.withColumns({"skills": skill_struct(F.col("every")), "years": total_years(F.col("jobs"), as_of)})
    empty = lambda c: F.coalesce(F.col(c), F.filter(F.col(c), lambda x: F.lit(False)), F.from_json(F.lit("[]"), whole.schema[c].dataType))
    record = F.struct(
        "contact",
        F.coalesce("summary", "top").alias("summary"),
        F.transform(empty("jobs"), lambda j: j.dropFields("start", "end")).alias("experience"),
        empty("education").alias("education"),
        "skills",
        empty("certifications").alias("certifications"),
        empty("projects").alias("projects"),
        empty("languages").alias("languages"),
        F.coalesce("years", F.lit(0.0)).alias("total_experience_years"),
        F.coalesce("sections", F.array().cast("array<string>")).alias("sections_detected"),
    )
    return whole.select("doc_id", record.alias("record"))

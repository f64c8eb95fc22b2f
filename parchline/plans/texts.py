"""Queries over page texts, entities, dates, routing, taxonomies and staged runs, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..functions import dates as D
from ..functions import entities as E
from ..functions import regexes as R
from ..operators import layout, match, score, store
from ..sources import documents
from . import stages
from .catalogue import _SKILLS, _TYPED, HEIGHT, WIDTH, _case, _table, derived, query
from .resumes import _PEOPLE, records


def _placed(spark, sf_dir):
    blocks = derived(spark, sf_dir, "blocks")
    return layout.place(blocks, layout.layout_type(blocks, WIDTH), WIDTH, HEIGHT)


_SIDE = "CASE WHEN column_boundary < 240 THEN x0 < column_boundary ELSE x0 >= column_boundary END AND layout_type = 'sidebar'"


@query(
    _TYPED
    + f""", p AS (SELECT *, {_SIDE} AS side, max(CASE WHEN x1 - x0 > 0.8 * column_boundary THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_num) = 1 AS any_full FROM blocks_syn JOIN typed USING (doc_id))
    SELECT doc_id, string_agg(text, chr(10) ORDER BY page_num, CASE WHEN layout_type = 'sidebar' THEN CAST(side AS INT) WHEN layout_type = 'two_column' AND NOT any_full THEN CAST(x0 >= column_boundary AS INT) ELSE 0 END, y0, x0, block_seq, text) AS text FROM p GROUP BY doc_id"""
)
def reading_texts(spark, sf_dir):
    """Every document's text in reading order."""
    return layout.reading_text(_placed(spark, sf_dir))


@query(
    _TYPED
    + """, w AS (SELECT *, x1 - x0 > 0.85 * column_boundary AS wide FROM blocks_syn JOIN typed USING (doc_id)),
    t AS (SELECT *, min(CASE WHEN NOT wide THEN y0 END) OVER (PARTITION BY doc_id, page_num) AS top FROM w),
    s AS (SELECT *, CASE layout_type WHEN 'two_column' THEN CASE WHEN wide AND y0 < coalesce(top, 0) THEN 0 WHEN wide THEN 3 WHEN x0 < column_boundary THEN 1 ELSE 2 END
      WHEN 'sidebar' THEN CASE WHEN (x0 < column_boundary) = (column_boundary < 300) THEN 1 ELSE 0 END ELSE 0 END AS part, CASE WHEN layout_type = 'single_column' THEN x0 ELSE 0 END AS x FROM t),
    g AS (SELECT doc_id, part, CASE WHEN layout_type = 'two_column' AND wide THEN nr END AS alone, string_agg(text, chr(10) ORDER BY y0, x, block_seq, text) AS piece, min(nr) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY y0, x, block_seq, text) AS nr FROM s) GROUP BY doc_id, part, alone)
    SELECT doc_id, string_agg(piece, chr(10) || chr(10) ORDER BY part, place) AS text FROM g GROUP BY doc_id"""
)
def reconstructed_texts(spark, sf_dir):
    """Every document's text put together by its layout."""
    return layout.reconstructed_text(_placed(spark, sf_dir), WIDTH)


_SENTENCE = "concat('Dr. Anna Lee of Acme ', source, ' and Brown Data ', {}, ' GmbH met Prof Otto in {}, Norway. ', coalesce(text, ''))"


def _list(text: str, pattern: str, group: int) -> str:
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all({text}, '{pattern.replace(chr(39), chr(39) * 2)}', {group}))), '|')"


@query(
    f"""WITH t AS (SELECT doc_id, {_SENTENCE.format("CASE WHEN doc_id % 2 = 0 THEN 'North' ELSE 'South' END", "Germany in Mar 2019")} AS t FROM documents)
    SELECT doc_id, {_list('t', E.PERSON, 1)} AS persons, {_list('t', E.ORGANISATION, 1)} AS organisations, {_list('lower(t)', E.PLACE, 1)} AS places, {_list('t', R.MONTH_YEAR, 0)} AS dates FROM t"""
)
def named_entities(spark, sf_dir):
    """Entities of every whole text behind a sentence that holds some of each kind."""
    sentence = _SENTENCE.format("CASE WHEN doc_id % 2 = 0 THEN 'North' ELSE 'South' END", "Germany in Mar 2019")
    found = _table(spark, sf_dir, "documents").select("doc_id", E.entities(F.expr(sentence)).alias("e"))
    return found.select("doc_id", *[F.array_join(f"e.{k}", "|").alias(k) for k in ("persons", "organisations", "places", "dates")])


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%B %Y') WHEN 1 THEN strftime(o_orderdate, '%Y') END AS found FROM orders")
def first_dates(spark, sf_dir):
    """The date in a sentence of every order: a month before any year, a bare year, or none."""
    kind = F.col("o_orderkey") % 3
    text = F.when(kind == 0, F.concat(F.lit("Since 1999 or "), F.date_format("o_orderdate", "MMMM yyyy"), F.lit(", in May 2001"))).when(kind == 1, F.concat(F.lit("class of "), F.date_format("o_orderdate", "yyyy"), F.lit(" or 1980"))).otherwise("order 12345")
    return _table(spark, sf_dir, "orders").select("o_orderkey", D.first_date(text).alias("found"))


_NAMES = "split_part(p_name, ' ', 2)"


@query("SELECT skill FROM (VALUES {}) v(skill) UNION SELECT lower(split_part(p_name, ' ', 2)) FROM part".format(", ".join("('" + s.replace("'", "''") + "')" for s in match.SKILLS)))
def merged_taxonomy(spark, sf_dir):
    """Built-in skills and those of JSON files, an object and lists, written from the parts' names in untidy forms."""
    names = _table(spark, sf_dir, "part").select(F.expr(_NAMES).alias("s")).distinct()
    path = store.new_folder(spark, "taxonomy")
    rows = names.select(F.when(F.length("s") % 2 == 0, F.concat(F.lit('{"skills": [7, " '), F.upper("s"), F.lit(' "]}'))).otherwise(F.concat(F.lit('["'), "s", F.lit('", null]'))).alias("value"))
    rows.unionByName(spark.createDataFrame([("no json",)], "value string")).repartition(F.col("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    return match.taxonomy(spark, path)


_KEPT = f"SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS person_id, p_partkey AS pos, {_case('p_partkey % 8', [x[1] for x in _SKILLS])} AS matched, {_case('p_partkey % 8', [x[2] for x in _SKILLS])} AS score FROM part"


@query(
    f"""WITH m AS ({_KEPT}), k AS (SELECT person_id, matched, min(pos) AS pos FROM m WHERE score >= 0.60 GROUP BY 1, 2)
    SELECT person_id, coalesce(string_agg(matched, '|' ORDER BY pos), '') AS skills FROM (SELECT DISTINCT person_id FROM m) LEFT JOIN k USING (person_id) GROUP BY person_id"""
)
def matched_lists(spark, sf_dir):
    """Ten written skills for each person, matched and reduced in order."""
    rows = _table(spark, sf_dir, "part").selectExpr("CAST(floor(p_partkey / 10) AS BIGINT) person_id", "p_partkey pos", f"{_case('p_partkey % 8', [x[0] for x in _SKILLS])} skill")
    return match.match_and_normalize(rows, "person_id", "pos").select("person_id", F.array_join("skills", "|").alias("skills"))


@query(
    """WITH l AS (SELECT doc_id, doc_id % 4 AS kind, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, kind, count(*) AS n FROM l WHERE trim(t) <> '' GROUP BY 1, 2)
    SELECT doc_id, CASE WHEN kind = 1 THEN 'scanned' ELSE 'digital' END AS origin, n, CASE WHEN kind = 2 THEN CAST(n * n AS BIGINT) END AS ranks FROM f
    UNION ALL SELECT doc_id, 'scanned', n, CAST(n * (n + 1) AS BIGINT) FROM f WHERE kind = 2"""
)
def routed_blocks(spark, sf_dir):
    """Documents of four kinds (digital, scanned, mixed, unknown) by their readers; mixed ones are read twice and merged."""
    files = _table(spark, sf_dir, "documents").select("doc_id", "text", F.element_at(F.array(*[F.lit(k) for k in ("digital", "scanned", "mixed", None)]), (F.col("doc_id") % 4 + 1).cast("int")).alias("pdf_type"))
    made = documents.routed_blocks(files, {"digital": documents.text_blocks, "scanned": documents.text_blocks})
    return made.groupBy("doc_id", "origin").agg(F.count(F.lit(1)).alias("n"), F.sum("merged_rank").alias("ranks"))


@query(
    _PEOPLE
    + """SELECT c AS doc_id, 'confidence,completeness' AS done, 'broken,unread' AS failed, 'a' AS better, 0e0 AS difference FROM f"""
)
def staged_records(spark, sf_dir):
    """Stages over the records, two of which fail (one while planning, one while running), and their scores against those made without the runner."""
    made = records(spark, sf_dir)
    run = stages.run_stages(
        made.select("doc_id", "record"),
        [
            ("confidence", score.confidence),
            ("broken", lambda rows: rows.select("no_such_column")),
            ("unread", lambda rows: rows.withColumn("x", F.assert_true(F.col("doc_id").isNull()))),
            ("completeness", score.completeness),
        ],
    )
    named = lambda ok: ",".join(name for name, _, good, _ in run.report if good == ok)
    return score.compare(run.rows.where("completeness.score IS NOT NULL"), made, "doc_id").select("doc_id", F.lit(named(True)).alias("done"), F.lit(named(False)).alias("failed"), "better", "difference")


@query(
    _PEOPLE
    + """, s AS (SELECT *, 0.3e0 + CASE WHEN email IS NULL THEN 0 ELSE 0.25e0 END + CASE WHEN phone IS NULL THEN 0 ELSE 0.2e0 END + CASE WHEN linkedin IS NULL THEN 0 ELSE 0.1e0 END + 0.15e0 AS contact,
      least(1e0, (1 + length(skills) - length(replace(skills, ',', ''))) / 10.0e0) AS skill_score FROM f)
    SELECT c AS doc_id, CASE WHEN jobs > 0 THEN 1e0 ELSE 0e0 END AS experience, CASE WHEN edu THEN 1e0 ELSE 0e0 END AS education, skill_score AS skills,
      round(round(contact, 2) * 0.3e0 + CASE WHEN jobs > 0 THEN 0.25e0 ELSE 0 END + CASE WHEN edu THEN 0.2e0 ELSE 0 END + skill_score * 0.15e0 + CASE WHEN summary IS NULL THEN 0 ELSE 0.04e0 END + CASE WHEN cert THEN 0.04e0 ELSE 0 END, 3) AS overall FROM s"""
)
def early_scores(spark, sf_dir):
    """Scores at extraction of every résumé."""
    made = score.at_extraction(records(spark, sf_dir))
    return made.select("doc_id", "early.experience", "early.education", "early.skills", "early.overall")


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey / 4.0e0 END AS total_years, CASE WHEN c_custkey % 2 = 0 THEN 0.5e0 END AS confidence, '2020' AS graduation_date FROM customer"
)
def coerced_columns(spark, sf_dir):
    """Export columns as numbers where their names say so."""
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN 'many' ELSE cast(c_custkey / 4D AS string) END total_years", "CASE WHEN c_custkey % 2 = 0 THEN '0.5' ELSE '' END confidence", "'2020' graduation_date")
    return sinks.coerced(rows)

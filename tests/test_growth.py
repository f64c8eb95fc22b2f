"""Plans and partitions that keep the work in proportion to the rows."""

from pyspark.sql import functions as F

from parchline.functions import dates, text
from parchline.functions import regexes as R
from parchline.operators import layout, match, record, segment
from parchline.plans import catalogue
from parchline.sources import tables

LADDER = "levenshtein"


def _optimized(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")


def test_ladders_see_distinct_values_only(spark):
    spark.conf.set("spark.sql.maxToStringFields", "10000")
    rows = spark.createDataFrame([(1, "Python"), (2, "pyton"), (3, "zzz")], "k bigint, s string")
    for made in (match.match_skills(rows, "s").where("score >= 0.6"), match.normalize_titles(rows, "s").where("confidence >= 0.65")):
        plan = _optimized(made)
        counted = next(i for i, line in enumerate(plan) if "Aggregate" in line)
        assert any(LADDER in line for line in plan[:counted])
        assert not any(LADDER in line for line in plan[counted:])


def test_a_ladder_does_not_move_to_the_other_side_of_its_join(spark):
    spark.conf.set("spark.sql.maxToStringFields", "10000")
    lists = spark.createDataFrame([(1, ["Python", "zzz", "pyton"]), (2, ["zzz"])], "k bigint, xs array<string>")
    plan = _optimized(record.matched_lists(lists, "k", "xs"))
    join = next(i for i, line in enumerate(plan) if "Join" in line)
    scans = [i for i, line in enumerate(plan) if "Generate" in line and i > join]
    counted = next(i for i, line in enumerate(plan) if "Aggregate" in line and i > join)
    assert len(scans) == 2 and scans[0] < counted < scans[1]
    ladders = [i for i, line in enumerate(plan) if LADDER in line]
    assert ladders and all(scans[0] < i < counted for i in ladders)
    assert [(r.k, r.matched) for r in record.matched_lists(lists, "k", "xs").collect()] == [(1, ["python"])]


def _uses(column, name: str) -> int:
    return column._jc.toString().count(name)


def test_an_expression_is_named_once_where_it_is_costly():
    """Branches of a CASE or COALESCE share nothing: a text named in each of them is made again in each."""
    assert _uses(segment.keyword_section(F.translate("text", "a", "b")), "translate(") == 1
    assert _uses(dates.parse_range(F.translate("text", "a", "b"), "2024-01-01"), "translate(") == 1
    assert _uses(record.contact(F.translate("text", "a", "b"), F.split("x", "y")), "translate(") == 1


def test_short_cuts_agree_with_the_patterns(spark):
    given = ["Jan 2018 - Mar 2021", "built 20 things", "1999/2001", "a@b", "me@mail.org", "LINKEDIN.com/in/abc", "x linkedin", "ABC", "AB", "A1B-C", "ABc", "", "ÄÖÜ", None, "3/2019 to present", "2010"]
    rows = spark.createDataFrame([(x,) for x in given], "t string")
    t = F.col("t")
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    pairs = [
        (text.has_date_range(t), t.rlike(R.DATE_RANGE)),
        (text.without_date_range(t), F.regexp_replace(t, R.DATE_RANGE, "")),
        (text.has_email(t), t.rlike(R.EMAIL)),
        (text.has_linkedin(t), t.rlike(R.LINKEDIN)),
        (text.is_all_caps(t), (F.length(letters) >= 3) & (letters == F.upper(letters))),
    ]
    found = rows.select(*[a.eqNullSafe(b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).collect()
    assert all(all(r) for r in found)


def test_dates_of_every_format_are_still_read(spark):
    given = {"Mar 2019": "2019-03-01", "3/2019": "2019-03-01", "3-2019": "2019-03-01", "2019-03": "2019-03-01", "2019/03": "2019-03-01", "15/3/2019": "2019-03-15", "3/15/2019": "2019-03-15", "2019-03-15": "2019-03-15", "March 15, 2019": "2019-03-15", "15 Mar 2019": "2019-03-15", "2019/03/15": "2019-03-15", "15-3-2019": "2019-03-15", "class of 2019": "2019-01-01", "now": "2024-01-01", "none": None}
    rows = spark.createDataFrame(list(given.items()), "t string, want string")
    got = rows.select("t", "want", dates.parse_date(F.col("t"), "2024-01-01").cast("string").alias("got")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got]


def test_skills_of_several_words_are_mined_between_blanks(spark):
    given = {"We do Machine\tLearning, Power BI – C++ and SQL Server.": {"machine learning", "power bi", "c++", "sql server"}, "machine, learning": {"machine learning"}, "machinelearning powerbi": set(), "learning machine": set(), "Ümachine learning": {"machine learning"}, "x\u0000go": {"go"}}
    rows = spark.createDataFrame([(k,) for k in given], "t string")
    for r in rows.select("t", match.mine_skills(F.col("t")).alias("s")).collect():
        several = {s for s in r.s if s in {"machine learning", "power bi", "c++", "sql server", "go"}}
        assert several == given[r.t], r.t


def test_partitions_grow_with_the_files(spark, tmp_path):
    spark.range(0, 200_000, 1, 2).selectExpr("id % 5000 AS doc_id", "uuid() AS t").write.parquet(f"{tmp_path}/x.parquet")
    rows = spark.read.parquet(f"{tmp_path}/x.parquet")
    whole = sum(p.stat().st_size for p in (tmp_path / "x.parquet").glob("*.parquet"))
    cores = spark.sparkContext.defaultParallelism
    for size in (whole * 2, whole // 10, whole // 40):
        assert abs(tables.by_key(rows.where("doc_id > 7"), "doc_id", size=size).rdd.getNumPartitions() - max(cores, whole / size)) <= 1


def test_lines_from_words_take_the_partitions_of_their_size(spark, tmp_path):
    words = spark.createDataFrame([(i % 50, 1, i, float(i % 7), float(i % 30), "w") for i in range(500)], "doc_id bigint, page_num int, block_seq int, x0 double, y0 double, text string")
    want = {tuple(r) for r in layout.lines_from_words(words, 3.0).collect()}
    words.write.parquet(f"{tmp_path}/words.parquet")
    made = layout.lines_from_words(spark.read.parquet(f"{tmp_path}/words.parquet"), 3.0)
    assert any("RepartitionByExpression [doc_id" in line for line in _optimized(made))
    assert {tuple(r) for r in made.collect()} == want


def test_blocks_that_tie_keep_the_order_of_the_table(spark, tmp_path):
    """Equal row, column, left edge and number: the table decides, not the order in which a shuffle arrives."""
    n = 300
    rows = [(i % 5, i, 0, 1, 0.0) for i in range(n)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_tax double").selectExpr("l_orderkey", "l_partkey * 480 AS l_partkey", "l_suppkey", "l_linenumber").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    blocks = catalogue.derived(spark, str(tmp_path), "blocks", "place").withColumn("k", F.col("place.row"))
    ranked = layout.page_order(layout.column_tags(blocks.repartition(7, F.rand(3)), catalogue.WIDTH), place="place")
    got = {d: [r.k for r in sorted(g, key=lambda r: r.page_rank)] for d, g in _by_doc(ranked.select("doc_id", "page_rank", "k").collect()).items()}
    assert len(got) == 5 and all(v == sorted(v) for v in got.values())


def _by_doc(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out

"""Reconstructed texts, routing, taxonomies, entities and the stage runner on small fixtures."""

import pytest
from pyspark.sql import functions as F

from parchline.functions import entities
from parchline.operators import layout, match, score
from parchline.plans import stages
from parchline.sources import documents

BLOCK = "doc_id int, page_num int, block_seq int, x0 double, y0 double, x1 double, text string, layout_type string, column_boundary double, reading_rank int"


def placed(spark, kind, boundary, blocks):
    rows = [(1, p, i, float(x), float(y), float(x1), t, kind, boundary, i) for i, (p, x, y, x1, t) in enumerate(blocks)]
    return spark.createDataFrame(rows, BLOCK)


@pytest.mark.parametrize(
    "kind, boundary, blocks, want",
    [
        ("two_column", 300.0, [(1, 0, 5, 600, "top"), (1, 320, 10, 500, "r1"), (1, 0, 20, 200, "l1"), (1, 0, 30, 200, "l2"), (1, 0, 10, 600, "level"), (1, 0, 90, 600, "end")], "top\n\nl1\nl2\n\nr1\n\nlevel\n\nend"),
        ("two_column", 300.0, [(1, 0, 9, 600, "a"), (1, 0, 1, 600, "b")], "b\n\na"),
        ("sidebar", 150.0, [(1, 0, 1, 100, "side  one"), (1, 200, 5, 500, "main"), (1, 200, 2, 500, None), (1, 0, 3, 100, "")], "main\n\nside one"),
        ("sidebar", 450.0, [(1, 500, 1, 600, "side"), (1, 20, 5, 400, "main")], "main\n\nside"),
        ("single_column", 300.0, [(2, 0, 1, 100, "later page"), (1, 90, 5, 100, "b"), (1, 10, 5, 80, "a")], "a\nb\n\nlater page"),
        (None, None, [(1, 0, 2, 9, "y"), (1, 0, 1, 9, "x")], "x\ny"),
    ],
)
def test_reconstruction(spark, kind, boundary, blocks, want):
    assert [r.text for r in layout.reconstructed_text(placed(spark, kind, boundary, blocks), 600.0).collect()] == [want]


def test_reading_text(spark):
    rows = placed(spark, "single_column", 300.0, [(1, 0, 1, 9, "a"), (1, 0, 2, 9, " "), (1, 0, 3, 9, None), (1, 0, 4, 9, "b")])
    assert layout.reading_text(rows).first()["text"] == "a\nb"
    assert layout.reading_text(rows.where("trim(text) = ''")).first()["text"] == ""
    assert layout.reading_text(rows.where("false")).count() == 0


def test_routing(spark):
    rows = [(1, "digital", "d"), (2, "scanned", "s"), (3, "mixed", "m"), (4, None, "n"), (5, "scanned", "unreadable"), (6, "docx", "w")]
    files = spark.createDataFrame(rows, "doc_id int, pdf_type string, text string")

    def reader(name):
        return lambda df: df.where(f"NOT ('{name}' = 's' AND text = 'unreadable')").select("doc_id", F.lit(1).alias("page_num"), F.lit(0).alias("block_seq"), F.lit(1.0).alias("y0"), F.concat(F.lit(name), "text").alias("text"))

    got = documents.routed_blocks(files, {"digital": reader("d"), "scanned": reader("s"), "docx": reader("w")}).orderBy("doc_id", "merged_rank").collect()
    assert [(r.doc_id, r.origin, r.text) for r in got] == [(1, "digital", "dd"), (2, "scanned", "ss"), (3, "digital", "dm"), (3, "scanned", "sm"), (4, "digital", "dn"), (5, "digital", "dunreadable"), (6, "docx", "ww")]
    alone = documents.routed_blocks(files, {"digital": reader("d")})
    assert alone.count() == 6 and {r.origin for r in alone.collect()} == {"digital"}


def test_taxonomy(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"skills": [" Weaving ", "PYTHON", 5, null, ""], "more": ["no"]}')
    (tmp_path / "b.json").write_text('["weaving",\n"Dyeing", ["nested"]]')
    (tmp_path / "c.json").write_text("not json")
    (tmp_path / "d.json").write_text('{"other": 1}')
    got = sorted(r.skill for r in match.taxonomy(spark, str(tmp_path), ["python"]).collect())
    assert got == ["dyeing", "python", "weaving"]
    assert [r.skill for r in match.taxonomy(spark, str(tmp_path / "missing"), ["python"]).collect()] == ["python"]


def test_matched_lists(spark):
    rows = spark.createDataFrame([(1, 0, "k8s"), (1, 1, "Kubernetes"), (1, 2, "pyton"), (2, 0, "qqqq"), (3, 0, None)], "id int, pos int, skill string")
    got = {r.id: r.skills for r in match.match_and_normalize(rows, "id", "pos").collect()}
    assert got == {1: ["kubernetes", "python"], 2: [], 3: []}


def test_entities(spark):
    text = "Dr. Ann Lee left Acme Tools Inc for the Technical University College in GERMANY, Mar 2019. mr small. Prof Otto, Mar 2019."
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string").select("id", entities.entities(F.col("text")).alias("e"))
    e = {r.id: r.e for r in rows.collect()}
    assert e[1].persons == ["Ann Lee", "Otto"] and e[1].places == ["germany"] and e[1].dates == ["Mar 2019"] and "Acme Tools Inc" in e[1].organisations
    assert list(e[2]) == list(e[3]) == [[], [], [], []]


def test_stages(spark):
    docs = spark.createDataFrame([(1, "Ann Lee\nann@mail.org\n\nSKILLS\nPython, k8s"), (2, None)], "doc_id bigint, text string")
    run = stages.run_stages(docs, [("bad", lambda d: d.select(F.raise_error(F.lit("no")))), *stages.record_stages("2024-01-01")])
    assert [(name, good) for name, _, good, _ in run.report] == [("bad", False), ("extraction", True), ("enhancement", True), ("validation", True), ("confidence", True), ("completeness", True)]
    assert len(run.warnings) == 1 and "bad" in run.warnings[0] and run.report_rows(spark).where("success").count() == 5
    rows = {r.doc_id: r for r in run.rows.collect()}
    assert rows[1].record.contact.email == "ann@mail.org" and rows[2].completeness.score == 0
    assert stages.quick_extract(docs, "2024-01-01").columns == ["doc_id", "record"]
    early = {r.doc_id: r.early for r in score.at_extraction(run.rows).collect()}
    assert early[1].skills == 0.2 and early[2].overall == 0.0

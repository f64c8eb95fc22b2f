"""Every catalogue query against its SQL, on the smallest tables."""

import hashlib
import os

import duckdb
import pytest

from parchline.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DIR)
    cur = db.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted([norm(r[names.index(k)]) for k in order] for r in cur.fetchall())
    got = sorted([norm(r[k]) for k in order] for r in df.collect())
    assert got == want


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_character_maps_covers_all_texts(spark, tmp_path):
    given = {1: "plain", 2: "“a” – b", 3: "l’été «x» ﬁn œuvre Æ ■ ″ ―", 4: None, 5: "Ōsaka"}
    want = {1: "plain", 2: '"a" - b', 3: "l'été \"x\" fin oeuvre AE - \" -", 4: None, 5: "Ōsaka"}
    spark.createDataFrame(list(given.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.h) for r in QUERIES["character_maps"](spark, str(tmp_path)).collect()}
    assert got == {k: (None, None) if v is None else (len(v), hashlib.md5(v.encode()).hexdigest()) for k, v in want.items()}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_language_agrees_with_the_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["language"](spark, DIR).where("reliable").join(docs, "doc_id")
    assert found.count() > 100 and found.where("language = lang").count() > 0.95 * found.count()

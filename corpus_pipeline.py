"""The corpus pipeline: five stages from raw documents to token ids.

Every stage works on all rows that its predecessor kept. Filtering stages return the
columns of ``documents``; the last returns doc_id, n_tokens, ids and the digest of the decoded text.
SQL can express neither the classifier nor the edit matching, so there is no ORACLE_SQL; the tests hold
the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchline.llm import bpe, decontaminate, minhash, secrets, toxicity
from parchline.llm.common import Stage, passing, table
from parchline.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return toxicity.score(rows, model, "row").where("predicted = 0").select("doc_id.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that with the smallest id (null ids last); of repeated rows one.

    Rows are told apart by a written row number, never by their id, which may be null or shared.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = Stage(spark, "dedup").save(packed.withColumn("row_no", F.monotonically_increasing_id()), "rows")
    found = minhash.near_duplicates(rows, "row_no", "row.text").selectExpr("doc_id row_no", "component_id", "n_shingles")
    # Texts without words are linked with nothing; of those that repeat id and text one stays.
    blank = r"CASE WHEN row.text rlike '[^\\x20\\x09-\\x0D]' THEN null ELSE coalesce(md5(row.text), 'null') END blank"
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")
    groups = found.join(rows.selectExpr("row_no", "row.doc_id doc_id", blank), "row_no").selectExpr(
        "doc_id", "row_no", "CASE WHEN n_shingles > 0 THEN component_id END component_id", "CASE WHEN n_shingles = 0 THEN doc_id END blank_id", "blank"
    )
    stay = groups.groupBy("component_id", "blank_id", "blank").agg(F.min(order).alias("first")).select("first.row_no")
    return rows.join(stay, "row_no", "left_semi").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the reported spans of their texts replaced; n_chars follows the new text."""
    out = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind)
    return out.withColumn("n_chars", chars)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded back as a check."""
    out = bpe.encode(docs, *tokenizer(), decode_back=True, lists=True, remembered=100_000)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("bpe", encode_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs, stage = table(spark, sf_dir, "documents"), Stage(spark, "pipeline")
    before = None
    for name, function in STAGES[:-1]:
        with passing():
            docs = stage.save(function(spark, docs, sf_dir), name)
        if before:
            stage.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)

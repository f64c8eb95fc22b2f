"""The queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, chunks, decontaminate, minhash, quality, rules, secrets, toxicity, urls
from .common import table

#: Fixed rules of the URL query.
BLOCK, ALLOW = ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]
RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer(name: str = RANKS) -> tuple[str, str]:
    """Path of a rank file and the pattern that splits texts, of the public vocabularies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _held_out(parts: int, rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == rest, F.lit(False)).alias("held_out")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", _held_out(toxicity.PARTS, toxicity.HELD_OUT), "score", "predicted")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), BLOCK, ALLOW)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.lit(0).cast("bigint").alias("turn"),
        F.to_json(
            F.struct(
                F.array(*[F.struct(F.lit(r).alias("role"), F.lit(said).alias("content")) for r in ("user", "assistant")]).alias("messages")
            )
        ).alias("record"),
    )
    given = chat.turns_of_rows(rows.select("conv_id", "turn", "role", "text"), "conv_id", "turn")
    made = chat.format_turns(given.unionByName(chat.turns_of_records(own, "conv_id", "turn", "record")))
    read = made.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"))
    loss = "array_join(transform(filter(turns, t -> t.loss), t -> t.text), '')"
    return read.selectExpr(
        "conv_id",
        "cast(size(turns) AS bigint) n_turns",
        "sha2(array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), ''), 256) turns_sha256",
        f"cast(char_length({loss}) AS bigint) loss_chars",
        f"sha2({loss}, 256) loss_sha256",
        "cast(char_length(formatted) AS bigint) formatted_chars",
    )


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = "cast(size(filter(secrets.base, s -> s.kind = '{0}')) AS bigint) n_{0}"
    every = "concat(secrets.base, secrets.linked)"
    order = "CASE s.kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 WHEN 'user' THEN 3 WHEN 'endpoint' THEN 4 ELSE 5 END"
    ranked = f"array_sort(transform({every}, s -> named_struct('start', s.start, 'rank', {order}, 'end', s.end, 'kind', s.kind)))"
    return found.selectExpr(
        "doc_id",
        *[count.format(k) for k in ("assign", "access", "hex")],
        f"sha2({secrets.joined_spans('secrets.base')}, 256) base_sha256",
        f"{secrets.joined_spans(ranked)} spans",
    )


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, sf_dir, "documents"))


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", _held_out(quality.PARTS, quality.HELD_OUT), "score", "predicted")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.distance", "h.end")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), *tokenizer(), decode_back=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_url_filter,
        op3_chat_format,
        op4_minhash_dedup,
        op5_secret_scan,
        op6_chunk_dedup,
        op7_quality_cnn,
        op8_quality_rules,
        op9_decontaminate,
        op10_bpe,
    )
}

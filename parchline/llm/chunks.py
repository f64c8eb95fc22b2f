"""Substring dedup by content-defined chunks.

A gear hash of the last WINDOW bytes stands at every position. A position is a cut where
its hash is the smallest of any SPAN neighbouring positions, the first one if the same hash
recurs. So cuts depend on the bytes around them alone and are the same in every copy of a
passage, from its first whole span to its last: no chunk is lost to falling into step. Where
hashes recur, as in rows of dashes, a cut also needs MIN_CHUNK bytes since the last one;
the text being periodic there, its chunks are equal all the same. Chunks are known by a
128-bit digest of their bytes and the WINDOW bytes before them.

Whole passages. Between the smallest positions of a passage's first and last span all
chunks of its copies are equal, so a passage of PASSAGE + 2 * SPAN + WINDOW - 2 bytes or more
in which no hash recurs within a span is always reported, be it in two documents only; others
are where they hold PASSAGE bytes of whole chunks.

One row for each document says which of its bytes repeat: a chunk counts as a repeat
where its digest occurs in another document, and neighbouring repeated chunks make a
passage when they span PASSAGE bytes or more. ``extra`` passages are those that are
not the first place (smallest doc_id, then position) of their chunks, be it in the same
document; removing them leaves every passage in the corpus once.

Scale. Digests are counted with partial aggregation (one row for a digest and map
task, however many places it has), then joined back to the places: digests that hold a thousandth
of all places are broadcast, a thousand at most; the others' places are shuffled. Only repeated digests' places go
on to the grouping by document. No group of places is ever collected.

Defined results. Null and empty texts have no chunks. Each row of the input counts as a
document of its own, so repeated rows repeat each other; rows with null or equal ids are kept
apart by a row number written with the chunks. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, Stage, join_counted, small_batches, to_bytes, with_id

WINDOW = 16
#: Positions of which the smallest hash is a cut; chunks have half of that on average.
SPAN = 88
MIN_CHUNK, MAX_CHUNK = 28, 512
#: Shortest passage that is reported, in bytes.
PASSAGE = 96

_GEAR = np.random.default_rng(42).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)


def _least(keys: np.ndarray) -> np.ndarray:
    """The smallest of each SPAN neighbours."""
    width = 1
    while 2 * width <= SPAN:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    return keys if width == SPAN else np.minimum(keys[: width - SPAN], keys[SPAN - width :])


def _candidates(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose hash of the last WINDOW bytes is the first smallest of SPAN neighbours, and which are the only smallest; long texts go by parts."""
    hits, alone = [np.zeros(0, np.int64)], [np.zeros(0, bool)]

    def add(found: np.ndarray, single: np.ndarray) -> None:
        new = np.flatnonzero(np.diff(found, prepend=-1))
        hits.append(found[new])
        alone.append(np.logical_or.reduceat(single, new) if len(new) else single)

    for at in range(0, len(buf) - WINDOW - SPAN + 2, PIECE):
        part = _GEAR[buf[at : at + PIECE + SPAN + WINDOW - 2]]
        n = len(part) - WINDOW + 1
        h = np.zeros(n, dtype=np.uint32)
        for k in range(WINDOW):
            h += part[WINDOW - 1 - k : WINDOW - 1 - k + n] << np.uint32(k)
        high, place = h.astype(np.uint64) << np.uint64(32), np.arange(n, dtype=np.uint64)
        first = (_least(high | place) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        last = n - 1 - (_least(high | place[::-1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        add(first + at + WINDOW, first == last)
    add(np.concatenate(hits), np.concatenate(alone))
    return hits[-1], alone[-1]


def cut(text: bytes) -> list[int]:
    """Ends of the chunks."""
    ends, last, n = [], 0, len(text)
    hits, alone = _candidates(np.frombuffer(text, dtype=np.uint8))
    for c, single in [*zip(hits.tolist(), alone.tolist()), (n, n > 0)]:
        while c - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if c > last and (single or c - last >= MIN_CHUNK):
            ends.append(c)
            last = c
    return ends


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = to_bytes(batch.column("text").to_pylist())
        row, digests, starts, sizes = [], [], [], []
        for i, text in enumerate(texts):
            last = 0
            ends = cut(text)
            for end in ends:
                digests.append(hashlib.blake2b(text[max(0, last - WINDOW) : end], digest_size=16).digest())
                starts.append(last)
                sizes.append(end - last)
                last = end
            digests.append(bytes(16))  # the document's own row: no start, its size
            starts.append(-1)
            sizes.append(len(text))
            row.append(len(ends) + 1)
        index = pa.array(np.repeat(np.arange(len(texts)), row))
        both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id").take(index),
                "row_no": batch.column("row_no").take(index),
                "d0": pa.array(both[:, 0].copy()),
                "d1": pa.array(both[:, 1].copy()),
                "start": pa.array(starts, pa.int64()),
                "size": pa.array(sizes, pa.int64()),
            }
        )


def _passages(column: str) -> str:
    """SQL: neighbouring (start, size) of a sorted array joined to [start, end) spans of PASSAGE bytes or more."""
    opens = "x -> x.i = 0 OR get({0}, x.i - 1).start + get({0}, x.i - 1).size <> x.start".format(column)
    closes = "x -> x.i = size({0}) - 1 OR get({0}, x.i + 1).start <> x.start + x.size".format(column)
    placed = f"transform({column}, (c, i) -> named_struct('i', i, 'start', c.start, 'size', c.size))"
    joined = f"zip_with(filter({placed}, {opens}), filter({placed}, {closes}), (a, b) -> named_struct('start', a.start, 'end', b.start + b.size))"
    return f"filter({joined}, s -> s.end - s.start >= {PASSAGE})"


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, n_bytes, n_repeat_bytes, n_extra_bytes, passages, extra (arrays of [start, end) in bytes)."""
    spark = df.sparkSession
    small_batches(spark)
    stage = Stage(spark, "chunks")
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("row_no", F.monotonically_increasing_id())
    places = docs.mapInArrow(_chunk_rows, with_id(docs, "row_no bigint, d0 bigint, d1 bigint, start bigint, size bigint"))
    places = stage.save(places, "places")
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no", "start")
    known = places.where("start >= 0").groupBy("d0", "d1").agg(F.min(at).alias("first"), F.min("row_no").alias("low"), F.max("row_no").alias("high"), F.count(F.lit(1)).alias("n"))
    known = known.where("n > 1").selectExpr("d0", "d1", "first.row_no first_row", "first.start first_start", "low <> high across", "n")
    known = stage.save(known, "known")
    chunks = places.where("start >= 0")
    repeats = join_counted(chunks, known, ["d0", "d1"], chunks.count()).selectExpr(
        "row_no", "start", "size", "across", "NOT (row_no = first_row AND start = first_start) extra"
    )
    chunk = F.struct("start", "size", "across", "extra")
    by_row = repeats.groupBy("row_no").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    by_row = by_row.selectExpr("row_no", "filter(chunks, c -> c.across) shared", "filter(chunks, c -> c.extra) extra")
    spans = by_row.selectExpr("row_no", f"{_passages('shared')} passages", f"{_passages('extra')} extra")
    rows = places.where("start < 0").selectExpr("row_no", "doc_id", "size n_bytes")
    none = "cast(array() AS array<struct<start:bigint,end:bigint>>)"
    total = "aggregate({0}, 0L, (s, p) -> s + p.end - p.start)"
    out = rows.join(spans, "row_no", "left").selectExpr(
        "doc_id", "n_bytes", f"coalesce(passages, {none}) passages", f"coalesce(extra, {none}) extra"
    )
    return out.selectExpr(
        "doc_id", "n_bytes", f"{total.format('passages')} n_repeat_bytes", f"{total.format('extra')} n_extra_bytes", "passages", "extra"
    )

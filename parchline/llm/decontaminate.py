"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of e is split into e + 1 pieces: wherever at most e edits
were made, one piece stands unchanged. An Aho-Corasick automaton over all pieces finds
exact hits in one pass over a text; each hit places a window that Myers' bit-parallel
algorithm verifies by the item's edit distance to the window's best substring.
Texts and items are compared in lower case with white space folded to one blank.

An automaton holds PART_BYTES of the benchmark, or one item, which are broadcast. A larger benchmark goes by parts: each
scans all documents, whose hits so far are written to the shared folder in between. Documents are
scanned where they lie, without a shuffle; a worker builds a part's automaton once.

Defined results. Null and empty texts hit nothing; null and empty items match nothing; rows that repeat an
item's id and text count once. Repeated documents and null
ids are scanned row by row. Extra columns are ignored. Items too short for two
pieces of MIN_PIECE characters have no error budget: they match exactly. An empty
benchmark or empty documents give no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, small_batches, with_id

#: Share of an item's characters that may be edited; shortest piece of an item.
ERROR_RATE, MIN_PIECE = 0.08, 11
#: Bytes of the items that one scan looks for.
PART_BYTES = 2 << 20


def fold(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(item: str) -> int:
    """Edits allowed in an item: a share of its length, few enough that pieces stay specific."""
    return max(0, min(int(len(item) * ERROR_RATE), len(item) // MIN_PIECE - 1))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``errors`` + 1 pieces of nearly equal length."""
    ends = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:]) if b > a]


class Pattern:
    """Myers' bit-parallel approximate search for one item."""

    def __init__(self, item: str):
        self.size, self.masks = len(item), {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """Least edit distance of the item to a substring of text, and where the first such substring ends."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, distance = full, 0, self.size
        least, end = self.size, 0
        for i, c in enumerate(text, 1):
            eq = self.masks.get(c, 0)
            x = eq | minus
            d = (((x & plus) + plus) ^ plus) | x
            up, down = minus | (~(d | plus) & full), plus & d
            if up & top:
                distance += 1
            elif down & top:
                distance -= 1
            up, down = (up << 1) & full, (down << 1) & full  # a match may begin anywhere
            plus, minus = down | (~(d | up) & full), up & d
            if distance < least:
                least, end = distance, i
        return least, end


class Searcher:
    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items, self.patterns, at = [], {}, {}
        for item_id, text in items:
            folded = fold(text)
            if folded:
                e = budget(folded)
                for offset, piece in pieces(folded, e):
                    at.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((item_id, folded, e))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def hits(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the folded text) of each item's best match in the text, within its budget."""
        if not self.items or not text:
            return []
        folded = fold(text)
        seen: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(folded):
            for k, offset in places:
                _, item, e = self.items[k]
                low = max(0, end + 1 - size - offset - e)
                high = low + len(item) + 2 * e
                spans = seen.setdefault(k, [])
                if spans and low <= spans[-1][1] - len(item) + e:  # the same place, by another piece
                    spans[-1] = [min(spans[-1][0], low), max(spans[-1][1], high)]
                else:
                    spans.append([low, high])
        out = []
        for k, spans in seen.items():
            item_id, item, e = self.items[k]
            best = (e + 1, 0)
            for low, high in spans:
                window = folded[low:high]
                found = window.find(item)
                if found >= 0:
                    best = min(best, (0, low + found + len(item)))
                elif best[0]:
                    if k not in self.patterns:
                        self.patterns[k] = Pattern(item)
                    distance, end = self.patterns[k].best(window)
                    best = min(best, (distance, low + end))
            if best[0] <= e:
                out.append((item_id, *best))
        return out


_HITS = "array<struct<item_id:bigint,distance:bigint,end:bigint>>"
_SEARCHERS: dict[str, Searcher] = {}


def _searcher(part) -> Searcher:
    """One automaton for each part of a benchmark, known by its digest, and worker; workers outlive tasks."""
    digest, items = part.value
    if digest not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[digest] = Searcher(items)
    return _SEARCHERS[digest]


def _parts(items: DataFrame, limit: int) -> Iterator[tuple[str, list[tuple[int, str]]]]:
    """The items in parts of about ``limit`` bytes at most, or of one item, with each part's digest."""
    sized = items.where("octet_length(text) > 0").distinct()
    total = sized.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-total // limit))
    while True:
        dealt = sized.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
        sizes = dealt.groupBy("part").agg(F.sum(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("n"))
        if sizes.where(f"size > {2 * limit} AND n > 1").isEmpty():
            break
        count *= 2
    for k in range(count):
        rows = [(r["item_id"], r["text"]) for r in dealt.where(F.col("part") == k).collect()]
        if rows:
            yield hashlib.blake2b(repr(sorted(rows, key=repr)).encode("utf-8", "replace"), digest_size=16).hexdigest(), rows


def _scan(rows: DataFrame, part: tuple[str, list], texts: bool) -> DataFrame:
    """``rows`` (doc_id, text, hits) with the part's hits added; without ``texts`` the texts go."""
    shared = rows.sparkSession.sparkContext.broadcast(part)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(shared)
        for batch in batches:
            found = [
                (old or []) + [{"item_id": i, "distance": d, "end": e} for i, d, e in searcher.hits(t)]
                for old, t in zip(batch.column("hits").to_pylist(), batch.column("text").to_pylist())
            ]
            kept = {"text": batch.column("text")} if texts else {}
            yield pa.record_batch({"doc_id": batch.column("doc_id"), **kept, "hits": pa.array(found, kind)})

    return rows.mapInArrow(run, with_id(rows, "text string, " * texts + f"hits {_HITS}"))


def matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """doc_id, hits (array of item_id, distance, end) of every document, by item_id."""
    spark = docs.sparkSession
    small_batches(spark)
    given = items.select(F.col(item_id_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast(_HITS).alias("hits"))
    parts = _parts(given, part_bytes)
    part, k, stage = next(parts, None), 0, Stage(spark, "decontaminate")
    while part is not None:
        after = next(parts, None)
        if after is None:
            rows = _scan(rows, part, texts=False)
        else:
            rows = stage.save(_scan(rows, part, texts=True), f"part-{k}")
            if k:
                stage.drop(f"part-{k - 1}")
        part, k = after, k + 1
    return rows.select("doc_id", F.coalesce(F.array_sort("hits"), F.array().cast(_HITS)).alias("hits"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item within its budget."""
    spark = docs.sparkSession
    packed = docs.select(F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = matches(packed, items, "row", "text", item_id_col, item_text_col).where("size(hits) = 0")
    return kept.select("doc_id.*")

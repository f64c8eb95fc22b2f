"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Method. A document's set is its distinct word shingles. Two permutations of D
positions make all signature coordinates: the first places a shingle, the second,
circularly shifted by k, gives coordinate k's minimum. Bands of r coordinates
propose pairs; every proposed link is confirmed on the full shingle sets.

Scale.
* Texts with equal sets collapse to one node first, so groups of exact copies of any
  size cost one row afterwards.
* In a bucket every node meets two centres (the bucket's smallest and largest node),
  never every other node. After these links become components, only nodes outside
  their centre's component meet the rest of the bucket, and a parity sketch, which
  bounds the symmetric difference from below, throws out pairs inside the join.
* Only texts of nodes in pairs are shuffled for verification, and a centre's text goes once to
  each GROUP of its pairs.
* Buckets and components that hold a thousandth of all rows are joined by broadcast of
  their one row, a thousand rows at most, so no task gets a hot one whole.
* Components come from alternating large-star and small-star steps over tables
  in the shared folder; nothing is collected. Their rows are pairs of numbers; a node with very many
  neighbours is left to the adaptive skew join.

Defined results. Null or empty texts and texts without words have an empty set: zero
shingles, a component of their own. Null ids never become a component id while the
group has another one. Repeated rows keep their own output rows. Extra columns of the
input are ignored, whatever their names. Empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, join_counted, mix, small_batches, to_bytes, window_hashes, with_id, word_hashes

WORDS = 5
ROWS, BANDS = 4, 28  # at similarity 0.75 one pair in 42,000 shares no band
POSITIONS = 1 << 21
#: 100 * intersection >= PERCENT * union
PERCENT = 75

#: Bits of the filter for texts that are needed again; pairs of a node that share one copy of its text.
FILTER_BITS, GROUP = 1 << 24, 64

_TABLES: dict[str, np.ndarray] = {}


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The placing permutation and the circulant one, extended so that shifts need no modulo."""
    if not _TABLES:
        rng = np.random.default_rng(77)
        place = rng.permutation(POSITIONS).astype(np.int32)
        ring = rng.permutation(POSITIONS).astype(np.uint32)
        k = ROWS * BANDS
        _TABLES["place"] = place
        _TABLES["ring"] = np.lib.stride_tricks.sliding_window_view(np.concatenate((ring, ring[:k])), k)
    return _TABLES["place"], _TABLES["ring"]


def signature(shingles: np.ndarray) -> np.ndarray:
    place, ring = _permutations()
    at = place[(shingles >> np.uint64(43)).astype(np.int64)]
    best = np.full(ROWS * BANDS, POSITIONS, dtype=np.uint32)
    for i in range(0, len(at), 1024):
        np.minimum(best, ring[at[i : i + 1024]].min(axis=0), out=best)
    return best


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [np.unique(window_hashes(w, words)) for w in word_hashes(texts, lower=True)]


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the shingles that fall to i; differing bits bound the symmetric difference from below."""
    width = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(to_bytes(batch.column("text").to_pylist()))
        full = [len(s) > 0 for s in sets]
        if any(full):
            sig = np.stack([signature(s) for s in sets if len(s)]).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
            for r in range(ROWS):
                key = mix(key * np.uint64(0x9FB21C651E98DF25) + sig[:, :, r])
            keys = iter(key.view(np.int64))
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "text_hash": batch.column("text_hash"),
                "digest": pa.array([set_digest(s) if f else None for s, f in zip(sets, full)], pa.binary()),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "bands": pa.array([next(keys) if f else None for f in full], pa.list_(pa.int64())),
                "parity": pa.array([parity_sketch(s) if f else None for s, f in zip(sets, full)], pa.list_(pa.int64())),
            }
        )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose full sets are similar enough."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        texts = dict(zip(a, batch.column("text_a").to_pylist())) | dict(zip(b, batch.column("text_b").to_pylist()))
        fresh = [k for k in texts if k not in held]
        held = {k: held[k] for k in texts if k in held}
        held.update(zip(fresh, shingle_sets(to_bytes([texts[k] for k in fresh]))))
        keep = []
        for x, y in zip(a, b):
            s, t = held[x], held[y]
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(s) + len(t) - both))
        keep = np.array(keep, dtype=bool)
        yield pa.record_batch({k: pa.array(np.array(v, dtype=np.int64)[keep]) for k, v in (("a", a), ("b", b))})


def _similar(n_a: str, n_b: str, p_a: str, p_b: str) -> str:
    """SQL: sizes and parity sketches leave the pair possible. Sketches of unlike widths meet at the smaller one."""
    fold = "zip_with(slice({0}, 1, cast(size({0}) / 2 as int)), slice({0}, cast(size({0}) / 2 as int) + 1, cast(size({0}) / 2 as int)), (x, y) -> x ^ y)"
    one = f"CASE WHEN size({p_a}) > size({p_b}) THEN {fold.format(p_a)} ELSE {p_a} END"
    two = f"CASE WHEN size({p_b}) > size({p_a}) THEN {fold.format(p_b)} ELSE {p_b} END"
    apart = f"aggregate(zip_with({one}, {two}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return (
        f"100 * least({n_a}, {n_b}) >= {PERCENT} * greatest({n_a}, {n_b}) AND "
        f"{100 + PERCENT} * {apart} <= {100 - PERCENT} * ({n_a} + {n_b})"
    )


def components(stage: Stage, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that can be reached.

    Alternates large-star (every larger neighbour moves to a node's smallest
    neighbour) and small-star (every smaller one does) until nothing changes.
    """
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h"))
    edges = stage.save(edges.selectExpr("greatest(a, b) a", "least(a, b) b").where("a <> b").distinct(), f"{name}-0")
    before, k = edges.select(mark.alias("m")).first()["m"], 0
    while before["n"]:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").selectExpr("v a", "m b").distinct()
        large = stage.save(large, f"{name}-large-{k}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("b a", "m b").union(least).where("a <> b").distinct()
        edges = stage.save(small, f"{name}-{k + 1}")
        stage.drop(f"{name}-{k}", f"{name}-large-{k}")
        after, k = edges.select(mark.alias("m")).first()["m"], k + 1
        if after == before:
            break
        before = after
    return edges.selectExpr("a node", "b root")


def _verified(stage: Stage, name: str, docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that the full sets confirm; texts are read again for nodes in pairs only.

    A filter of bounded size keeps the other texts from the shuffle.
    """
    needed = pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct().join(nodes.select("nid", "rep"), "nid")
    needed = stage.save(needed.selectExpr("nid", "rep.doc_id need_id", "rep.text_hash need_hash"), f"{name}-needed")
    # One bit for each needed row, in at most FILTER_BITS / 64 words, keeps nearly all other texts from the shuffle.
    place = "pmod(xxhash64({0}, {1}), %dL)" % FILTER_BITS
    words = needed.selectExpr(f"{place.format('need_id', 'need_hash')} p").selectExpr("p DIV 64 word", "shiftleft(1L, cast(p % 64 AS int)) bit")
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    likely = docs.withColumn("p", F.expr(place.format("doc_id", "text_hash"))).withColumn("word", F.expr("p DIV 64"))
    likely = likely.join(F.broadcast(words), "word").where("getbit(bits, cast(p % 64 AS int)) = 1").select("doc_id", "text_hash", "text")
    texts = (
        likely.join(needed, F.col("doc_id").eqNullSafe(F.col("need_id")) & (F.col("text_hash") == F.col("need_hash")))
        .select("nid", "text")
        .dropDuplicates(["nid"])
    )
    total = pairs.count()
    joined = _with_text(_with_text(pairs, texts, "a", "b", total), texts, "b", "a", total)
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a bigint, b bigint")


def _with_text(pairs: DataFrame, texts: DataFrame, side: str, other: str, total: int) -> DataFrame:
    """``pairs`` with the text of one side. A node's pairs are dealt out in groups of about GROUP, each of which gets the text once."""
    load = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
    dealt = join_counted(pairs, load, [side], total).withColumn("deal", F.expr(f"pmod(xxhash64({other}), ceil(n / {GROUP}))")).drop("n")
    copies = texts.toDF(side, f"text_{side}").join(load, side).withColumn("deal", F.expr(f"explode(sequence(0L, ceil(n / {GROUP}) - 1))"))
    return dealt.join(copies.drop("n"), [side, "deal"]).drop("deal")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``df``. See the module's text for odd input."""
    spark = df.sparkSession
    small_batches(spark)
    stage = Stage(spark, "minhash")
    docs = df.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("text_hash", F.xxhash64("text"))
    described = stage.save(
        docs.mapInArrow(
            _describe, with_id(docs, "text_hash bigint, digest binary, n bigint, bands array<bigint>, parity array<bigint>")
        ),
        "described",
    )
    nodes = described.where("n > 0").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep"),
        F.first("n").alias("n"),
        F.first("bands").alias("bands"),
        F.first("parity").alias("parity"),
    )
    nodes = stage.save(nodes.select(F.monotonically_increasing_id().alias("nid"), "*"), "nodes")

    # Buckets with two nodes or more; each node meets its buckets' two centres.
    buckets = nodes.select("nid", F.explode("bands").alias("key"))
    ends = buckets.groupBy("key").agg(F.min("nid").alias("low"), F.max("nid").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    ends, total = stage.save(ends, "ends"), BANDS * nodes.count()
    met = stage.save(join_counted(buckets, ends, ["key"], total).drop("n"), "met")
    sketch = nodes.select("nid", "n", "parity")
    pairs = (
        met.select("nid", F.explode(F.array("low", "high")).alias("centre"))
        .where("nid <> centre")
        .selectExpr("least(nid, centre) a", "greatest(nid, centre) b")
        .distinct()
        .join(sketch.toDF("a", "n_a", "p_a"), "a")
        .join(sketch.toDF("b", "n_b", "p_b"), "b")
        .where(_similar("n_a", "n_b", "p_a", "p_b"))
        .select("a", "b")
    )
    pairs = stage.save(pairs, "pairs")
    links = stage.save(_verified(stage, "pairs", docs, nodes, pairs), "links")
    roots = components(stage, links, "first")

    # Nodes outside their bucket's first centre's component meet the whole bucket.
    placed = stage.save(met.join(roots.withColumnRenamed("node", "nid"), "nid", "left").selectExpr("key", "nid", "coalesce(root, nid) root"), "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("n")).where("r0 < r1")
    placed = join_counted(placed, mixed, ["key"], total).drop("n").join(sketch, "nid").select("key", "nid", "root", "r0", "n", "parity")
    placed = stage.save(placed, "mixed")
    rest = placed.where("root <> r0").selectExpr("key rest_key", "nid x", "root root_x", "n n_x", "parity p_x")
    possible = "rest_key = key AND root_x <> root AND " + _similar("n_x", "n", "p_x", "parity")
    more = rest.join(placed, F.expr(possible))
    more = stage.save(
        more.selectExpr("least(x, nid) a", "greatest(x, nid) b").distinct().join(pairs, ["a", "b"], "left_anti"), "more"
    )
    further = stage.save(_verified(stage, "more", docs, nodes, more), "further")
    if not further.isEmpty():
        roots = components(stage, roots.toDF("a", "b").union(further), "second")

    # Of linked nodes the smallest id of their component; a root is a member of its own.
    members = roots.union(roots.select("root", "root").distinct()).join(nodes.selectExpr("nid node", "rep.doc_id least_id"), "node")
    members = stage.save(members, "members")
    ids = members.groupBy("root").agg(F.min("least_id").alias("group_id"), F.count(F.lit(1)).alias("n"))
    grouped = join_counted(members, ids, ["root"], members.count()).selectExpr("node nid", "group_id")
    named = nodes.selectExpr("nid", "digest", "rep.doc_id least_id").join(grouped, "nid", "left")
    named = stage.save(named.selectExpr("digest", "coalesce(group_id, least_id) component_id"), "named")
    stage.drop("ends", "met", "pairs", "pairs-needed", "links", "placed", "mixed", "more", "more-needed", "further", "members", "nodes")
    rows = described.selectExpr("doc_id", "n n_shingles", "digest")
    full = rows.where("n_shingles > 0").join(named, "digest").select("doc_id", "n_shingles", "component_id")
    empty = rows.where("n_shingles = 0").selectExpr("doc_id", "n_shingles", "doc_id component_id")
    return full.unionByName(empty).selectExpr("*", "doc_id <=> component_id kept")

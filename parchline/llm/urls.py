"""URL filters by a Bloom filter cascade.

Rules are keys of host and path prefix (``example.net/en/``). A url's candidate keys are its
host suffixes (of as many labels as some rule has) with its path prefixes (as long
as some rule's). The complete universe is every distinct candidate key of the corpus. Level 1
encodes the listed keys; level 2 encodes the universe's false positives of level 1; level 3
the listed keys that level 2 takes for false positives, and so on, until a level has
none left. A key's first level that denies it decides, so over this universe
membership is exact, without joins.

Two cascades: one over all rules' keys (does a rule fit?), one over the blocking ones
(what does it say?). The longest fitting key wins; equally long ones: the longer host.
A url that no rule fits gets ``default``.

Scale. Level 1 has a false positive rate of about listed / universe, so a cascade's
size follows the list of rules, which is the caller's. A cascade takes PART_RULES rules; a longer list goes by
parts, each with cascades of its own over its part of the candidate keys, and the longest of the parts' rules
wins. So no level has more than about 40 * PART_RULES bits. Keys are hashed in the JVM; a
level's bits come from a distributed aggregation of bit positions, never from collected
keys. Urls are judged row by row; only the universe's distinct keys are shuffled.

Defined results. Null urls or urls without ``://``: empty host and path, no rule, the default. Repeated
rows and null ids stay rows of their own. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage

#: Hash functions of a level; rules of one cascade.
HASHES, PART_RULES = 4, 2000
MAX_LEVELS = 40


def host_and_path(url: str) -> tuple[str, str]:
    """SQL of a url's host (A-Z in lower case) and path; both empty for null or without ``://``."""
    rest = f"substring({url}, locate('://', {url}) + 3)"
    ok = f"locate('://', {url}) > 0"
    host = f"CASE WHEN {ok} THEN translate(regexp_extract({rest}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
    path = f"CASE WHEN {ok} THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END"
    return host, path


def candidates(host: str, path: str, rules: list[str]) -> str:
    """SQL: distinct candidate keys of a url, longest first, then those with the longer host."""
    labels = sorted({r.split("/", 1)[0].count(".") + 1 for r in rules})
    lengths = sorted({len(r.split("/", 1)[1]) + 1 if "/" in r else 0 for r in rules})
    keys = ", ".join(
        f"CASE WHEN char_length({path}) >= {n} AND size(split({host}, '[.]', -1)) >= {k} "
        f"THEN named_struct('key', concat(substring_index({host}, '.', -{k}), substring({path}, 1, {n})), 'labels', {k}) END"
        for k in labels
        for n in lengths
    )
    order = (
        "(a, b) -> CASE WHEN char_length(a.key) <> char_length(b.key) THEN char_length(b.key) - char_length(a.key) ELSE b.labels - a.labels END"
    )
    return f"array_distinct(transform(array_sort(array_compact(array({keys})), {order}), x -> x.key))"


def _positions(key: str, level: int, bits: int) -> str:
    """SQL: the bit positions of a key at a level, by double hashing."""
    a, b = (f"pmod(xxhash64({key}, {2 * level + k}), {bits}L)" for k in (0, 1))
    return "array({})".format(", ".join(f"({a} + {i}L * {b}) % {bits}L" for i in range(HASHES)))


class Cascade:
    """Levels of (bits, words); a word holds 64 bits."""

    def __init__(self, levels: list[tuple[int, list[int]]]):
        self.levels = levels

    def holds(self, key: str) -> str:
        """SQL: whether a key of the universe is listed."""
        out = "true" if len(self.levels) % 2 else "false"  # what the last level lets through is sure
        for level in range(len(self.levels) - 1, -1, -1):
            bits, words = self.levels[level]
            out = f"CASE WHEN NOT {_test(key, level, bits, words)} THEN {'false' if level % 2 == 0 else 'true'} ELSE {out} END"
        return out


def _test(key: str, level: int, bits: int, words: list[int]) -> str:
    table = "array({})".format(", ".join(f"{w}L" if w != -(1 << 63) else "-9223372036854775807L - 1L" for w in words))
    return f"forall({_positions(key, level, bits)}, p -> getbit(element_at({table}, cast(p DIV 64 AS int) + 1), cast(p % 64 AS int)) = 1)"


def _bits(keys: DataFrame, level: int, count: int, rate: float) -> tuple[int, list[int]]:
    """A level's bits: distinct positions of all its keys, at most as many as it has bits."""
    bits = max(64, 64 * math.ceil(-count * math.log(min(rate, 0.5)) / math.log(2) ** 2 / 64))
    words = [0] * (bits // 64)
    rows = keys.select(F.explode(F.expr(_positions("key", level, bits))).alias("p")).groupBy((F.col("p") / 64).cast("bigint").alias("w"))
    for row in rows.agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS int)))").alias("v")).collect():
        words[row["w"]] = row["v"]
    return bits, words


def build(listed: list[str], universe: DataFrame) -> Cascade:
    """The cascade that tells ``listed`` keys, PART_RULES at most, from the other keys of ``universe`` (distinct ``key``)."""
    if len(listed) > PART_RULES:
        raise ValueError(f"a cascade takes {PART_RULES} keys; judge() deals longer lists out")
    inside, outside = universe.where(F.col("key").isin(listed)), universe.where(~F.col("key").isin(listed))
    n, others = inside.count(), outside.count()
    levels: list[tuple[int, list[int]]] = []
    rate = min(0.5, max(n, 1) / max(others, 1))
    sides = [(inside, n), (outside, others)]
    while n and len(levels) < MAX_LEVELS:
        level = len(levels)
        own, count = sides[level % 2]
        other, _ = sides[1 - level % 2]
        bits, words = _bits(own, level, count, rate if level == 0 else 0.5)
        levels.append((bits, words))
        passed = other.where(_test("key", level, bits, words))
        left = passed.count()
        sides[1 - level % 2] = (passed, left)
        if not left:
            return Cascade(levels)
    if levels:
        raise ValueError("the cascade doesn't end: keys collide in every level")
    return Cascade([])


def judge(
    df: DataFrame, block: list[str], allow: list[str], id_col: str = "page_id", url_col: str = "url", default: str = "allow", part_rules: int = PART_RULES
) -> DataFrame:
    """page_id, host, path, rule, verdict of every row. A key on both lists allows."""
    spark = df.sparkSession
    block = [r for r in dict.fromkeys(block) if r not in allow]
    rules = block + list(dict.fromkeys(allow))
    host, path = host_and_path("url")
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    pages = pages.selectExpr("page_id", f"{host} host", f"{path} path")
    if not rules:
        return pages.selectExpr("page_id", "host", "path", "cast(null AS string) rule", f"'{default}' verdict")
    stage = Stage(spark, "urls")
    best = pages.selectExpr("page_id", "host", "path", "cast(null AS string) rule", "cast(null AS boolean) blocks")
    parts = [rules[i : i + part_rules] for i in range(0, len(rules), part_rules)]
    for k, part in enumerate(parts):
        keyed = best.withColumn("keys", F.expr(candidates("host", "path", part)))
        universe = stage.save(keyed.select(F.explode("keys").alias("key")).distinct(), f"universe-{k}")
        fits, blocks = build(part, universe), build([r for r in part if r in set(block)], universe)
        found = keyed.withColumn("found", F.expr(f"get(filter(keys, k -> {fits.holds('k')}), 0)") if fits.levels else F.lit(None).cast("string"))
        found = found.withColumn("says", F.expr(blocks.holds("found")))
        stage.drop(f"universe-{k}")
        longer = "found IS NOT NULL AND (rule IS NULL OR char_length(found) > char_length(rule) OR (char_length(found) = char_length(rule) AND locate('/', found) > locate('/', rule)))"
        best = found.selectExpr(
            "page_id", "host", "path", f"CASE WHEN {longer} THEN found ELSE rule END rule", f"CASE WHEN {longer} THEN says ELSE blocks END blocks"
        )
        if k < len(parts) - 1:
            best = stage.save(best, f"best-{k}")
            if k:
                stage.drop(f"best-{k - 1}")
    verdict = f"CASE WHEN rule IS NULL THEN '{default}' WHEN blocks THEN 'block' ELSE 'allow' END verdict"
    return best.selectExpr("page_id", "host", "path", "rule", verdict)

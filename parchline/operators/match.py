"""Skills and job titles: look-up ladders, similarity for the rest, groups and statistics.

Dictionaries have a fixed size, so they are literals inside expressions (no join, no shuffle). Similarity
sees distinct values only that every exact step missed.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import (
    CAREER_LEVELS,
    ROLE_ABBREVIATIONS,
    SENIORITY,
    SKILL_ALIASES,
    SKILL_CATEGORIES,
    SKILL_GROUPS,
    STANDARD_TITLES,
    TITLE_KEYWORDS,
)
from ..functions.dates import let
from ..functions.similarity import lcs, possible, sorted_tokens
from ..functions.text import distinct_ignoring_case, title_case

SKILLS = list(dict.fromkeys(s for group in SKILL_CATEGORIES.values() for s in group))
CATEGORY = {s: c for c, group in reversed(SKILL_CATEGORIES.items()) for s in group}
# Words that are no skills.
STOP_WORDS = "the and for with from this that have been will are was experience knowledge understanding ability proficient familiar working".split()


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _quoted(xs: list[str]) -> str:
    return "array({})".format(", ".join("'" + x.replace("'", "\\'") + "'" for x in xs))


def loose_key(c: Column) -> Column:
    """Lower case without punctuation, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9_\s]", ""), r"\s+", " "))


def is_valid_skill(c: Column) -> Column:
    t = F.trim(c)
    return F.length(t).between(2, 50) & ~t.rlike("^[0-9]+$") & ~F.lower(t).isin(STOP_WORDS) & t.rlike(r"\p{L}")


def _top(query: str, choices: list[str], cutoff: float, ordered: bool) -> str:
    """SQL: (score, -position, choice) of the first best choice by (token-sorted) ratio; null under the cutoff."""
    q = sorted_tokens(query) if ordered else query
    keys = [" ".join(sorted(c.split())) if ordered else c for c in choices]
    pairs = ", ".join(f"named_struct('k', '{k}', 'c', '{c}')" for k, c in zip([k.replace("'", "\\'") for k in keys], [c.replace("'", "\\'") for c in choices]))
    score = f"200D * ({lcs('q', 'x.k')}) / (char_length(q) + char_length(x.k))"
    scored = f"transform(filter(array({pairs}), x -> {possible('q', 'x.k', cutoff)}), (x, i) -> named_struct('score', {score}, 'at', -i, 'choice', x.c))"
    return f"element_at(transform(array({q}), q -> array_max(filter({scored}, s -> s.score >= {cutoff}))), 1)"


def _distinct(values: DataFrame, col: str) -> DataFrame:
    """original, written: distinct values, twice.

    ``written`` needs the rows' count, so a later filter on what a ladder finds in it stays above the aggregation. On the key alone the planner would
    move the filter, and with it the whole ladder, below the aggregation and to the other side of a join, to every row.
    """
    counted = values.select(F.col(col).alias("original")).groupBy("original").agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("original", F.when(F.col("rows") > 0, F.col("original")).alias("written"))


def match_skills(values: DataFrame, col: str = "skill", threshold: float = 80, skills: list[str] = SKILLS) -> DataFrame:
    """Distinct values with matched, score and method.

    exact 1.0, alias .95, normalised key .92, similar (token-sorted, >= threshold) score / 100,
    substring .70 (four letters or more, first in order), unmatched .50.
    """
    loose = {}
    for s in skills:
        loose.setdefault("".join(ch for ch in s if ch.isalnum() or ch in " _").strip(), s)
    v = _distinct(values.where(F.col(col).isNotNull()), col)
    v = v.withColumn("low", F.lower(F.trim("written")))
    v = v.withColumn("exact", F.when(F.col("low").isin(skills), F.col("low")))
    v = v.withColumn("alias", F.try_element_at(_map(SKILL_ALIASES), F.col("low")))
    v = v.withColumn("keyed", F.try_element_at(_map(loose), loose_key(F.col("low"))))
    known = F.coalesce("exact", "alias", "keyed")
    v = v.withColumn("near", F.when(known.isNull() & (F.length("low") > 0), F.expr(_top("low", skills, threshold, True))))
    part = f"get(filter({_quoted(skills)}, s -> char_length(s) >= 4 AND char_length(low) >= 4 AND (contains(low, s) OR contains(s, low))), 0)"
    v = v.withColumn("part", F.when(known.isNull() & F.col("near").isNull(), F.expr(part)))
    steps = [("exact", F.col("exact"), F.lit(1.0)), ("alias", F.col("alias"), F.lit(0.95)), ("normalized", F.col("keyed"), F.lit(0.92)), ("fuzzy", F.col("near.choice"), F.round(F.col("near.score") / 100, 3)), ("substring", F.col("part"), F.lit(0.70))]
    method, score = F.lit("unmatched"), F.lit(0.50)
    for name, found, points in reversed(steps):
        method, score = F.when(found.isNotNull(), F.lit(name)).otherwise(method), F.when(found.isNotNull(), points).otherwise(score)
    return v.select("original", F.coalesce(*[f for _, f, _ in steps], F.col("low")).alias("matched"), score.alias("score"), method.alias("method"))


def match_and_normalize(rows: DataFrame, key: str, order: str, col: str = "skill", least: float = 0.60) -> DataFrame:
    """``key``, skills: each key's matched names in order, once each; matches under ``least`` (so all unmatched ones) go.

    Distinct values are matched once; names repeated within a key are reduced before its rows meet. A key without a match has an empty list.
    """
    names = match_skills(rows, col).where(F.col("score") >= least).select(F.col("original").alias(col), "matched")
    placed = rows.select(key, order, col).join(names, col, "left").groupBy(key, "matched").agg(F.min(order).alias("at"))
    kept = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("matched").isNotNull(), F.struct("at", "matched")))).alias("m"))
    return kept.select(key, F.transform("m", lambda x: x["matched"]).alias("skills"))


def taxonomy(spark: SparkSession, path: str | None = None, builtin: list[str] = SKILLS) -> DataFrame:
    """skill: the built-in names and those of JSON files (a list, or an object whose ``skills`` is one), lower-cased, trimmed, once each.

    Members that aren't strings and files that aren't JSON are passed over; a missing path gives the built-in names alone.
    """
    own = spark.createDataFrame([(s,) for s in builtin], "skill string")
    if path is None:
        return own
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return own
    whole = files.select(F.try_parse_json("value").alias("v"))
    listed = whole.select(F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")).otherwise(F.try_variant_get("v", "$.skills", "variant")).alias("v"))
    listed = listed.where(F.schema_of_variant("v").startswith("ARRAY"))
    each = listed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).where(F.schema_of_variant("value") == "STRING")
    names = each.select(F.trim(F.lower(F.try_variant_get("value", "$", "string"))).alias("skill"))
    return own.unionByName(names.where("skill <> ''")).distinct()


def match_statistics(matches: DataFrame) -> DataFrame:
    """total, average score, counts by method, how many are sure (>= .85) and unsure (< .60)."""
    by = matches.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.sum((F.col("score") >= 0.85).cast("bigint")).alias("high"), F.sum((F.col("score") < 0.60).cast("bigint")).alias("low")
    )
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.round(F.sum("s") / F.sum("n"), 3).alias("average"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "n")))).alias("by_method"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("high_confidence"),
        F.coalesce(F.sum("low"), F.lit(0)).alias("low_confidence"),
    )


def quick_normalize(xs: Column, known: list[str] = SKILLS, keep_unknown: bool = False) -> Column:
    """An array's skills by the exact, alias and key steps alone; unknown ones go unless ``keep_unknown``; ordered distinct."""
    loose = {}
    for s in known:
        loose.setdefault("".join(ch for ch in s if ch.isalnum() or ch in " _").strip(), s)
    names, alias, keys = _map({s: s for s in known}), _map(SKILL_ALIASES), _map(loose)
    one = lambda x: F.coalesce(F.try_element_at(names, F.lower(F.trim(x))), F.try_element_at(alias, F.lower(F.trim(x))), F.try_element_at(keys, loose_key(x)), *([F.trim(x)] if keep_unknown else []))
    return F.array_distinct(F.array_compact(F.transform(xs, one)))


def category(c: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(CATEGORY), F.lower(F.trim(c))), F.lit("other"))


def categorize(xs: Column) -> Column:
    """Map of category to skills, empty categories left out."""
    names = [*SKILL_CATEGORIES, "other"]
    return _grouped(xs, names, category)


def _grouped(xs: Column, names: list[str], of) -> Column:
    """Map of name to the elements that ``of`` gives it, empty ones left out."""
    tagged = F.transform(xs, lambda x: F.struct(of(x).alias("g"), x.alias("x")))
    groups = F.transform(
        F.array(*[F.lit(n) for n in names]),
        lambda g: F.struct(g.alias("key"), F.transform(F.filter(tagged, lambda t: t["g"] == g), lambda t: t["x"]).alias("value")),
    )
    return F.map_from_entries(F.filter(groups, lambda e: F.size(e["value"]) > 0))


def group_related(xs: Column) -> Column:
    """Map of related group to skills; a skill stays in its first group, the rest under ``other``."""
    owner: dict[str, str] = {}
    for g, members in SKILL_GROUPS.items():
        for m in members:
            owner.setdefault(m, g)
    of = lambda x: F.coalesce(F.try_element_at(_map(owner), F.lower(x)), F.lit("other"))
    return _grouped(xs, [*SKILL_GROUPS, "other"], of)


def parse_skill_lines(lines: Column) -> Column:
    """Skills of a section's lines: text after a label's colon, bullets off, split at commas, semicolons, bars and dots."""
    body = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*[-•*]\s*", ""), r"^\s*[A-Za-z][A-Za-z &/]{1,30}:\s*", ""))
    parts = F.flatten(F.transform(body, lambda x: F.split(x, r"\s*[,;|•·]\s*")))
    short = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: (F.length(x) > 1) & (F.size(F.split(x, r"\s+")) <= 4))
    return distinct_ignoring_case(short)


def mine_skills(text: Column, skills: list[str] = SKILLS) -> Column:
    """Taxonomy skills anywhere in a text, in taxonomy order.

    The text becomes one blank-padded string of tokens [A-Za-z0-9+#./-], trailing dots off. Skills of one word are met by hashing the distinct
    tokens, the others, if their longest word is met so, are plain substrings between blanks; no pattern is compiled for any skill, and one- or two-letter names need their own token.
    """
    between = "".join(chr(i) for i in range(128) if not re.match(r"[a-z0-9+#./&-]", chr(i)))
    blank = F.regexp_replace(F.translate(F.lower(text), between, " " * len(between)), r"[^\x00-\x7F]", " ")  # several times faster than one negated class of many parts
    flat = F.regexp_replace(F.regexp_replace(blank, " {2,}", " "), r"\.(?= |$)", "")
    single, several = [s for s in skills if " " not in s], [s for s in skills if " " in s]
    word = {s: max(s.split(), key=len) for s in several}
    listed = F.array(*[F.lit(x) for x in dict.fromkeys([*single, *word.values()])])

    def body(p: Column) -> Column:
        def longer(tokens: Column) -> Column:
            held = F.filter(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(w).alias("w")) for s, w in word.items()]), lambda x: F.array_contains(tokens, x["w"]) & F.contains(p, F.concat(F.lit(" "), x["s"], F.lit(" "))))
            return F.concat(F.array_intersect(F.array(*[F.lit(s) for s in single]), tokens), F.transform(held, lambda x: x["s"]))

        tokens = F.array_intersect(listed, F.split(p, " "))
        found = let(tokens, lambda xs: F.when(F.size(xs) > 0, longer(xs)).otherwise(xs))
        return let(found, lambda xs: F.when(F.size(xs) > 0, F.array_intersect(F.array(*[F.lit(s) for s in skills]), xs)).otherwise(xs))

    found = let(F.concat(F.lit(" "), flat, F.lit(" ")), body)
    return F.coalesce(found, F.array().cast("array<string>"))


# --- titles ---

_RANKED = sorted(SENIORITY, key=lambda k: -len(k))


def _seniority_word(title: Column, faithful: bool = False) -> Column:
    """The longest seniority key in a title, between blanks unless ``faithful``."""
    keys = F.array(*[F.lit(k) for k in _RANKED])
    if faithful:
        return F.get(F.filter(keys, lambda k: F.contains(F.lower(title), k)), F.lit(0))
    return F.get(F.filter(keys, lambda k: F.contains(_padded(title), F.concat(F.lit(" "), k, F.lit(" ")))), F.lit(0))


def _padded(title: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9.\-/+#]+", " ")), F.lit(" "))


def seniority(title: Column, faithful: bool = False) -> Column:
    """Normal form of the longest seniority word in a title; parts of words count only when ``faithful``."""
    return F.try_element_at(_map(SENIORITY), _seniority_word(title, faithful))


def without_seniority(title: Column) -> Column:
    """The title in lower case without its seniority word."""
    word = F.coalesce(F.concat(F.lit(" "), _seniority_word(title), F.lit(" ")), F.lit("\n"))
    return F.trim(F.regexp_replace(F.replace(_padded(title), word, F.lit(" ")), r"\s+", " "))


def normalize_titles(values: DataFrame, col: str = "title") -> DataFrame:
    """Distinct titles with normalized, seniority, role, confidence and career level.

    Role: standard title 1.0, abbreviation .95, similar standard title (token-sorted, >= 70) score / 100, keyword table .65, title case .50.
    """
    v = _distinct(values.where(F.trim(F.col(col)) != ""), col)
    v = v.withColumn("seniority", seniority(F.col("written"))).withColumn("rest", without_seniority(F.col("written")))
    v = v.withColumn("rest", F.when(F.col("rest") == "", F.lower(F.trim("written"))).otherwise(F.col("rest")))
    key = F.trim(F.regexp_replace(F.regexp_replace("rest", r"[^a-z0-9_\s]", " "), r"\s+", " "))
    standard = {" ".join("".join(ch if ch.isalnum() else " " for ch in t.lower()).split()): t for t in STANDARD_TITLES}
    v = v.withColumn("exact", F.try_element_at(_map(standard), key)).withColumn("short", F.try_element_at(_map(ROLE_ABBREVIATIONS), F.col("rest")))
    near = _top("rest", [t.lower() for t in STANDARD_TITLES], 70, True)
    v = v.withColumn("near", F.when(F.col("exact").isNull() & F.col("short").isNull(), F.expr(near)))
    v = v.withColumn("near_title", F.try_element_at(_map({t.lower(): t for t in STANDARD_TITLES}), F.col("near.choice")))
    part = F.lit(None).cast("string")
    for role, words in reversed(TITLE_KEYWORDS.items()):
        test = None
        for w in words:
            test = F.col("rest").contains(w) if test is None else test | F.col("rest").contains(w)
        part = F.when(test, F.lit(role.title())).otherwise(part)
    v = v.withColumn("part", part)
    v = v.withColumn("role", F.coalesce("exact", "short", "near_title", "part", title_case(F.col("rest"))))
    v = v.withColumn(
        "confidence",
        F.when(F.col("exact").isNotNull(), 1.0).when(F.col("short").isNotNull(), 0.95).when(F.col("near_title").isNotNull(), F.round(F.col("near.score") / 100, 3)).when(F.col("part").isNotNull(), 0.65).otherwise(0.50),
    )
    level = F.coalesce(F.try_element_at(_map(CAREER_LEVELS), F.lower("seniority")), F.lit("mid"))
    return v.select("original", F.concat_ws(" ", "seniority", "role").alias("normalized"), "seniority", "role", "confidence", level.alias("career_level"))

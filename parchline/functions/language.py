"""Language of a text by shares of frequent function words; texts under fifty characters default to English."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import let

# Frequent words by language; names by code.
WORDS = {
    "en": "the and of to in is that it for with as on be by this are was from".split(),
    "de": "der die das und in zu den ist von mit sich des dem ein nicht eine auf im".split(),
    "fr": "le la les de des et en un une du que qui dans est pour par sur elle".split(),
    "es": "el la los las de que y en un una del se por con para es su al".split(),
}
NAMES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "nl": "Dutch"}
MIN_CHARS, MIN_SHARE = 50, 0.5


def detect(text: Column) -> Column:
    """Struct of language, share (of all function words found) and reliable; whole texts count."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-zà-ÿ]+")
    listed = F.filter(words, lambda w: w.isin(sorted({w for ws in WORDS.values() for w in ws})))
    counts = let(listed, lambda found: F.struct(*[_hits(found, ws).alias(k) for k, ws in WORDS.items()]))

    def body(n: Column) -> Column:
        total = n["en"] + n["de"] + n["fr"] + n["es"]
        best = F.array_max(F.array(*[F.struct(n[k].alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("k")) for i, k in enumerate(WORDS)]))
        share = F.when(total > 0, F.round(best["n"] / total, 3)).otherwise(0.0)
        return F.struct(best["k"].alias("k"), share.alias("share"))

    def verdict(p: Column) -> Column:
        sure = F.coalesce((F.length(text) >= MIN_CHARS) & (p["share"] >= MIN_SHARE), F.lit(False))
        return F.struct(F.when(sure, p["k"]).otherwise("en").alias("language"), F.when(sure, p["share"]).otherwise(0.0).alias("share"), sure.alias("reliable"))

    return let(let(counts, body), verdict)


def _hits(words: Column, listed: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(listed)))


def name(code: Column) -> Column:
    """A language's name by its code; the code in capitals where it isn't listed."""
    listed = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(listed, F.lower(code)), F.upper(code))

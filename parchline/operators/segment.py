"""Sections: header decisions, keyword look-ups and the carry-forward of the current section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dims import SECTION_KEYWORDS
from ..functions import regexes as R
from ..functions.dates import let
from ..functions.similarity import best_match
from ..functions.text import has_date_range, has_email, has_linkedin, is_all_caps, section_key

_KEYWORDS = [(k, s) for s, ks in SECTION_KEYWORDS.items() for k in ks]


def keyword_section(key: Column) -> Column:
    """Exact keyword's section, else that of the first keyword over four letters inside the text."""
    exact = F.create_map(*[F.lit(x) for k, s in dict(_KEYWORDS).items() for x in (k, s)])
    return let(key, lambda x: F.coalesce(F.try_element_at(exact, x), *[F.when(x.contains(k), F.lit(s)) for k, s in _KEYWORDS if len(k) > 4]))


def fuzzy_section(key: str, cutoff: float = 75) -> Column:
    """Section of the keyword most like ``key`` (a column's name)."""
    exact = F.create_map(*[F.lit(x) for k, s in dict(_KEYWORDS).items() for x in (k, s)])
    return F.try_element_at(exact, best_match(key, list(dict(_KEYWORDS)), cutoff)["choice"])


def header_section(text: Column, font_size: Column, is_bold: Column, is_header: Column) -> Column:
    """The section that a block opens, or null: no long lines, dates or contact data; a typographic sign and a keyword."""
    t = F.trim(text)
    key, words = section_key(t), F.size(F.split(F.trim(t), r"\s+"))
    out = (F.length(t) > 80) | (t == "") | has_date_range(t) | has_email(t) | has_linkedin(t)
    sign = is_header | (font_size >= 12) | is_bold | is_all_caps(t) | t.endswith(":")
    bare = words <= 5
    return F.when(~F.coalesce(out, F.lit(True)) & (sign | bare), keyword_section(key))


def segment_blocks(blocks: DataFrame, order: str = "block_seq") -> DataFrame:
    """``section`` of every block that isn't a header; what comes before the first header is contact.

    Header texts stay reachable in ``header_text`` of their section's blocks.
    """
    opened = blocks.withColumn("opens", header_section(F.col("text"), F.col("font_size"), F.col("is_bold"), F.col("is_header")))
    so_far = W.partitionBy("doc_id").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    carried = opened.withColumn("section", F.coalesce(F.last("opens", ignorenulls=True).over(so_far), F.lit("contact")))
    carried = carried.withColumn("header_text", F.last(F.when(F.col("opens").isNotNull(), F.col("text")), ignorenulls=True).over(so_far))
    return carried.where("opens IS NULL").drop("opens")


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no, text of every line."""
    return docs.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "text"))


def segment_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Line-wise segmentation of plain text: a line needs capitals, a colon or few words to be a header."""
    lines = lines_of(docs, text)
    t = F.trim(F.col("text"))
    looks = (F.length(t) <= 60) & (is_all_caps(t) | t.endswith(":") | (F.size(F.split(t, r"\s+")) <= 5))
    lines = lines.withColumn("is_header", looks & ~t.rlike(r"^\s*[-•*]") & ~t.rlike(r":\s*\S"))
    blocks = lines.withColumn("font_size", F.lit(0.0)).withColumn("is_bold", F.lit(False))
    gated = blocks.withColumn("text", F.when(F.col("is_header"), F.col("text")).otherwise(F.concat(F.col("text"), F.lit(""))))
    opened = gated.withColumn("opens", F.when(F.col("is_header"), header_section(F.col("text"), F.col("font_size"), F.col("is_bold"), F.col("is_header"))))
    so_far = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    carried = opened.withColumn("section", F.coalesce(F.last("opens", ignorenulls=True).over(so_far), F.lit("contact")))
    return carried.where("opens IS NULL").select("doc_id", "line_no", "section", "text")


def section_texts(segmented: DataFrame, order: str = "line_no") -> DataFrame:
    """doc_id, sections: map of section to its lines in order."""
    each = segmented.groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))).alias("l"))
    each = each.select("doc_id", "section", F.expr("transform(l, x -> x.t)").alias("lines"))
    return each.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "lines")))).alias("sections"))


def header_score(text: Column, font_size: Column, is_bold: Column, dominant: Column) -> Column:
    """Weights .35 font, .25 bold, .20 capitals, .10 short, .10 colon; contact data and length count against."""
    t = F.trim(text)
    words = F.size(F.split(t, r"\s+"))
    font = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (font_size - dominant) / 4))
    caps = F.when(is_all_caps(t), 1.0).when(t.rlike(r"^(?:[A-Z][a-z]+\s*)+$"), 0.6).otherwise(0.0)
    short = F.when(words <= 3, 1.0).when(words <= 5, 0.7).when(words <= 8, 0.3).otherwise(0.0)
    base = 0.35 * font + 0.25 * is_bold.cast("double") + 0.20 * caps + 0.10 * short + 0.10 * t.endswith(":").cast("double")
    base = base * F.when(t.rlike(R.EMAIL) | t.rlike(R.PHONE) | t.rlike(R.DATE_RANGE), 0.1).otherwise(1.0)
    return F.round(base * F.when(words > 6, F.greatest(F.lit(0.2), 1 - 0.1 * (words - 6))).otherwise(1.0), 3)


def find_headers(blocks: DataFrame, threshold: float = 0.45) -> DataFrame:
    sized = blocks.join(dominant_font(blocks), "doc_id")
    return sized.withColumn("score", header_score(F.col("text"), F.col("font_size"), F.col("is_bold"), F.col("dominant"))).where(F.col("score") >= threshold)


def dominant_font(blocks: DataFrame, default: float = 11.0) -> DataFrame:
    """Most frequent rounded size over zero; the first seen of equally frequent ones."""
    sizes = blocks.groupBy("doc_id", F.when(F.col("font_size") > 0, F.bround("font_size")).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min("block_seq").alias("at"))
    best = F.max_by("size", F.when(F.col("size").isNotNull(), F.struct("n", -F.col("at"), "size")))
    return sizes.groupBy("doc_id").agg(F.coalesce(best, F.lit(default)).alias("dominant"))


def name_block(blocks: DataFrame) -> DataFrame:
    """The likeliest name among a document's first five blocks: large and of few words."""
    first = blocks.withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy("block_seq"))).where("rn <= 5")
    t = F.trim("text")
    words = F.size(F.split(t, r"\s+"))
    fits = ~t.rlike(R.EMAIL) & ~t.rlike(R.LINKEDIN) & ~t.rlike(R.GITHUB) & ~t.rlike(R.WEBSITE) & ~t.rlike(r"[0-9]{3}") & keyword_section(section_key(t)).isNull() & words.between(1, 5)
    score = 0.6 * F.col("font_size") + 2 * (5 - words)
    return first.where(fits).groupBy("doc_id").agg(F.max_by(t, F.struct(score.alias("s"), -F.col("rn"))).alias("name"))


def sessions(lines: DataFrame, key: str, order: list[str], starts: str) -> DataFrame:
    """Entries of a stream of lines: ``entry`` grows at every start; lines before the first one are entry 0."""
    so_far = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("entry", F.sum(F.expr(f"CASE WHEN {starts} THEN 1 ELSE 0 END")).over(so_far))


def next_filled(lines: DataFrame, key: str, order: list[str], reach: int = 3) -> DataFrame:
    """``ahead``: the next non-blank text within ``reach`` lines."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(1, reach)
    return lines.withColumn("ahead", F.first(F.when(F.trim("text") != "", F.col("text")), ignorenulls=True).over(w))

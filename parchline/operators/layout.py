"""Page layout and reading order over positioned text blocks.

Blocks: doc_id, page_num, block_seq, x0, y0, x1, y1, font_size, is_bold, text; W and H are page width and height.
All windows and aggregates share the partitioning by doc_id, so one exchange serves a chain of them. Pages
come first in every order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import regexes as R
from ..functions.text import normalize_whitespace
from ..sources.tables import by_key


def column_tags(blocks: DataFrame, width: float) -> DataFrame:
    """left / right / full by the left edge, and the header flag of a block."""
    t = F.trim("text")
    header = (F.length(t) <= 80) & (
        (F.col("font_size") >= 13) | F.col("is_bold") | ((F.length(t).between(3, 49)) & (t == F.upper(t)) & t.rlike("[A-Z]")) | t.rlike(R.ALL_CAPS_HEADER)
    )
    tag = F.when(F.col("x0") < 0.45 * width, "left").when(F.col("x0") > 0.55 * width, "right").otherwise("full")
    return blocks.withColumn("column_tag", tag).withColumn("is_header", header)


def page_order(blocks: DataFrame, step: float = 15.0, tag: str = "column_tag", place: str | None = None) -> DataFrame:
    """Rank within a page by row of ``step`` points, column, left edge and block_seq; blocks that are alike in these by their column ``place``."""
    w = W.partitionBy("doc_id", "page_num").orderBy(F.bround(F.col("y0") / step), tag, "x0", "block_seq", *([place] if place else []))
    return by_key(blocks, "doc_id").withColumn("page_rank", F.row_number().over(w))


def full_text(blocks: DataFrame, order: str = "page_rank") -> DataFrame:
    """A document's text: blocks by a blank, pages by an empty line."""
    pages = blocks.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("b"))
    pages = pages.select("doc_id", "page_num", F.expr("array_join(transform(b, x -> x.text), ' ')").alias("t"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "t"))).alias("p"))
    return docs.select("doc_id", F.expr("array_join(transform(p, x -> x.t), '\\n\\n')").alias("text"))


def layout_type(blocks: DataFrame, width: float) -> DataFrame:
    """One row for each document: layout_type, column_boundary, has_sidebar.

    The boundary is the middle of the emptiest of bins 4 to 15 of 20 bins of left edges.
    """
    x = F.col("x0")
    facts = blocks.groupBy("doc_id").agg(
        F.avg((x / width < 0.45).cast("int")).alias("left_share"),
        F.avg((x / width > 0.55).cast("int")).alias("right_share"),
        F.min(F.when(x / width > 0.55, x)).alias("right_edge"),
        F.avg((x > 0.65 * width).cast("int")).alias("far_right"),
        F.avg((x < 0.05 * width).cast("int")).alias("far_left"),
        F.max((x > 0.35 * width).cast("int")).alias("has_middle"),
        *[F.sum(F.when(F.least(F.floor(x * 20 / width), F.lit(19)) == b, 1).otherwise(0)).alias(f"bin{b}") for b in range(4, 16)],
    )
    gap = "array_min(array({}))".format(", ".join(f"named_struct('n', bin{b}, 'b', {b})" for b in range(4, 16)))
    two = "left_share > 0.20 AND right_share > 0.20"
    kind = f"CASE WHEN NOT ({two}) THEN 'single_column' WHEN ({width} - right_edge) / {width} < 0.35 THEN 'sidebar' ELSE 'two_column' END"
    return facts.selectExpr(
        "doc_id",
        f"{kind} layout_type",
        f"CASE WHEN {two} THEN ({gap}.b + 0.5D) * {width}D / 20 ELSE {width}D / 2 END column_boundary",
        "far_right > 0.15 OR (far_left > 0.10 AND has_middle = 1) has_sidebar",
    )


def place(blocks: DataFrame, layout: DataFrame, width: float, height: float) -> DataFrame:
    """Column, zone and reading rank of every block by its document's layout."""
    b = blocks.join(layout, "doc_id")
    wide = F.col("x1") - F.col("x0")
    side = (F.col("layout_type") == "sidebar") & (
        F.when(F.col("column_boundary") < 0.4 * width, F.col("x0") < F.col("column_boundary")).otherwise(F.col("x0") >= F.col("column_boundary"))
    )
    b = b.withColumn(
        "layout_column",
        F.when(wide > 0.70 * width, "full").when(F.col("x0") < 0.9 * F.col("column_boundary"), "left").otherwise("right"),
    )
    b = b.withColumn("zone", F.when(side, "sidebar").when(F.col("y0") < 0.2 * height, "header").when(F.col("y0") > 0.9 * height, "footer").otherwise("body"))
    full = wide > 0.8 * F.col("column_boundary")
    b = b.withColumn("any_full", F.max(full.cast("int")).over(W.partitionBy("doc_id", "page_num")) == 1)
    group = (
        F.when(F.col("layout_type") == "sidebar", side.cast("int"))
        .when((F.col("layout_type") == "two_column") & ~F.col("any_full"), (F.col("x0") >= F.col("column_boundary")).cast("int"))
        .otherwise(0)
    )
    order = W.partitionBy("doc_id").orderBy("page_num", group, "y0", "x0", "block_seq", "text")
    return b.withColumn("reading_rank", F.row_number().over(order)).drop("any_full")


def region_map(placed: DataFrame) -> DataFrame:
    return placed.selectExpr("doc_id", "reading_rank", "substring(text, 1, 50) text", "zone", "layout_column")


def column_segments(placed: DataFrame) -> DataFrame:
    """Two-column reconstruction: full blocks above, left, right, full blocks below; wide means over .85 of the boundary.

    A full block is above if it begins higher than every other block of its page. Blocks of one height keep the order of block_seq.
    """
    full = (F.col("x1") - F.col("x0")) > 0.85 * F.col("column_boundary")
    p = placed.withColumn("wide", full)
    first = F.min(F.when(~F.col("wide"), F.col("y0"))).over(W.partitionBy("doc_id", "page_num"))
    segment = F.when(F.col("wide") & (F.coalesce(first, F.lit(0.0)) > F.col("y0")), 0).when(F.col("wide"), 3).when(F.col("x0") < F.col("column_boundary"), 1).otherwise(2)
    p = p.withColumn("segment", segment)
    return p.withColumn("segment_rank", F.row_number().over(W.partitionBy("doc_id").orderBy("page_num", "segment", "y0", "block_seq", "text")))


def reading_text(placed: DataFrame) -> DataFrame:
    """doc_id, text: blocks with text in reading order, a line each; a document of blank blocks alone has an empty text."""
    docs = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("reading_rank", "text")))).alias("b"))
    return docs.select("doc_id", F.expr("array_join(transform(b, x -> x.text), '\\n')").alias("text"))


def reconstructed_text(placed: DataFrame, width: float) -> DataFrame:
    """doc_id, text by the document's layout: one column from top to bottom; two columns as ``column_segments`` has them;
    beside a sidebar the wider side first.

    Blocks are lines; an empty line parts pages, segments and the full blocks of two columns. Null and empty texts are left out.
    Any other layout (null too) counts as one column.
    """
    cut = column_segments(placed.where("text <> ''"))
    two, bar = F.col("layout_type") == "two_column", F.col("layout_type") == "sidebar"
    left = F.col("x0") < F.col("column_boundary")
    first = F.when(F.col("column_boundary") < width - F.col("column_boundary"), ~left).otherwise(left)
    cut = cut.withColumn("part", F.when(two, F.col("segment")).when(bar, F.when(first, 0).otherwise(1)).otherwise(0))
    order = W.partitionBy("doc_id").orderBy("page_num", "part", "y0", F.when(two | bar, 0.0).otherwise(F.col("x0")), "block_seq", "text")
    place = F.struct("page_num", "part")
    apart = (place != F.lag(place).over(order)) | F.coalesce(two & F.col("wide"), F.lit(False))
    rank = F.row_number().over(order)
    cut = cut.withColumn("piece", F.when(rank == 1, "").when(apart, "\n\n").otherwise("\n")).withColumn("rank", rank)
    docs = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "piece", "text"))).alias("b"))
    return docs.select("doc_id", normalize_whitespace(F.expr("array_join(transform(b, x -> concat(x.piece, x.text)), '')")).alias("text"))


def anchored_rows(blocks: DataFrame, tolerance: float) -> DataFrame:
    """Rows of blocks: a block joins the row whose first block lies within ``tolerance`` above it.

    The anchor moves with the row, which a window can't say; a fold over a document's ordered blocks does.
    """
    items = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "y0", "x0", "block_seq", "text"))).alias("b"))
    fold = (
        "aggregate(b, named_struct('page', -1, 'y', -1D, 'row', 0, 'out', cast(array() AS array<struct<row:int,page_num:int,y0:double,x0:double,block_seq:int,text:string>>)), "
        "(s, x) -> named_struct('page', cast(x.page_num AS int), "
        f"'y', CASE WHEN s.page = x.page_num AND x.y0 - s.y <= {tolerance} THEN s.y ELSE x.y0 END, "
        f"'row', s.row + CASE WHEN s.page = x.page_num AND x.y0 - s.y <= {tolerance} THEN 0 ELSE 1 END, "
        f"'out', array_append(s.out, named_struct('row', s.row + CASE WHEN s.page = x.page_num AND x.y0 - s.y <= {tolerance} THEN 0 ELSE 1 END, "
        "'page_num', cast(x.page_num AS int), 'y0', x.y0, 'x0', x.x0, 'block_seq', cast(x.block_seq AS int), 'text', x.text))), s -> s.out)"
    )
    return items.select("doc_id", F.inline(F.expr(fold)))


def adaptive_text(blocks: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """One line for each row of blocks, cells parted by two blanks."""
    rows = anchored_rows(blocks, tolerance).groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("x0", "block_seq", "text"))).alias("c"))
    return rows.select("doc_id", "row", F.expr("array_join(transform(c, x -> x.text), '  ')").alias("line"))


def lines_from_words(words: DataFrame, boundary: float, jump: float = 10.0) -> DataFrame:
    """Words to lines: columns parted at ``boundary``; a new line where y jumps by more than ``jump``."""
    w = by_key(words, "doc_id").withColumn("side", (F.col("x0") >= boundary).cast("int"))
    order = W.partitionBy("doc_id", "page_num", "side").orderBy(F.bround(F.col("y0") / 10), "x0", "block_seq", "text")
    y = F.bround(F.col("y0") / 10) * 10
    w = w.withColumn("breaks", F.coalesce((y - F.lag(y).over(order) > jump).cast("int"), F.lit(0)))
    w = w.withColumn("line_no", F.sum("breaks").over(order)).withColumn("rank", F.row_number().over(order))
    lines = w.groupBy("doc_id", "page_num", "side", "line_no").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("t"))
    return lines.select("doc_id", "page_num", "side", "line_no", F.expr("array_join(transform(t, x -> x.text), ' ')").alias("line"))


def drop_noise(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("text").rlike(r"[\p{L}\p{N}]"))


def read_through(blocks: DataFrame, order: str = "reading_rank") -> DataFrame:
    """Blocks in order without page numbers; dividers become blank; repeated texts (any case) keep their first place."""
    kept = blocks.where(~F.col("text").rlike(R.PAGE_NUMBER)).withColumn("text", F.when(F.col("text").rlike(R.SECTION_DIVIDER), "").otherwise(F.trim("text")))
    seen = F.row_number().over(W.partitionBy("doc_id", F.lower("text")).orderBy(order))
    return kept.withColumn("seen", seen).where("seen = 1 OR text = ''").drop("seen")


def reading_weight(blocks: DataFrame, column: str = "column_tag") -> DataFrame:
    weight = (F.col("page_num") - 1) * 100000 + F.floor(F.col("y0") / 10) * 10 + (F.col(column) == "right").cast("int")
    return blocks.withColumn("weight", weight.cast("bigint"))


def pdf_type(pages: DataFrame) -> DataFrame:
    """digital / scanned / mixed from page facts (text_chars, image_share, drawings): one row for each document."""
    scanned = (F.col("text_chars") < 50) & (F.col("image_share") >= 0.6)
    out = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum(scanned.cast("int")).alias("scanned_pages"),
        F.max(F.col("image_share") > 0).alias("has_images"),
        F.max(F.col("drawings") >= 10).alias("has_tables"),
        F.round(F.avg("text_chars"), 1).alias("avg_chars"),
    )
    kind = F.when(F.col("scanned_pages") == 0, "digital").when(F.col("scanned_pages") == F.col("page_count"), "scanned").otherwise("mixed")
    return out.withColumn("pdf_type", kind)


def is_multicolumn(blocks: DataFrame, width: float) -> DataFrame:
    """Both sides of the middle hold over 15 % of the first two pages' blocks; the right one begins at .3 of the width."""
    mid = width / 2
    return blocks.where("page_num <= 2").groupBy("doc_id").agg(
        ((F.avg((F.col("x0") < 0.4 * mid).cast("int")) > 0.15) & (F.avg((F.col("x0") > 0.6 * mid).cast("int")) > 0.15)).alias("multicolumn")
    )

"""Dates of semi-structured records: points, ranges, durations and merged intervals. Every "now" is an explicit ``as_of``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import regexes as R
from .text import has_date_range

# Month names; formats in order of trial.
_MONTHS = "January February March April May June July August September October November December".split()
FORMATS = ("MMM yyyy", "M/yyyy", "M-yyyy", "yyyy-MM", "yyyy/MM", "d/M/yyyy", "M/d/yyyy", "yyyy-MM-dd", "MMM d, yyyy", "d MMM yyyy", "yyyy/MM/dd", "d-M-yyyy")
_MONTH_WORD = r"(?i)\b(?:" + "|".join(f"({m[:3]})(?:{m[3:]}{'|t' if m == 'September' else ''})?" for m in _MONTHS) + r")\b[.,\-]?\s*"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def short_months(c: Column) -> Column:
    """Month names cut to three letters; a dot, comma or hyphen after them counts as a blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), _MONTH_WORD, "".join(f"${i}" for i in range(1, 13)) + " "), r"\s+", " "))


def is_present(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike("^" + R.PRESENT + "$")


def parse_date(c: Column, as_of: str) -> Column:
    """Date of a point in time: present, month and year, full formats, else the first year's January."""

    def body(s: Column) -> Column:
        tries = [F.when(F.contains(s, F.lit(_separator(f))), F.try_to_timestamp(s, F.lit(f)).cast("date")) for f in FORMATS]
        year = F.make_date(F.nullif(F.regexp_extract(s, R.YEAR, 0), F.lit("")).cast("int"), F.lit(1), F.lit(1))
        return F.when(is_present(s), F.lit(as_of).cast("date")).otherwise(F.coalesce(*tries, year))

    return let(short_months(c), body)


def _separator(f: str) -> str:
    """A character that texts of a format must hold; a trial that fails costs an exception."""
    return next(ch for ch in ",/- " if ch in f)


def duration_years(start: Column, end: Column) -> Column:
    """Whole years, months as twelfths and left-over days as parts of 365.25, to one decimal; order doesn't matter."""

    def body(p: Column) -> Column:
        months = F.floor(F.months_between(p["b"], p["a"], False))
        days = F.datediff(p["b"], F.add_months(p["a"], months.cast("int")))
        return F.round(months / 12 + days / 365.25, 1)

    return let(F.struct(F.least(start, end).alias("a"), F.greatest(start, end).alias("b")), body)


def parse_range(c: Column, as_of: str) -> Column:
    """Struct of a text's first date range; null without one."""

    def parts(r: Column) -> Column:
        return F.struct(r["raw"].alias("raw"), r["a"].alias("a"), r["b"].alias("b"), parse_date(r["a"], as_of).alias("start"), parse_date(r["b"], as_of).alias("end"))

    def body(p: Column) -> Column:
        made = F.struct(
            _named(p["a"], p["start"]).alias("start_date"),
            _named(p["b"], p["end"]).alias("end_date"),
            p["start"].alias("start"),
            p["end"].alias("end"),
            is_present(p["b"]).alias("is_current"),
            duration_years(p["start"], p["end"]).alias("duration_years"),
            p["raw"].alias("raw_match"),
        )
        return F.when(p["raw"] != "", made)

    def groups(raw: Column) -> Column:
        return F.struct(raw.alias("raw"), F.regexp_extract(raw, R.DATE_RANGE, 1).alias("a"), F.regexp_extract(raw, R.DATE_RANGE, 2).alias("b"))

    raw = let(c, lambda t: F.when(has_date_range(t), F.regexp_extract(t, R.DATE_RANGE, 0)))
    return let(let(let(raw, groups), parts), body)


def _named(c: Column, parsed: Column) -> Column:
    bare = F.trim(c).rlike(r"^(?:19|20)\d{2}$")
    return F.when(is_present(c), F.lit("Present")).when(bare, F.trim(c)).otherwise(F.coalesce(F.date_format(parsed, "MMM yyyy"), c))


def normalize_date(c: Column, as_of: str) -> Column:
    """``Present``, ``yyyy`` for bare years, ``MMM yyyy``, or the text as it is."""
    return let(F.struct(c.alias("c"), parse_date(c, as_of).alias("d")), lambda p: _named(p["c"], p["d"]))


def first_date(c: Column) -> Column:
    """The first month with a year, else the first bare year, else null."""
    found = lambda p: F.nullif(F.regexp_extract(c, p, 0), F.lit(""))
    return F.coalesce(found(R.MONTH_YEAR), found(R.YEAR))


def all_dates(c: Column) -> Column:
    """Month-year and bare-year mentions with their positions, in order of position."""
    months = F.transform(F.regexp_extract_all(c, F.lit(R.MONTH_YEAR), F.lit(0)), lambda m: F.struct(F.instr(c, m).alias("at"), m.alias("raw"), F.lit("month_year").alias("kind")))
    years = F.transform(F.regexp_extract_all(c, F.lit(R.YEAR), F.lit(0)), lambda y: F.struct(F.instr(c, y).alias("at"), y.alias("raw"), F.lit("year_only").alias("kind")))
    return F.array_sort(F.array_distinct(F.concat(months, years)))


def merged_years(df: DataFrame, key: str, start: str, end: str, as_of: str) -> DataFrame:
    """Years covered by a key's intervals, overlaps counted once: running maximum of ends, islands, sums.

    Open ends count to ``as_of``; intervals that end before they start are left out.
    One shuffle by key serves the windows and both aggregations.
    """
    given = df.select(F.col(key).alias("k"), F.col(start).cast("date").alias("s"), F.coalesce(F.col(end).cast("date"), F.lit(as_of).cast("date")).alias("e"))
    given = given.where("s <= e")
    order = W.partitionBy("k").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    island = given.withColumn("first", (before.isNull() | (F.col("s") > before)).cast("int"))
    island = island.withColumn("island", F.sum("first").over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = island.groupBy("k", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return spans.groupBy(F.col("k").alias(key)).agg(F.round(F.sum(F.datediff("e", "s")) / 365.25, 1).alias("total_years"))

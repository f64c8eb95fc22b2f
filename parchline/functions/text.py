"""Text cleaning and small scalar helpers, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import regexes as R

# Characters that cleaning replaces.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE"}
SINGLE_QUOTES, DOUBLE_QUOTES = "‘’‚‛′", "“”„‟″«»"
DASHES, BULLETS = "–—―−‐‑", "•‣◦⁃⁌⁍∙▪▫●○■□"
ZERO_WIDTH = "​‌‍﻿­"


@F.pandas_udf(StringType())
def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFC; no built-in function normalises."""
    for s in batches:
        yield s.str.normalize("NFC")


@F.pandas_udf(StringType())
def py_title(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Title case at every letter run, which initcap does at blanks only."""
    for s in batches:
        yield s.str.title()


def title_case(c: Column) -> Column:
    """The same as py_title for ASCII words parted by blanks, hyphens, dots, slashes or apostrophes, without Python."""
    parts = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 20))), "")


def replace_special(c: Column) -> Column:
    out = F.translate(c, SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + BULLETS, "'" * 5 + '"' * 7 + "-" * (len(DASHES) + len(BULLETS)))
    for k, v in LIGATURES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def fix_artifacts(c: Column, ocr_repairs: bool = True) -> Column:
    out = F.translate(F.translate(c, " ", " "), ZERO_WIDTH, "")
    return F.regexp_replace(out, "(?<=[a-z])l(?=[A-Z])", "I") if ocr_repairs else out


def normalize_whitespace(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\t"), F.lit(" ")), R.MULTIPLE_SPACES, " "), R.MULTIPLE_NEWLINES, "\n\n")


def is_noise_line(c: Column) -> Column:
    """A lone symbol, three characters without a letter or digit, or under ten with hardly any."""
    t = F.trim(c)
    alnum, n = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")), F.length(t)
    return (n > 0) & (((n <= 3) & (alnum == 0)) | ((n < 10) & (alnum < n * 0.2)))


def remove_noise(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n", -1), lambda x: ~is_noise_line(x)), "\n")


def clean(c: Column, aggressive: bool = False, ocr_repairs: bool = True, normal_form: bool = False) -> Column:
    """The cleaning chain; NFC costs a Python hop, so it is on demand."""
    out = nfc(c) if normal_form else c
    out = fix_artifacts(replace_special(out), ocr_repairs)
    out = remove_noise(normalize_whitespace(F.regexp_replace(out, R.CONTROL_CHARS, " ")))
    if aggressive:
        out = F.regexp_replace(out, R.NON_ASCII, "")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def clean_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(fix_artifacts(replace_special(c)), r"\s+", " "))


def clean_lines(c: Column, min_length: int = 2) -> Column:
    return F.filter(F.transform(F.split(c, "\n", -1), clean_line), lambda x: F.length(x) >= min_length)


def normalize_bullets(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^[ \t]*[•●◦‣▸▹►▻*+>-][ \t]+", "- ")


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)(?:https?://|www\.)[^\s]+", "")


def section_key(c: Column) -> Column:
    """Lower case, dividers to blanks, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[:\-_=*#~]", " "), r"\s+", " "))


def is_all_caps(c: Column) -> Column:
    return ~c.rlike("[a-z]") & c.rlike("[A-Z](?:[^A-Z]*[A-Z]){2}")


# What a pattern can't do without is looked for first: most lines hold none of it, and a pattern costs many times as much.


def has_date_range(c: Column) -> Column:
    return _may_be_dated(c) & c.rlike(R.DATE_RANGE)


def without_date_range(c: Column) -> Column:
    return F.when(_may_be_dated(c), F.regexp_replace(c, R.DATE_RANGE, "")).otherwise(c)


def _may_be_dated(c: Column) -> Column:
    return F.contains(c, F.lit("20")) | F.contains(c, F.lit("19"))


def has_email(c: Column) -> Column:
    return F.contains(c, F.lit("@")) & c.rlike(R.EMAIL)


def has_linkedin(c: Column) -> Column:
    return F.contains(F.lower(c), F.lit("linkedin")) & c.rlike(R.LINKEDIN)


def dehyphenate(c: Column) -> Column:
    """Join a line that ends with a hyphen to a next one that doesn't begin with a capital; each line joins once."""
    lines = F.split(c, "\n", -1)
    none = F.expr("named_struct('out', cast(array() AS array<string>), 'open', false)")

    def step(s: Column, line: Column) -> Column:
        last = F.element_at(s["out"], -1)
        joins = s["open"] & (F.trim(line) != "") & ~F.trim(line).rlike("^[A-Z]")
        out = F.when(
            joins, F.concat(F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1), F.array(F.concat(F.regexp_replace(last, "-$", ""), F.trim(line))))
        ).otherwise(F.concat(s["out"], F.array(line)))
        return F.struct(out.alias("out"), (~joins & F.rtrim(line).endswith("-")).alias("open"))

    return F.array_join(F.aggregate(lines, none, step, lambda s: s["out"]), "\n")


def clean_blank_lines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\n(?:[ \t]*\n){2,}", "\n\n"), r"^\s+|\s+$", "")


def sanitize_filename(c: Column) -> Column:
    base = F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"^\.+|\x00", "")
    return F.coalesce(F.nullif(F.regexp_replace(base, r"[^\w\s\-.]", "_"), F.lit("")), F.lit("upload"))


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\.[^.]+$", 0))


def truncate(c: Column, size: int = 500) -> Column:
    return F.when(F.length(c) > size, F.concat(F.rtrim(F.left(c, F.lit(size - 3))), F.lit("..."))).otherwise(c)


def is_empty(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def distinct_ignoring_case(xs: Column) -> Column:
    """First spelling of every element, in order; blank ones go."""
    kept = F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(kept, lambda x: F.lower(x))
    return F.filter(kept, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def chunked(xs: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(size)), lambda i: F.slice(xs, i + 1, F.lit(size)))

"""Field validators: struct(valid, value, reason) of one column each. Reasons are checked in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import regexes as R
from .dates import parse_date
from .text import is_empty


def _verdict(value: Column, *failures: tuple[Column, str]) -> Column:
    reason = None
    for test, name in failures:
        reason = F.when(test, F.lit(name)) if reason is None else reason.when(test, F.lit(name))
    reason = reason.otherwise(F.lit("ok"))
    return F.struct((reason == "ok").alias("valid"), F.when(reason == "ok", value).alias("value"), reason.alias("reason"))


def email(c: Column) -> Column:
    v = F.lower(F.trim(c))
    domain = F.substring_index(v, "@", -1)
    return _verdict(
        v,
        (is_empty(c), "empty"),
        (~v.rlike("^" + R.EMAIL), "invalid_format"),
        (F.size(F.split(v, "@")) != 2, "missing_at"),
        (~domain.contains("."), "invalid_domain"),
        (F.length(F.substring_index(domain, ".", -1)) < 2, "invalid_tld"),
        (v.rlike(r"^(?:test|example|dummy|noreply)@"), "placeholder_email"),
    )


def phone(c: Column) -> Column:
    digits = F.regexp_replace(c, r"[^0-9]", "")
    return _verdict(
        F.trim(c),
        (is_empty(c), "empty"),
        (F.length(digits) < 7, "too_short"),
        (F.length(digits) > 15, "too_long"),
        (F.size(F.array_distinct(F.split(digits, ""))) <= 2, "repeating_digits"),
    )


def url(c: Column) -> Column:
    given = F.trim(c)
    v = F.when(given.startswith("www."), F.concat(F.lit("https://"), given)).otherwise(given)
    domain = F.regexp_extract(v, r"^https?://([^/\s]+)", 1)
    return _verdict(
        v,
        (is_empty(c), "empty"),
        (~given.rlike(r"(?i)^(?:https?://|www\.)"), "missing_scheme"),
        (domain == "", "invalid_domain"),
        (~domain.contains("."), "no_tld"),
    )


def linkedin(c: Column) -> Column:
    user = F.regexp_extract(c, R.LINKEDIN, 1)
    return _verdict(
        F.concat(F.lit("https://linkedin.com/in/"), user),
        (is_empty(c), "empty"),
        (user == "", "invalid_format"),
        (F.length(user) < 3, "username_too_short"),
    )


def name(c: Column) -> Column:
    v = F.trim(c)
    return _verdict(
        v,
        (is_empty(c), "empty"),
        (F.length(v) < 2, "too_short"),
        (F.length(v) > 100, "too_long"),
        (~v.rlike(r"\p{L}"), "no_letters"),
        (v.rlike("[0-9]"), "contains_digits"),
    )


def date(c: Column, as_of: str) -> Column:
    d = parse_date(c, as_of)
    return _verdict(
        F.trim(c),
        (is_empty(c), "empty"),
        (d.isNull(), "unparseable"),
        (F.year(d) < 1950, "too_old"),
        (F.year(d) > F.year(F.lit(as_of).cast("date")) + 5, "too_far_in_future"),
    )


def gpa(c: Column) -> Column:
    """Value and optional scale; without a scale at most 100."""
    value, scale = _number(c, 1), _number(c, 2)
    return _verdict(
        F.trim(c),
        (is_empty(c), "empty"),
        (value.isNull(), "not_numeric"),
        (scale.isNotNull() & (value > scale), "exceeds_scale"),
        (scale.isNull() & (value > 100), "too_high"),
    )


def _number(c: Column, group: int) -> Column:
    return F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)?)\s*(?:/\s*(\d+(?:\.\d+)?))?\s*$", group).try_cast("double")


def years(c: Column) -> Column:
    return _verdict(c, (c.isNull(), "empty"), (c < 0, "negative"), (c > 60, "too_high"))


def skill(c: Column) -> Column:
    v = F.trim(c)
    return _verdict(v, (is_empty(c), "empty"), (F.length(v) < 2, "too_short"), (F.length(v) > 100, "too_long"), (~v.rlike(r"\p{L}"), "no_letters"))


def sanitize(c: Column, size: int = 1000) -> Column:
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(c, R.CONTROL_CHARS, ""), r"\s+", " ")), F.lit(size))

"""Named entities by patterns and word lists: persons, organisations, places, dates.

No language model: a person needs a title before the name, an organisation a legal form or the word of an institution
after it, a place is a known country. Lists are sorted and distinct; null texts have empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import COUNTRIES
from . import regexes as R

_NAME = r"[A-Z][A-Za-z&.'-]*"
# Titles before a person's name, what an organisation's name ends in.
PERSON = rf"\b(?:Dr|Mr|Mrs|Ms|Prof)\.? +({_NAME}(?: {_NAME}){{0,2}})"
ORGANISATION = rf"({_NAME}(?: {_NAME}){{0,3}} (?:Inc|Ltd|LLC|Corp|GmbH|AG|PLC|Group|Holdings|University|College|Institute))\b"
PLACE = r"(?i)\b(" + "|".join(sorted((c for c in COUNTRIES if len(c) > 2), key=lambda c: (-len(c), c))) + r")\b"


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))))


def entities(text: Column) -> Column:
    """Struct of persons, organisations, places (lower case) and dates of a whole text."""
    return F.struct(
        _found(text, PERSON, 1).alias("persons"),
        _found(text, ORGANISATION, 1).alias("organisations"),
        _found(F.lower(text), PLACE, 1).alias("places"),
        _found(text, R.MONTH_YEAR, 0).alias("dates"),
    )

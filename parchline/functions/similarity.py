"""String similarity: normalised Indel ratio (substitutions cost two) and its token-sorted form.

Built-in levenshtein has other costs, so the ratio takes 200 * LCS / (len a + len b). ``lcs`` is a
fold over rows of the dynamic program and stays in the JVM; pairs reach it only after an exact
look-up failed and a bound on lengths allows the cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> str:
    """SQL: length of the longest common subsequence of two string expressions."""
    row = (
        f"aggregate(sequence(1, char_length({b})), named_struct('left', 0, 'out', array(0)), (r, j) -> named_struct("
        f"'left', CASE WHEN substring({b}, j, 1) = ch THEN element_at(prev, j) + 1 ELSE greatest(r.left, element_at(prev, j + 1)) END, "
        f"'out', array_append(r.out, CASE WHEN substring({b}, j, 1) = ch THEN element_at(prev, j) + 1 ELSE greatest(r.left, element_at(prev, j + 1)) END)), r -> r.out)"
    )
    return (
        f"CASE WHEN char_length({a}) = 0 OR char_length({b}) = 0 THEN 0 ELSE "
        f"element_at(aggregate(split({a}, ''), array_repeat(0, char_length({b}) + 1), (prev, ch) -> {row}), -1) END"
    )


def ratio(a: str, b: str) -> str:
    """SQL: similarity from 0 to 100."""
    return f"CASE WHEN char_length({a}) + char_length({b}) = 0 THEN 100D ELSE 200D * ({lcs(a, b)}) / (char_length({a}) + char_length({b})) END"


def sorted_tokens(c: str) -> str:
    """SQL: a text's words in order of the alphabet."""
    return f"array_join(array_sort(filter(split({c}, '\\\\s+'), x -> x <> '')), ' ')"


def possible(a: str, b: str, cutoff: float) -> str:
    """SQL: lengths and Levenshtein distance allow the cutoff.

    At best the shorter text is all common; and the Indel distance, which decides, is never under the built-in Levenshtein distance.
    """
    total = f"(char_length({a}) + char_length({b}))"
    return f"200D * least(char_length({a}), char_length({b})) >= {cutoff} * {total} AND 100D * levenshtein({a}, {b}) <= {100 - cutoff} * {total}"


def best_match(query: str, choices: list[str], cutoff: float) -> Column:
    """Struct (choice, score) of the first best choice at or over the cutoff; null without one."""
    listed = ", ".join("'" + c.replace("'", "\\'") + "'" for c in choices)
    scored = (
        f"transform(filter(array({listed}), c -> {possible(query, 'c', cutoff)}), "
        f"(c, i) -> named_struct('score', {ratio(query, 'c')}, 'at', -i, 'choice', c))"
    )
    return F.expr(f"array_max(filter({scored}, s -> s.score >= {cutoff}))")

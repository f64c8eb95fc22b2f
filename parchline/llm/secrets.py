"""Secret scans: base patterns and multipart credentials, in DataFrame expressions only.

Base kinds (leftmost, not overlapping, per kind): ``assign``, ``access``, ``hex``. Beyond these,
weak parts say little alone: account identifiers (``user``), opaque values (``value``) and
endpoints (``endpoint``). Parts fall into roles: identifier (access, user), secret (assign,
hex, value), endpoint. Each part's interval reaches REACH code points to both
sides within its scope, a paragraph (text between blank lines); a weak part is
reported only when its interval meets a part of a complementary role in its scope:

* a ``value`` needs an identifier or an endpoint that isn't itself,
* a ``user`` needs a secret,
* an ``endpoint`` needs an identifier and a secret.

The interval join is a sweep over a row's parts in order of position: forwards and
backwards, each part sees the nearest edge of every role and of the scope. Running sums and
maxima are made by doubling, n log n for n parts; no array grows element by element and
no pairs are made. Nothing leaves its row: no shuffle, no join on ids.

Positions come from splitting at the pattern: the pieces between matches and the matches
alternate, so the running sum of their lengths gives offsets, which count code points.

Defined results. Null texts count as empty. Empty texts have no spans. Repeated rows and null ids
stay rows of their own; clashing extra columns don't matter, as working columns live
inside expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points between parts that belong together.
REACH = 160

# The base patterns. Letter cases are spelled out so that every regex dialect reads them alike.
ASSIGN = (
    "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"
#: Weak parts. An opaque value has a digit and both cases or is long; see _VALUE_TEST.
USER = "(?:[uU][sS][eE][rR](?:[nN][aA][mM][eE])?|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_?[iI][dD])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9@._-]{3,})"
ENDPOINT = "(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9@:._-]+"
VALUE = "[A-Za-z0-9+/_=-]{20,}"
_VALUE_TEST = "t rlike '[0-9]' AND t rlike '[A-Z]' AND t rlike '[a-z]'"
SCOPE_BREAK = "\\n[\\x20\\x09]*\\n"

#: kind, pattern, test of a match (t: its text; v: its value group), hint that must be in a text with a match.
BASE_KINDS = (
    ("assign", ASSIGN, "char_length(v) >= 8", "[:=]"),
    ("access", ACCESS, "char_length(t) >= 16", "AKIA"),
    ("hex", HEX, "true", HEX),
)
WEAK_KINDS = (
    ("user", USER, "true", "[:=]"),
    ("endpoint", ENDPOINT, "true", "://"),
    ("value", VALUE, _VALUE_TEST, VALUE),
)
_NONE = "cast(array() AS array<struct<start:bigint,end:bigint,rank:int>>)"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(array: str, merged: str) -> str:
    """SQL: every element of an array joined with all before it, by doubling: log2(n) passes, no growing array.

    ``merged`` joins ``x`` with an earlier element ``y``, which is null before the first one; it must be associative.
    """
    steps = "slice(array({}), 1, cast(ceil(log2(size(w))) AS int))".format(", ".join(f"{1 << k}" for k in range(31)))
    passes = f"aggregate({steps}, w, (a, step) -> transform(a, (x, i) -> {_let('get(a, i - step)', 'y', merged)}))"
    return _let(array, "w", f"CASE WHEN size(w) < 2 THEN w ELSE {passes} END")


def located(text: str, kind_rank: int, pattern: str, test: str, hint: str) -> str:
    """SQL: array of (start, end, rank) of the pattern's matches in ``text`` that pass the test."""
    p = _sql(pattern)
    group = 1 if "([" in pattern else 0
    value = f"regexp_extract_all({text}, {p}, 1)" if group else "f"
    # Lengths of the gap before a match and of the match; their running sum is where a match ends.
    sizes = "zip_with(slice(split({0}, {1}, -1), 1, size(f)), f, (gap, t) -> cast(char_length(gap) + char_length(t) AS bigint))".format(text, p)
    ends = _running(sizes, "x + coalesce(y, 0L)")
    made = (
        f"zip_with(f, zip_with({ends}, {value}, (end, v) -> named_struct('end', end, 'v', v)), (t, m) -> CASE WHEN {test.replace('v)', 'm.v)')} "
        f"THEN named_struct('start', m.end - char_length(t), 'end', m.end, 'rank', {kind_rank}) END)"
    )
    walked = _let(f"regexp_extract_all({text}, {p}, 0)", "f", f"array_compact({made})")
    return f"CASE WHEN {text} rlike {_sql(hint)} AND {text} rlike {p} THEN {walked} ELSE {_NONE} END"


#: Role of a part by its kind's rank; rank 6 is a break between scopes.
_ROLE = "CASE WHEN {0}.rank IN (1, 3) THEN 'identifier' WHEN {0}.rank = 4 THEN 'endpoint' WHEN {0}.rank = 6 THEN 'break' ELSE 'secret' END"
_ROLES = ("identifier", "secret", "endpoint", "break")


def _nearest(forwards: bool) -> str:
    """SQL: for each of the ordered ``parts`` the farthest end of every role up to it (backwards: the nearest start from it on)."""
    edge, pick = ("end", "greatest") if forwards else ("start", "least")
    first = ", ".join(f"'{r}', CASE WHEN {_ROLE.format('p')} = '{r}' THEN p.{edge} END" for r in _ROLES)
    base = ", 'base', CASE WHEN p.rank <= 2 THEN p.end END" if forwards else ""
    names = [*_ROLES, *(["base"] if forwards else [])]
    merged = "named_struct({})".format(", ".join(f"'{r}', {pick}(x.{r}, y.{r})" for r in names))
    order = "parts" if forwards else "reverse(parts)"
    return _running(f"transform({order}, p -> named_struct({first}{base}))", merged)


def _linked() -> str:
    """SQL: the weak ones of ``parts`` whose interval meets a complementary part of their scope.

    Parts have no line breaks, so a part lies in one scope and one from another scope ends before its break.
    """
    before, behind = "get(f, i - 1)", "get(b, size(parts) - i - 2)"
    near = (
        "(coalesce(p.start - {f}.{0} <= {n} AND {f}.{0} >= coalesce({f}.break, 0), false) OR "
        "coalesce({b}.{0} - p.end <= {n} AND {b}.{0} <= coalesce({b}.break, {b}.{0}), false))"
    )
    has = {r: near.format(r, f=before, b=behind, n=REACH) for r in _ROLES[:3]}
    test = (
        f"CASE p.rank WHEN 3 THEN {has['secret']} WHEN 4 THEN {has['identifier']} AND {has['secret']} "
        f"WHEN 5 THEN ({has['identifier']} OR {has['endpoint']}) AND NOT coalesce({before}.base >= p.end, false) ELSE false END"
    )
    return _let(_nearest(True), "f", _let(_nearest(False), "b", f"filter(parts, (p, i) -> {test})"))


def scan(df: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``df`` with a column ``out``: struct of base and linked, arrays of (start, end, kind) by start, then kind as listed."""
    names = [k for k, *_ in BASE_KINDS + WEAK_KINDS]
    fields = {k: f"parchline__{k}" for k in ("text", *names)}
    work = df.withColumn(fields["text"], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    for rank, (kind, pattern, test, hint) in enumerate(BASE_KINDS + WEAK_KINDS):
        work = work.withColumn(fields[kind], F.expr(located(fields["text"], rank, pattern, test, hint)))
    base = "concat({})".format(", ".join(fields[k] for k, *_ in BASE_KINDS))
    weak = "concat({})".format(", ".join(fields[k] for k, *_ in WEAK_KINDS))
    breaks = located(fields["text"], len(names), SCOPE_BREAK, "true", SCOPE_BREAK)
    # Of parts that start together the longest comes first, so that what holds a part comes before it.
    ordered = f"array_sort(transform(concat({base}, {weak}, {breaks}), p -> named_struct('start', p.start, 'back', -p.end, 'rank', p.rank, 'end', p.end)))"
    linked = f"CASE WHEN size({weak}) > 0 THEN {_let(ordered, 'parts', _linked())} END"
    label = "element_at(array({}), p.rank + 1)".format(", ".join(f"'{k}'" for k in names))
    span = f"named_struct('start', p.start, 'end', p.end, 'kind', {label})"
    none = "cast(array() AS array<struct<start:bigint,end:bigint,kind:string>>)"
    spans = lambda xs: f"transform(array_sort(transform({xs}, p -> named_struct('start', p.start, 'rank', p.rank, 'end', p.end))), p -> {span})"
    result = F.expr(f"named_struct('base', {spans(base)}, 'linked', coalesce({spans(linked)}, {none}))")
    keep: list[Column] = [F.col(f"`{c}`") for c in df.columns if c != out]  # a clashing column gives way
    return work.select(*keep, result.alias(out))


def joined_spans(spans: str) -> str:
    """SQL: kind:start:end of each span, comma-joined."""
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


#: Code points of the blocks that a text is cut into for redaction.
_BLOCK = 4096


def redact(df: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``df`` with every reported span of the text, base or linked, replaced by ``mark``; overlapping spans give one mark."""
    found = scan(df, text_col, "parchline__secrets")
    text = f"`{text_col}`"
    spans = "array_sort(concat(parchline__secrets.base, parchline__secrets.linked))"
    ends = _running("transform(spans, p -> p.end)", "greatest(x, y)")
    # A text between two spans is cut from blocks, as a position in a long text is found by counting from its beginning.
    between = (
        "array_join(transform(CASE WHEN k.start < k.end THEN sequence(k.start DIV {n}, (k.end - 1) DIV {n}) ELSE cast(array() AS array<bigint>) END, n -> "
        "substring(get(blocks, cast(n AS int)), cast(greatest(k.start - n * {n}, 0) AS int) + 1, cast(k.end - greatest(k.start, n * {n}) AS int))), '')"
    ).format(n=_BLOCK)
    gaps = "filter(zip_with(concat(array(0L), ends), concat(transform(spans, p -> p.start), array(cast(char_length({t}) AS bigint))), (a, b) -> named_struct('start', a, 'end', b)), k -> k.start <= k.end)"
    joined = f"array_join(transform({gaps.format(t=text)}, k -> {between}), '{mark}')"
    blocks = f"regexp_extract_all({text}, '(?s).{{1,{_BLOCK}}}', 0)"
    cut = _let(spans, "spans", _let(ends, "ends", _let(blocks, "blocks", joined)))
    clean = F.expr(f"CASE WHEN size(parchline__secrets.base) + size(parchline__secrets.linked) = 0 OR {text} IS NULL THEN {text} ELSE {cut} END")
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])

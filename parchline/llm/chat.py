"""Chat formatting by schema fingerprints, in DataFrame expressions only.

A record's nested field paths, of all levels and all elements of its lists (names and array levels,
without scalar types), are written in canonical form and hashed; the fingerprint selects a declarative mapping, which turns the
record into canonical turns. Lists whose elements have unlike fields, objects where a mapping expects a text, and
texts beside objects have fingerprints of their own, so no mapping takes them for something simpler. Layouts that are known: single turn rows, message lists
(role/content, role/text, from/value, also under ``conversations``), prompt/completion,
prompt/response, instruction/input/output and instruction/output. ``MAPPINGS`` may be extended.

Template. A turn is ``<s>`` role ``[INST]`` text ``[/INST]</s>``; an assistant's text, which
the loss mask covers, stands between ``[OUT]`` and ``[/OUT]``. In roles and texts ``&``, ``<``
and ``[`` become ``&amp;``, ``&lt;`` and ``&lb;``, so no control string can occur inside, and
reading back is exact.

Scale. Turns are formatted row by row. A conversation's turns are joined in blocks of
BLOCK turns first, so no task gets a hot conversation's rows one by one; the blocks'
strings then meet, as the output is one string for a conversation.

Defined results. Null texts and roles count as empty. Turns are ordered by turn, then by role
and text; null turns come first. Repeated rows stay turns of their own. A null conversation id is one
conversation. Records with an unknown fingerprint or text that isn't JSON have no turns and are
returned by ``unmapped``. Where a table's columns are the record, a row with an unknown fingerprint is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 64

#: Field paths (sorted, comma-joined; [] marks array elements) and the turns they give:
#: either one list with the fields of role and text, or fixed roles with their fields.
MAPPINGS: dict[str, dict] = {
    "messages,messages[].content,messages[].role": {"list": "messages", "role": "role", "text": "content"},
    "messages,messages[].role,messages[].text": {"list": "messages", "role": "role", "text": "text"},
    "conversations,conversations[].from,conversations[].value": {"list": "conversations", "role": "from", "text": "value"},
    "completion,prompt": {"turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "prompt,response": {"turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    "input,instruction,output": {"turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "instruction,output": {"turns": [("user", ["instruction"]), ("assistant", ["output"])]},
    "role,text": {"turn": ("role", "text")},
    "content,role": {"turn": ("role", "content")},
}
#: Names that other layouts use for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_TURNS = "array<struct<role:string,text:string>>"


# The names of scalar types in schemas of variants.
_SCALARS = "STRING|BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|BOOLEAN|BINARY|DATE|TIMESTAMP|TIMESTAMP_NTZ|UUID|VOID|DECIMAL\\(\\d+,\\d+\\)"


def fingerprint(record: Column | str) -> Column:
    """Hash of the nested field paths of a JSON record; null where it is no JSON object."""
    return F.xxhash64(paths(record))


def paths(record: Column | str) -> Column:
    """Nested field paths of a JSON record in canonical form: ``OBJECT<messages: ARRAY<OBJECT<content: ., role: .>>>``.

    Members are in the order of their names; a list's element is the union of all its elements; scalars are dots.
    """
    json = F.col(record) if isinstance(record, str) else record
    return _paths(F.try_parse_json(json))


def _paths(variant: Column) -> Column:
    schema = F.schema_of_variant(variant)
    whole = F.regexp_replace(schema, f"(?<=: |<)(?:{_SCALARS})(?=[,>])", ".")
    return F.when(F.startswith(schema, F.lit("OBJECT<")), whole)


def row_paths(record: Column, kind: T.StructType) -> Column:
    """The same of a struct of the type ``kind``. Only its shape enters the variant, as paths hold no values; so no text is too long."""
    return _paths(F.to_variant_object(_shape(record, kind)))


def _shape(value: Column, kind: T.DataType) -> Column:
    """The value with true for every scalar in it."""
    if isinstance(kind, T.StructType) and kind.fields:
        made = F.struct(*[_shape(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
    elif isinstance(kind, T.ArrayType):
        made = F.transform(value, lambda x: _shape(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        made = F.map_from_arrays(F.map_keys(value).cast("array<string>"), F.transform(F.map_values(value), lambda x: _shape(x, kind.valueType)))
    else:
        made = F.lit(True)
    return F.when(value.isNotNull(), made)


def canonical(layout: str) -> str:
    """The canonical form of a mapping's comma-joined paths, where [] marks array elements."""
    tree: dict = {}
    for path in layout.split(","):
        node = tree
        for name in path.split("."):
            node = node.setdefault(name, {})

    def walk(node: dict) -> str:
        members = {}
        for name, inner in node.items():
            if inner or name.removesuffix("[]") not in members:
                body = walk(inner) if inner else "."
                members[name.removesuffix("[]")] = f"ARRAY<{body}>" if name.endswith("[]") else body
        return "OBJECT<{}>".format(", ".join(f"{k}: {members[k]}" for k in sorted(members)))

    return walk(tree)


def _field(json: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(json), f"$.{name}", "string"), F.lit(""))


def _canonical(role: Column) -> Column:
    out = role
    for other, own in ROLES.items():
        out = F.when(F.lower(role) == other, F.lit(own)).otherwise(out)
    return out


def _mapped(mapping: dict, field: Callable[[str], Column], items: Callable[[dict], Column]) -> Column:
    """The mapping's turns; ``field`` gives a text of the record by its name, ``items`` the elements of its list."""
    if "turn" in mapping:
        role, text = mapping["turn"]
        return F.array(F.struct(field(role).alias("role"), field(text).alias("text")))
    if "turns" in mapping:
        return F.array(
            *[
                F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[field(f) for f in fields]), lambda x: x != ""), "\n").alias("text"))
                for role, fields in mapping["turns"]
            ]
        )
    return F.transform(
        items(mapping),
        lambda m: F.struct(_canonical(F.coalesce(m["role"], F.lit(""))).alias("role"), F.coalesce(m["text"], F.lit("")).alias("text")),
    )


def _json_items(json: Column, mapping: dict) -> Column:
    items = F.from_json(F.get_json_object(json, f"$.{mapping['list']}"), "array<map<string,string>>")
    return F.transform(
        F.coalesce(items, F.array().cast("array<map<string,string>>")),
        lambda m: F.struct(m[mapping["role"]].alias("role"), m[mapping["text"]].alias("text")),
    )


def _row_field(record: Column, kind: T.StructType, name: str) -> Column:
    return F.coalesce(record.getField(name).cast("string"), F.lit("")) if name in kind.names else F.lit("")


def _row_items(record: Column, kind: T.StructType, mapping: dict) -> Column:
    """None where the list's type has no such members; then no fingerprint selects the mapping."""
    name, parts = mapping["list"], (mapping["role"], mapping["text"])
    of = kind[name].dataType if name in kind.names else None
    element = of.elementType if isinstance(of, T.ArrayType) else None
    if not (isinstance(element, T.MapType) and isinstance(element.keyType, T.StringType) or isinstance(element, T.StructType) and set(parts) <= set(element.names)):
        return F.array().cast(_TURNS)
    return F.transform(
        record.getField(name), lambda m: F.struct(*[m[part].cast("string").alias(own) for part, own in zip(parts, ("role", "text"))])
    )


def _selected(key: Column, mappings: dict[str, dict], field: Callable[[str], Column], items: Callable[[dict], Column]) -> Column:
    """The turns of the mapping whose fingerprint ``key`` is; null where none is."""
    out = None
    for layout, mapping in mappings.items():
        hit = key == F.xxhash64(F.lit(canonical(layout)))
        turns = _mapped(mapping, field, items).cast(_TURNS)
        out = F.when(hit, turns) if out is None else out.when(hit, turns)
    return out


def canonical_turns(record: Column | str, mappings: dict[str, dict] = MAPPINGS) -> Column:
    """The record's turns (role, text) by the mapping that its fingerprint selects; null without one."""
    json = F.col(record) if isinstance(record, str) else record

    def pick(s: Column) -> Column:  # the fingerprint is computed once for all mappings
        return _selected(s["key"], mappings, lambda name: _field(s["json"], name), lambda m: _json_items(s["json"], m))

    return F.element_at(F.transform(F.array(F.struct(fingerprint(json).alias("key"), json.alias("json"))), pick), 1)


def unmapped(df: DataFrame, record_col: str) -> DataFrame:
    """Rows whose record no mapping fits."""
    return df.where(canonical_turns(record_col).isNull())


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&lb;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lb;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_turn(role: Column, text: Column) -> Column:
    ours = role == F.lit("assistant")
    return F.concat(
        F.lit("<s>"),
        escape(role),
        F.when(ours, F.lit("[OUT]")).otherwise(F.lit("[INST]")),
        escape(text),
        F.when(ours, F.lit("[/OUT]")).otherwise(F.lit("[/INST]")),
        F.lit("</s>"),
    )


def format_conversations(records: DataFrame, id_col: str, order_col: str, record_col: str) -> DataFrame:
    """conv_id, formatted: one string for each conversation, from JSON records of any known layout.

    Records of one conversation follow each other by ``order_col``.
    """
    return format_turns(turns_of_records(records, id_col, order_col, record_col))


def turns_of_records(records: DataFrame, id_col: str, order_col: str, record_col: str) -> DataFrame:
    """conv_id, turn, k, role, text: the turns of JSON records of any known layout."""
    return records.select(
        F.col(id_col).alias("conv_id"), F.col(order_col).cast("bigint").alias("turn"), F.posexplode(canonical_turns(record_col)).alias("k", "t")
    ).select("conv_id", "turn", "k", F.col("t.role").alias("role"), F.col("t.text").alias("text"))


def turns_of_rows(rows: DataFrame, id_col: str, order_col: str, mappings: dict[str, dict] = MAPPINGS) -> DataFrame:
    """The same of rows whose other columns are the record: the fingerprint of each row's own field paths selects its mapping.

    Texts go from their columns into the turns without JSON. A row that no mapping fits is an error.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in (id_col, order_col)])
    rows = rows.select(F.col(id_col).alias("conv_id"), F.col(order_col).cast("bigint").alias("turn"), record.alias("record"))
    record, kind = F.col("record"), rows.schema["record"].dataType
    rows = rows.withColumn("paths", row_paths(record, kind)).withColumn("key", F.xxhash64("paths"))
    turns = _selected(F.col("key"), mappings, lambda name: _row_field(record, kind, name), lambda m: _row_items(record, kind, m))
    none = F.raise_error(F.concat(F.lit("no mapping fits the fields "), "paths")).cast(_TURNS)
    return rows.select("conv_id", "turn", F.posexplode(F.coalesce(turns, none)).alias("k", "t")).select(
        "conv_id", "turn", "k", F.col("t.role").alias("role"), F.col("t.text").alias("text")
    )


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted: one string for each conversation."""
    item = F.struct("turn", "k", "role", "text")
    blocks = turns.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    made = F.array_join(F.transform("items", lambda i: format_turn(i["role"], i["text"])), "")
    blocks = blocks.select("conv_id", "block", made.alias("made"))
    return blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "made"))).alias("blocks")).select(
        "conv_id", F.expr("array_join(transform(blocks, b -> b.made), '')").alias("formatted")
    )


def read_back(formatted: Column) -> Column:
    """Turns (role, text, loss) of a formatted conversation."""
    parts = F.filter(F.split(formatted, "</s>", -1), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, r"(?s)^<s>([^\[]*)\[", 1)).alias("role"),
            unescape(F.regexp_extract(p, r"(?s)^<s>[^\[]*\[(?:OUT|INST)\]([^\[]*)\[", 1)).alias("text"),
            p.contains("[OUT]").alias("loss"),
        ),
    )

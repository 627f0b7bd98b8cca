"""Chat formatting by schema fingerprints, with DataFrame functions alone.

Records come in many layouts. The field paths of a record that any layout knows, sorted, are hashed to a fingerprint,
which selects a declarative mapping (a role and an expression for each turn) to canonical turns (conv_id, turn, role,
text). A table's fingerprint comes from its schema; records of several layouts in one JSON column have one each, from the
paths that are there, in any element of an array. Paths of no layout's exactly go by the layout of most paths that are all there (of
equal ones, the first). Turns are then formatted with a template that marks them:

    ### role: text</turn>

Its control strings are escaped in roles and texts by a backslash code, so the text is read back exactly; the loss mask is a list
of spans (start, stop in code points of the formatted text) over the texts of the assistant's turns.

Defined results: null roles and texts are as empty ones; a null conversation id is a conversation of its own; turns of
equal number are in the order of role, then text; repeated rows are repeated turns; null turns come first; an empty table gives no rows;
columns that no layout knows are ignored, whatever their names. A conversation is one row, and so made by one task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK, END, AFTER_ROLE = "### ", "</turn>\n", ": "
ASSISTANT = "assistant"
#: Code of each control string, in the order of escaping; the backslash first, so that each code is unambiguous.
CODES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
ROLE_CODES = (*CODES, (":", "\\c"))


@dataclass(frozen=True)
class Layout:
    """paths: the fields that tell the layout; turns: (role, field) of each turn, a field that is missing or empty gives none
    if optional; or list_of: an array's (array, role field, text field); or flat: (conversation, turn, role, text) fields."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str, bool], ...] = ()
    list_of: tuple[str, str, str] | None = None
    flat: tuple[str, str, str, str] | None = None


LAYOUTS = (
    Layout("turn rows", ("conv_id", "turn", "role", "text"), flat=("conv_id", "turn", "role", "text")),
    Layout("messages", ("messages[].role", "messages[].content"), list_of=("messages", "role", "content")),
    Layout("from and value", ("conversations[].from", "conversations[].value"), list_of=("conversations", "from", "value")),
    Layout("prompt and completion", ("prompt", "completion"), turns=(("user", "prompt", False), ("assistant", "completion", False))),
    Layout("prompt and response", ("prompt", "response"), turns=(("user", "prompt", False), ("assistant", "response", False))),
    Layout("instruction", ("instruction", "input", "output"), turns=(("user", "instruction", False), ("user", "input", True), ("assistant", "output", False))),
    Layout("short instruction", ("instruction", "output"), turns=(("user", "instruction", False), ("assistant", "output", False))),
    Layout("system, question and answer", ("system", "question", "answer"), turns=(("system", "system", True), ("user", "question", False), ("assistant", "answer", False))),
)
#: Roles under other names.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def by_fingerprint(layouts=LAYOUTS) -> dict[str, Layout]:
    return {fingerprint(x.paths): x for x in layouts}


def by_size(layouts=LAYOUTS) -> list[Layout]:
    """Layouts of more paths first."""
    return sorted(layouts, key=lambda x: -len(x.paths))


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """The nested field paths of a schema; [] stands for an array's elements."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, prefix + "[]")
    return [prefix]


def _role(role: Column) -> Column:
    out = F.coalesce(role.cast("string"), F.lit(""))
    for other, own in ROLES.items():
        out = F.when(out == other, own).otherwise(out)
    return out


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _listed(layout: Layout, field) -> Column:
    """The turns of a record as an array of (role, text); field(name): the record's field as a column."""
    made = [F.when(F.lit(optional) & (_text(field(name)) == ""), F.lit(None)).otherwise(F.struct(F.lit(role).alias("role"), _text(field(name)).alias("text"))) for role, name, optional in layout.turns]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def _pairs(array: Column, role: str, text: str) -> Column:
    return F.transform(array, lambda x: F.struct(_role(x[role]).alias("role"), _text(x[text]).alias("text")))


def canonical_turns(df: DataFrame, id_col: str = "conv_id", layouts=LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text) of a table in one of the layouts, told by its schema's fingerprint."""
    there = {p for x in layouts for p in x.paths}.intersection(schema_paths(df.schema))
    by = by_fingerprint(layouts)
    layout = by.get(fingerprint(there)) or by.get(fingerprint(there - {id_col}))  # the id belongs to the layout of turn rows alone
    layout = layout or next((x for x in by_size(layouts) if there.issuperset(x.paths)), None)
    if layout is None:
        raise ValueError(f"no layout has the field paths {sorted(there)}")
    if layout.flat:
        conv, turn, role, text = layout.flat
        return df.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), _text(F.col(text)).alias("text"))
    if layout.list_of:
        array, role, text = layout.list_of
        turns = _pairs(F.col(array), role, text)
    else:
        turns = _listed(layout, F.col)
    return df.select(F.col(id_col).alias("conv_id"), F.posexplode(turns).alias("turn", "x")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "x.role", "x.text")


def canonical_turns_of_json(df: DataFrame, json_col: str, id_col: str = "conv_id", layouts=LAYOUTS) -> DataFrame:
    """The same of JSON records of any of the layouts; records that are no JSON, or of no layout, give no turns."""
    known = sorted({p for x in layouts if not x.flat for p in x.paths})
    json = F.col("record")

    def has(path: str) -> Column:
        array, _, field = path.partition("[].")
        if not field:
            return F.try_variant_get(json, f"$.{path}", "variant").isNotNull()
        elements = F.try_variant_get(json, f"$.{array}", "array<variant>")
        return F.coalesce(F.exists(elements, lambda x: F.try_variant_get(x, f"$.{field}", "variant").isNotNull()), F.lit(False))

    there = [F.when(has(p), F.lit(p)) for p in known]
    record = df.select(F.col(id_col).alias("conv_id"), F.try_parse_json(F.col(json_col)).alias("record"))
    record = record.select("conv_id", "record", F.array_compact(F.array(*there)).alias("paths"))
    record = record.withColumn("fingerprint", F.sha2(F.array_join("paths", "\n"), 256))
    turns, rest = F.lit(None).cast("array<struct<role: string, text: string>>"), []
    for layout in by_size([x for x in layouts if not x.flat]):
        if layout.list_of:
            array, role, text = layout.list_of
            read = F.try_variant_get(json, f"$.{array}", f"array<struct<`{role}`: string, `{text}`: string>>")
            made = _pairs(read, role, text)
        else:
            made = _listed(layout, lambda name: F.try_variant_get(json, f"$.{name}", "string"))
        turns = F.when(F.col("fingerprint") == fingerprint(layout.paths), made).otherwise(turns)
        rest.append((F.size(F.array_except(F.array(*map(F.lit, layout.paths)), F.col("paths"))) == 0, made))
    for all_there, made in rest:
        turns = F.coalesce(turns, F.when(all_there, made))
    return record.select("conv_id", F.posexplode(turns).alias("turn", "x")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "x.role", "x.text")


def escaped(text: Column, codes=CODES) -> Column:
    for control, code in codes:
        text = F.replace(text, F.lit(control), F.lit(code))
    return text


def unescaped(text: Column, codes=CODES) -> Column:
    for control, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(control))
    return text


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss: array of (start, stop)) of canonical turns. Turns are shuffled once, by conversation."""
    head = F.concat(F.lit(MARK), escaped(F.col("role"), ROLE_CODES), F.lit(AFTER_ROLE))
    parts = turns.select("conv_id", "turn", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"))
    parts = parts.select("conv_id", "turn", "role", "text", "head", "body", (F.length("head") + F.length("body") + len(END)).cast("bigint").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("at", F.coalesce(F.sum("chars").over(order), F.lit(0)))
    start = F.col("at") + F.length("head")
    span = F.when(F.col("role") == ASSISTANT, F.struct(start.alias("start"), (start + F.length("body")).alias("stop")))
    made = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece")))).alias("pieces"), F.array_sort(F.collect_list(span)).alias("loss"))
    return made.select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (role, text), loss_texts: the texts under the loss mask) from formatted texts."""
    pieces = F.split(F.col("formatted"), END)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, AFTER_ROLE, 1)
        role = F.substr(head, F.lit(len(MARK) + 1))
        return F.struct(unescaped(role, ROLE_CODES).alias("role"), unescaped(F.substr(piece, F.length(head) + len(AFTER_ROLE) + 1)).alias("text"))

    masked = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), masked.alias("loss_texts"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of formatted texts, as read back."""
    back = read_back(formatted)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.array_join("loss_texts", "").alias("masked"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("masked").cast("bigint").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars")


#: The same rows in DuckDB's SQL, from the turns themselves; only formatted_chars knows of the template.
ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e'))
    + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c')) + 14 AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

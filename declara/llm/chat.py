"""Chat formatting: schema fingerprints choose a mapping to canonical turns; a reversible template.

A mapping is declarative: the paths of nested fields that it needs, and where the
role and the text of each turn are found. Its fingerprint is a hash over its
sorted paths. A layout's paths are projected on those of each mapping in turn,
and the hash of what is left chooses the first mapping whose fingerprint it is;
fields that a mapping doesn't name make no difference. For a table the paths come
from its schema; for a column of JSON records they are taken from each record
(from all entries of its lists), so records of several layouts can be mixed.

Template: ``<s>`` role newline text ``</s>`` for each turn. Within roles and
texts a backslash is doubled and the control strings get one inside
(``<\\s>``, ``<\\/s>``, ``[\\INST]``, ``[\\/INST]``); in a role a newline is ``\\n``.
The marks of turns thus occur nowhere else, and the text can be read back. The
loss mask holds the spans (code points, from 0, end exclusive) of the texts of
assistants, in order.

All of it is DataFrame expressions. The turns of a conversation are numbered by
a window and gathered in one row, which is the result itself.

Defined results: null text or role is empty; turns with one number follow by
role and text, and repeated turns stay; a turn row without a conversation id is a
conversation of its own, as nothing says with which others it belongs, and so is
each record, whether or not others have its id; a record that fits no mapping, or
a null one, has no turns: its layout is ``unknown``, and its text stays in
``raw``; a list of messages without entries is a conversation without turns; a
table without rows has no conversations; extra columns and fields have no part.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted

TURN = "struct<role:string,text:string>"
CONTROL = r"(<|\[)(/?(?:s>|INST\]))"
UNKNOWN = "unknown"


def _pair(question: str, answer: str) -> str:
    return f"array(named_struct('role', 'user', 'text', {question}), named_struct('role', 'assistant', 'text', {answer}))"


def _entries(field: str, role: str, text: str) -> str:
    known = f"CASE m.{role} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.{role} END"
    return f"transform(r.{field}, m -> named_struct('role', {known}, 'text', m.{text}))"


def _with(main: str, more: str) -> str:
    """An instruction, and below a blank line what it is about, where there is any."""
    return f"r.{main} || CASE WHEN coalesce(r.{more}, '') = '' THEN '' ELSE '\\n\\n' || r.{more} END"


#: Layout: (paths it needs, turns as SQL over a parsed record `r`), in the order in which they are tried.
MAPPINGS: dict[str, tuple[tuple[str, ...], str]] = {
    "messages": (("messages[].content", "messages[].role"), _entries("messages", "role", "content")),
    "from_value": (("conversations[].from", "conversations[].value"), _entries("conversations", "`from`", "value")),
    "conversations": (("conversations[].content", "conversations[].role"), _entries("conversations", "role", "content")),
    "prompt_completion": (("completion", "prompt"), _pair("r.prompt", "r.completion")),
    "prompt_response": (("prompt", "response"), _pair("r.prompt", "r.response")),
    "instruction": (("instruction", "output"), _pair(_with("instruction", "input"), "r.output")),
    "instruction_response": (("instruction", "response"), _pair(_with("instruction", "context"), "r.response")),
    "question_answer": (("answer", "question"), _pair("r.question", "r.answer")),
    "no_messages": (("messages",), "array()"),
    "no_conversations": (("conversations",), "array()"),
}
ROWS = ("conv_id", "role", "text", "turn")
LISTS = ("messages", "conversations")
PARSED = (
    "struct<messages:array<struct<role:string,content:string>>,conversations:array<struct<`from`:string,value:string,role:string,content:string>>,"
    "prompt:string,completion:string,response:string,instruction:string,input:string,context:string,output:string,question:string,answer:string>"
)


def paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Paths of the leaves of a schema; [] stands for the entries of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, prefix + "[]")
    return [prefix]


def fingerprint(found: list[str]) -> str:
    return hashlib.md5("\n".join(sorted(set(found))).encode()).hexdigest()


#: Fingerprint: mapping.
BY_MARK = {fingerprint(list(needed)): name for name, (needed, _) in MAPPINGS.items()} | {fingerprint(list(ROWS)): "turn_rows"}


def mark_of(found: Column, needed: tuple[str, ...]) -> Column:
    """The fingerprint of an array of paths, projected on those that a mapping needs."""
    some = F.array_sort(F.array_intersect(found, F.array(*map(F.lit, needed))))
    return F.md5(F.array_join(some, "\n").cast("binary"))


def record_paths(record: Column) -> Column:
    """The paths of a JSON record: its top fields, and the fields of objects in all entries of its lists."""
    none = F.array().cast("array<string>")
    top = F.coalesce(F.json_object_keys(record), none)

    def below(name: str) -> Column:
        entries = F.from_json(F.get_json_object(record, f"$.{name}"), "array<map<string,string>>")
        inner = F.array_distinct(F.flatten(F.transform(F.filter(entries, lambda e: e.isNotNull()), lambda e: F.map_keys(e))))
        named = F.transform(inner, lambda k: F.concat(F.lit(f"{name}[]."), k))
        return F.when(F.array_contains(top, name), F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(name)))).otherwise(none)

    return F.array_distinct(F.concat(F.filter(top, lambda k: ~k.isin(*LISTS)), *map(below, LISTS)))


def from_records(records: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """(conv_id, own, layout, schema_mark, raw, turn, role, text) of JSON records of any known layouts.

    own: a number for each record; raw: the record where its layout is unknown.
    """
    marked = records.select(quoted(id_col).alias("conv_id"), F.monotonically_increasing_id().alias("own"), quoted(record_col).alias("raw"))
    marked = marked.withColumn("paths", record_paths(F.col("raw")))
    layout, mark = F.lit(UNKNOWN), F.md5(F.array_join(F.array_sort("paths"), "\n").cast("binary"))
    for name, (needed, _) in reversed(MAPPINGS.items()):
        own = mark_of(F.col("paths"), needed)
        layout, mark = F.when(own == fingerprint(list(needed)), name).otherwise(layout), F.when(own == fingerprint(list(needed)), own).otherwise(mark)
    marked = marked.withColumn("layout", layout).withColumn("schema_mark", mark).withColumn("r", F.from_json("raw", PARSED))
    turns = F.array().cast(f"array<{TURN}>")
    for name, (_, expression) in MAPPINGS.items():
        turns = F.when(F.col("layout") == name, F.expr(expression).cast(f"array<{TURN}>")).otherwise(turns)
    marked = marked.select("conv_id", "own", "layout", "schema_mark", F.when(F.col("layout") == UNKNOWN, F.col("raw")).alias("raw"), F.posexplode_outer(turns).alias("turn", "t"))
    # A turn keeps its place even where neither role nor text is given.
    there = lambda c: F.when(F.col("turn").isNotNull(), F.coalesce(c, F.lit("")))
    return marked.select("conv_id", "own", "layout", "schema_mark", "raw", F.col("turn").cast("long").alias("turn"), there(F.col("t.role")).alias("role"), there(F.col("t.text")).alias("text"))


def canonical(table: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The same for a table, whose schema has one fingerprint for all rows."""
    found = set(paths(table.schema))
    if BY_MARK.get(fingerprint([p for p in ROWS if p in found])) == "turn_rows":
        own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("own")  # rows without an id stay apart
        return table.select("conv_id", own, F.lit("turn_rows").alias("layout"), F.lit(fingerprint(list(ROWS))).alias("schema_mark"), F.lit(None).cast("string").alias("raw"), "turn", "role", "text")
    whole = F.to_json(F.struct(*(quoted(c) for c in table.columns if c != id_col)), {"ignoreNullFields": "false"})
    return from_records(table.select(quoted(id_col).alias("conv_id"), whole.alias("raw")), "conv_id", "raw")


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    """Split at doubled backslashes, so that an ``\\n`` is a newline and nothing else."""
    parts = F.transform(F.split(role, r"\\\\"), lambda p: unescaped(F.replace(p, F.lit("\\n"), F.lit("\n"))))
    return F.array_join(parts, "\\")


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, layout, raw, n_turns, formatted, loss_mask array<struct<start, end>>) of canonical turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # A record of an unknown layout, or without turns, has one row, without a turn.
    is_turn = F.col("turn").isNotNull() | F.col("role").isNotNull() | F.col("text").isNotNull()
    shaped = turns.select("conv_id", "own", "layout", "raw", "turn", role.alias("role"), text.alias("text"), is_turn.alias("is_turn"))
    shaped = shaped.withColumn("head", F.concat(F.lit("<s>"), escaped_role(F.col("role")), F.lit("\n"))).withColumn("body", escaped(F.col("text")))
    order = Window.partitionBy("conv_id", "own").orderBy("turn", "role", "text")
    size = F.when(F.col("is_turn"), F.length("head") + F.length("body") + F.lit(4)).otherwise(F.lit(0)).cast("long")
    shaped = shaped.withColumn("at", F.row_number().over(order)).withColumn("end", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 4)
    piece = F.struct("at", "head", "body", "end", (F.col("role") == trained).alias("loss"))
    gathered = F.array_sort(F.collect_list(F.when(F.col("is_turn"), piece)))
    whole = shaped.groupBy("conv_id", "own").agg(F.first("layout").alias("layout"), F.first("raw").alias("raw"), gathered.alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit("</s>"))), "")
    mask = F.transform(F.filter("turns", lambda t: t.loss), lambda t: F.struct((t.end - F.length(t.body)).alias("start"), t.end.alias("end")))
    return whole.select("conv_id", "layout", "raw", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"), mask.alias("loss_mask"))


def parse_chat(formatted: Column) -> Column:
    """array<struct<role, text>> read back from formatted text."""
    pieces = F.filter(F.split(formatted, "</s>"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "\n")
        return F.struct(unescaped_role(F.substring(piece, F.lit(4), at - 4)).alias("role"), unescaped(F.substring(piece, at + 1, F.length(piece))).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(formatted, (m.start + 1).cast("int"), (m.end - m.start).cast("int")))), "")

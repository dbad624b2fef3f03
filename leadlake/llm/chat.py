"""Operator 9: chat formatting by schema fingerprints.

The nested field paths of a JSON record, sorted and hashed, are its fingerprint. Each distinct fingerprint is matched once
against declarative mappings; the records then follow their fingerprint's mapping, in Spark's own JSON functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = {"human": "user", "user": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "assistant": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant", "ai": "assistant", "system": "system", "developer": "system", "tool": "tool", "function": "tool"}


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths that a record must have, the schema to read it by, and an expression over the record ``r`` for
    array<struct<role string, text string>>."""

    name: str
    paths: frozenset[str]
    schema: str
    turns: str


def _list(name: str, prefix: str, role: str, text: str) -> Mapping:
    """A list of objects with a role and a text, under a path of field names."""
    fields = prefix.split(".") if prefix else []
    schema = f"array<struct<`{role}`: string, `{text}`: string>>"
    for field in reversed(fields):
        schema = f"struct<`{field}`: {schema}>"
    base = "".join(f".`{f}`" for f in fields)
    path = (prefix + "[]") if prefix else "[]"
    return Mapping(name, frozenset({f"{path}.{role}", f"{path}.{text}"}), schema, f"transform(r{base}, x -> struct(x.`{role}` as role, x.`{text}` as text))")


def _fields(name: str, needed: list[tuple[str, str]], optional: list[tuple[str, str]] = [], order: list[str] | None = None) -> Mapping:
    """Single fields, each a turn of a fixed role, in the order given."""
    every = dict([*needed, *optional])
    schema = "struct<" + ", ".join(f"`{f}`: string" for f in every) + ">"
    return Mapping(name, frozenset(f for f, _ in needed), schema, "array(" + ", ".join(f"struct('{every[f]}' as role, r.`{f}` as text)" for f in order or every) + ")")


#: Tried in this order; the first whose paths a record has.
MAPPINGS: list[Mapping] = [
    Mapping("turns", frozenset({"turns[].role", "turns[].text", "turns[].turn"}), "struct<turns: array<struct<turn: bigint, role: string, text: string>>>", "transform(array_sort(r.turns, (a, b) -> case when coalesce(a.turn, -1) < coalesce(b.turn, -1) then -1 when coalesce(a.turn, -1) > coalesce(b.turn, -1) then 1 when coalesce(a.role, '') < coalesce(b.role, '') then -1 when coalesce(a.role, '') > coalesce(b.role, '') then 1 when coalesce(a.text, '') < coalesce(b.text, '') then -1 when coalesce(a.text, '') > coalesce(b.text, '') then 1 else 0 end), x -> struct(x.role as role, x.text as text))"),
    _list("messages", "messages", "role", "content"),
    _list("sharegpt", "conversations", "from", "value"),
    _list("nested messages", "data.messages", "role", "content"),
    _list("message list", "", "role", "content"),
    Mapping("instruction with input", frozenset({"instruction", "input", "output"}), "struct<system: string, instruction: string, input: string, output: string>", "array(struct('system' as role, r.system as text), struct('user' as role, concat_ws('\n\n', r.instruction, nullif(trim(r.input), '')) as text), struct('assistant' as role, r.output as text))"),
    _fields("instruction", [("instruction", "user"), ("output", "assistant")], [("system", "system")], ["system", "instruction", "output"]),
    _fields("instruction response", [("instruction", "user"), ("response", "assistant")], [("system", "system")], ["system", "instruction", "response"]),
    _fields("prompt", [("prompt", "user"), ("completion", "assistant")], [("system", "system")], ["system", "prompt", "completion"]),
    _fields("prompt response", [("prompt", "user"), ("response", "assistant")], [("system", "system")], ["system", "prompt", "response"]),
    _fields("question", [("question", "user"), ("answer", "assistant")], [("context", "system")], ["context", "question", "answer"]),
]


def schema_paths(schema: str) -> list[str]:
    """The field paths of a variant's schema, such as OBJECT<a: ARRAY<OBJECT<b: STRING>>>, sorted; every inner node is one."""
    out: set[str] = set()
    at = 0

    def name() -> str:
        nonlocal at
        if schema[at] == "`":
            at += 1
            text = ""
            while schema[at] != "`" or schema[at : at + 2] == "``":
                text += schema[at]
                at += 2 if schema[at] == "`" else 1
            at += 1
        else:
            text = ""
            while schema[at] != ":":
                text += schema[at]
                at += 1
        return text.strip()

    def kind(path: str) -> None:
        nonlocal at
        if schema.startswith("OBJECT<", at):
            at += 7
            while schema[at] != ">":
                field = name()
                at += 1
                while schema[at] == " ":
                    at += 1
                inner = f"{path}.{field}" if path else field
                out.add(inner)
                kind(inner)
                while schema[at] in ", ":
                    at += 1
            at += 1
        elif schema.startswith("ARRAY<", at):
            at += 6
            out.add(path + "[]")
            kind(path + "[]")
            at += 1
        else:
            depth = 0
            while at < len(schema) and (depth or schema[at] not in ",>"):
                depth += (schema[at] == "(") - (schema[at] == ")")
                at += 1

    kind("")
    return sorted(out)


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(paths).encode()).hexdigest()[:16]


def _layouts(mappings: list[Mapping]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [schema_paths(s) for s in batch.column(0).to_pylist()]
            names = [next((m.name for m in mappings if m.paths <= set(paths)), None) for paths in every]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(p) for p in every], pa.string()), pa.array(names, pa.string())], ["_schema", "_print", "layout"])

    return run


def role_of(role: Column) -> Column:
    """The canonical name; null and blank are the user's, an unknown name stays in lower case."""
    plain = F.lower(F.trim(role))
    table = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.when(plain.isNull() | (plain == ""), "user").otherwise(F.coalesce(F.element_at(table, plain), plain))


def format_chats(records: DataFrame, id_column: str = "conv_id", record: str = "record", mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """(<id>, fingerprint, layout, turn, role, text): the canonical turns of JSON records, numbered from 0.

    Turns without text (null or blank) are dropped, and the rest numbered anew; text keeps its inner white space and loses
    the outer. A record of no known layout, or that is null or no JSON, or that has no turn with text, gives one row with null turn, role and
    text, so nothing is lost unseen; its layout is null unless it was known. Repeated records are each given. An empty table
    gives no row. Other columns aren't read, whatever their names.
    """
    own = records.select(F.col(id_column).alias("_id"), F.col(record).cast("string").alias("_record"))
    shaped = own.withColumn("_schema", F.coalesce(F.schema_of_variant(F.try_parse_json("_record")), F.lit("VOID")))
    known = shaped.select("_schema").distinct().mapInArrow(_layouts(mappings), "_schema string, _print string, layout string")
    joined = shaped.join(known, "_schema")
    turns = None
    for m in mappings:
        read = F.expr(f"transform(array(from_json(_record, '{m.schema}')), r -> {m.turns})[0]".replace("\n", "\\n"))
        turns = F.when(F.col("layout") == m.name, read) if turns is None else turns.when(F.col("layout") == m.name, read)
    clean = F.transform(F.coalesce(turns, F.array().cast("array<struct<role: string, text: string>>")), lambda t: F.struct(role_of(t["role"]).alias("role"), F.regexp_replace(t["text"], r"^\s+|\s+$", "").alias("text")))
    kept = joined.select("_id", "_print", "layout", F.filter(clean, lambda t: t["text"] != "").alias("_turns"))
    out = kept.select("_id", "_print", "layout", F.posexplode_outer("_turns").alias("turn", "_turn"))
    return out.select(F.col("_id").alias(id_column), F.col("_print").alias("fingerprint"), "layout", "turn", F.col("_turn.role").alias("role"), F.col("_turn.text").alias("text"))


def pack_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, record): tables that hold a turn in each row (conv_id, turn, role, text), a JSON record for each conversation.

    Rows without conv_id are left out.
    """
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    packed = rows.where("conv_id is not null").groupBy("conv_id").agg(F.collect_list(one).alias("turns"))
    return packed.select("conv_id", F.to_json(F.struct("turns"), {"ignoreNullFields": "false"}).alias("record"))

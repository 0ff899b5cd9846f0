"""Chat formatting: schema fingerprints choose declarative mappings into canonical turns.

A layout's fingerprint is the SHA-256 of its sorted nested field paths ("messages[].role").  The
registry maps fingerprints to mappings, which say in data where turns, roles and texts are.  Typed
tables have one fingerprint, read from their schema; JSON records have one each.

The template of a turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts a
backslash is put between ``<`` and ``|`` (one more if there are some), and a line end in a role
becomes ``<|nl|>``; so control strings stand only where the template puts them, and both can be undone.
The loss mask covers the text of assistant turns, without its marks.

A conversation's output is one text, its turns with nothing between, and its loss mask is spans of
that text.  It is written in pieces of bounded length that don't keep to turns, and read back from
them alone: turns are found by their marks, the masked text by its spans.

Defined results: null texts and roles are empty; turns are ordered by turn (null first), then role
and text; null ids are one conversation; repeated rows are repeated turns; fields that no mapping
names are ignored; a record with an unknown fingerprint has a null layout and no turns; a record's
turn number that is no number is null; an empty table gives no rows.  A conversation is a stream of
pieces, so its length is not bounded by memory; a single turn's text must fit in it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curalith.llm.storage import shuffle_width

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns.  ``fields``: its paths.  Either ``each`` names a list and
    ``role`` and ``text`` are paths inside its items (or in the row itself, with ``order``), or
    ``parts`` lists (role, paths of the text's parts).  ``roles`` renames roles."""

    name: str
    fields: tuple[str, ...]
    each: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)


_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("turn_rows", ("role", "text", "turn"), role="role", text="text", order="turn"),
    Mapping("messages", ("messages[].content", "messages[].role"), each="messages", role="role", text="content", roles=_NAMES),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value", roles=_NAMES),
    Mapping("prompt", ("prompt", "response"), parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", ("completion", "prompt"), parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("system_prompt", ("prompt", "response", "system"), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", ("instruction", "output"), parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", ("input", "instruction", "output"), parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question", ("answer", "question"), parts=(("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint(paths) -> str:
    return sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def registry(mappings=MAPPINGS) -> tuple[dict[str, Mapping], frozenset[str]]:
    """Mappings by fingerprint, and all fields that any of them names."""
    return {fingerprint(m.fields): m for m in mappings}, frozenset(p for m in mappings for p in m.fields)


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """The nested field paths of a Spark type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def record_paths(value, prefix: str = "") -> set[str]:
    """The nested field paths of a JSON value."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in record_paths(v, f"{prefix}.{k}" if prefix else k)}
    if isinstance(value, list):
        return {p for v in value for p in record_paths(v, f"{prefix}[]")} or {f"{prefix}[]"}
    return {prefix}


def mapping_of(schema: T.StructType, mappings=MAPPINGS) -> Mapping:
    known, named = registry(mappings)
    found = known.get(fingerprint(p for p in schema_paths(schema) if p in named))
    if found is None:
        raise ValueError(f"no mapping has the fields {sorted(p for p in schema_paths(schema) if p in named)}")
    return found


def typed_turns(rows: DataFrame, id_column: str, mappings=MAPPINGS) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a typed table, by its schema's fingerprint."""
    m = mapping_of(rows.schema, mappings)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    renamed = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in m.roles.items() for x in kv])[c], c) if m.roles else c
    key = F.col(id_column).alias("conv_id")
    if m.order:
        return rows.select(key, F.col(m.order).cast("long").alias("turn"), renamed(text(F.col(m.role))).alias("role"), text(F.col(m.text)).alias("text"))
    if m.each:
        items = rows.select(key, F.posexplode(m.each).alias("turn", "x"))
        return items.select("conv_id", F.col("turn").cast("long"), renamed(text(F.col(f"x.{m.role}"))).alias("role"), text(F.col(f"x.{m.text}")).alias("text"))
    parts = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[text(F.col(p)) for p in paths]), lambda x: x != ""), "\n\n").alias("text")) for role, paths in m.parts]
    return rows.select(key, F.posexplode(F.array(*parts)).alias("turn", "x")).select("conv_id", F.col("turn").cast("long"), "x.role", "x.text")


def _at(value, path: str):
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _whole(value) -> int | None:
    """A turn number as JSON gives it; null where it is none."""
    try:
        number = int(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return number if -(1 << 63) <= number < 1 << 63 else None


def json_turns(records: DataFrame, id_column: str, json_column: str, mappings=MAPPINGS) -> DataFrame:
    """Canonical turns of JSON records, each by its own fingerprint: conv_id, layout, turn, role,
    text.  A record that is no JSON object or has an unknown layout gives one row with nulls."""
    known, named = registry(mappings)

    def turns(text: str | None) -> list[tuple]:
        try:
            record = json.loads(text or "null")
        except ValueError:
            record = None
        m = known.get(fingerprint(p for p in record_paths(record) if p in named)) if isinstance(record, dict) else None
        if m is None:
            return [(None, None, None, None)]
        if m.each:
            return [(m.name, k, m.roles.get(role := _at(x, m.role), role), _at(x, m.text)) for k, x in enumerate(record[m.each])]
        if m.order:
            return [(m.name, _whole(record[m.order]), _at(record, m.role), _at(record, m.text))]
        return [(m.name, k, role, "\n\n".join(t for p in paths if (t := _at(record, p)))) for k, (role, paths) in enumerate(m.parts)]

    def run(batches):
        for batch in batches:
            out = [(key, *turn) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for turn in turns(text)]
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (batch.column(0).type, pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["conv_id", "layout", "turn", "role", "text"])

    kind = records.schema[id_column].dataType.simpleString()
    return records.select(F.col(id_column).alias("conv_id"), F.col(json_column)).mapInArrow(run, f"conv_id {kind}, layout string, turn long, role string, text string")


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def formatted_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, formatted, loss_start, loss_length: each turn in the template, and where
    the loss mask lies in it (code points; length 0 for other roles).  A conversation's text is
    that of its turns in order (turn, role, text), nothing between."""
    role = F.regexp_replace(escaped(F.coalesce("role", F.lit(""))), "\n", F.lit(LINE))
    text = escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    length = F.when(F.col("role") == "assistant", F.char_length(text)).otherwise(0)
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.concat(head, text, F.lit(END + "\n")).alias("formatted"), F.char_length(head).alias("loss_start"), length.alias("loss_length"))


def in_order(formatted: DataFrame) -> DataFrame:
    """The turns of each conversation together and in their order."""
    width = shuffle_width(formatted.sparkSession)
    return formatted.repartition(width, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss_start", "loss_length")


#: Code points of a piece of a conversation's output.
PIECE = 1 << 16
PIECES = "conv_id long, piece long, text string, loss array<struct<start: long, length: long>>, last boolean"
_PIECES = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("last", pa.bool_())])


def _conversations(batches, columns):
    """(key, rows) of each run of equal first columns, rows being read as they come."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
    return groupby(rows, key=lambda row: row[0])


def assembled(ordered: DataFrame) -> DataFrame:
    """conv_id, piece, text, loss, last: each conversation's output, cut every PIECE code points;
    ``loss`` has the mask's spans (in the whole output) that begin in the piece."""

    def cut(key, rows):
        ready, done, total, spans, piece = "", 0, 0, [], 0
        for _, turn, start, length in rows:
            if length:
                spans.append({"start": total + start, "length": length})
            ready += turn
            total += len(turn)
            while len(ready) > PIECE:
                own = [x for x in spans if x["start"] < done + PIECE]
                yield key, piece, ready[:PIECE], own, False
                spans, ready, done, piece = spans[len(own) :], ready[PIECE:], done + PIECE, piece + 1
        yield key, piece, ready, spans, True

    def run(batches):
        pieces = (x for key, rows in _conversations(batches, ["conv_id", "formatted", "loss_start", "loss_length"]) for x in cut(key, rows))
        while some := list(islice(pieces, 256)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return ordered.mapInArrow(run, PIECES)


class Reader:
    """Reads one conversation's output piece by piece: what turns and masked texts it holds."""

    def __init__(self):
        self.text, self.at, self.spans = "", 0, []
        self.turns, self.loss_chars, self.chars = 0, 0, 0
        self.said, self.loss = sha256(), sha256()

    def feed(self, text: str, spans: list[dict]) -> None:
        self.text += text
        self.chars += len(text)
        self.spans += [(x["start"], x["start"] + x["length"]) for x in spans]
        done = 0
        while (end := self.text.find(END + "\n", done)) >= 0:
            if not self.text.startswith(START, done):
                raise ValueError("a turn lacks its first mark")
            role, _, said = self.text[done + len(START) : end].partition("\n")
            self.said.update(f"{unescape(role.replace(LINE, chr(10)))}\n{unescape(said)}\n".encode())
            self.turns += 1
            done = end + len(END) + 1
        while self.spans and self.spans[0][1] <= self.at + done:
            start, end = self.spans.pop(0)
            masked = unescape(self.text[start - self.at : end - self.at])
            self.loss.update(masked.encode())
            self.loss_chars += len(masked)
        self.text, self.at = self.text[done:], self.at + done

    def row(self, key) -> tuple:
        if self.text or self.spans:
            raise ValueError("a turn lacks its last mark, or the loss mask goes beyond the text")
        return key, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, from the pieces of its output (in order) and their loss mask."""

    def run(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

        def digests():
            for key, rows in _conversations(batches, ["conv_id", "text", "loss"]):
                reader = Reader()
                for _, text, spans in rows:
                    reader.feed(text, spans)
                yield reader.row(key)

        found = digests()
        while some := list(islice(found, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    return pieces.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


CONTROL = "<|im_end|><|im_start|>assistant ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return read_back(assembled(in_order(formatted_turns(typed_turns(rows.unionByName(control), "conv_id")))))


ORACLE_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 2}
    + length(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '{LINE}'))
    + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

"""Chat formatting: records of different layouts become canonical turns, and turns become a reversible template.

A record's nested field paths are hashed to a fingerprint; the fingerprint selects a declarative mapping.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``fields``: the sorted field paths of the layout, list items as ``[]``. ``turns``: (role, path) for layouts with a
    field per turn; a role that starts with ``$`` names the field that holds the role. ``items``: path of a list whose
    members hold the turns. ``aliases``: role names to canonical ones.
    """

    name: str
    fields: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    items: str = ""
    aliases: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.fields)


MAPPINGS = (
    Mapping("turn row", ("conv_id", "role", "text", "turn"), (("$role", "text"),)),
    Mapping("prompt", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping("completion", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", ("input", "instruction", "output"), (("user", "instruction"), ("user+", "input"), ("assistant", "output"))),
    Mapping("short instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping("messages", ("messages", "messages[].content", "messages[].role"), (("$role", "content"),), "messages"),
    Mapping("conversations", ("conversations", "conversations[].from", "conversations[].value"), (("$from", "value"),), "conversations"),
)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def field_paths(value: object, at: str = "") -> Iterator[str]:
    """Every nested field path of a parsed record; a null is a leaf, list items share ``[]``."""
    if isinstance(value, dict):
        for name, inner in value.items():
            path = f"{at}.{name}" if at else name
            yield path
            yield from field_paths(inner, path)
    elif isinstance(value, list):
        for inner in value:
            yield from field_paths(inner, f"{at}[]")


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """Canonical (role, text) turns; a null text is empty, ``user+`` joins a non-empty text to the turn before."""
    alias, turns = dict(mapping.aliases), []
    for item in (record.get(mapping.items) or []) if mapping.items else [record]:
        for role, field in mapping.turns:
            text = item.get(field)
            text = "" if text is None else str(text)
            if role.endswith("+"):
                if text:
                    turns[-1] = (turns[-1][0], f"{turns[-1][1]}\n\n{text}")
                continue
            role = item.get(role[1:]) if role[0] == "$" else role
            turns.append((alias.get(role, role) or "", text))
    return turns


def canonical_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS, record_col: str = "record") -> DataFrame:
    """``records`` plus ``layout`` and ``turns``: array of (role, text). ``record_col`` holds a JSON object a row.

    Defined cases: null, malformed or non-object records and unknown layouts have a null layout and no turns; a null
    text is empty, a null role is ""; repeated records give a row each; an empty table gives no rows. Columns of other
    names are carried along; ``layout`` and ``turns`` replace columns of these names.
    """
    by_print = {m.fingerprint: m for m in mappings}
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layouts, turns = [], []
            for raw in batch.column(batch.num_columns - 1):
                try:
                    record = json.loads(raw.as_py() or "null")
                except ValueError:
                    record = None
                mapping = by_print.get(fingerprint(field_paths(record))) if isinstance(record, dict) else None
                layouts.append(mapping.name if mapping else None)
                turns.append([{"role": r, "text": t} for r, t in turns_of(record, mapping)] if mapping else [])
            columns = [*batch.columns[:-1], pa.array(layouts, pa.string()), pa.array(turns, pa.list_(turn))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "layout", "turns"])

    carried = [c for c in records.columns if c not in ("layout", "turns")]
    rows = records.select(*carried, F.col(record_col).alias("__record"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(convert, f"{schema}, layout string, turns array<struct<role:string,text:string>>")


def escaped(text: Column) -> Column:
    """A backslash more in every ``<|`` and ``<\\...\\|``, so that no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def formatted_turn(role: Column, text: Column) -> Column:
    """One turn of the template; a line feed or backslash in a role is written with a backslash."""
    plain_role = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit(START), escaped(plain_role), F.lit("\n"), escaped(text), F.lit(END + "\n"))


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns`` (with role and text) plus ``piece``, the formatted turn, and ``loss_from``/``loss_to``: the trained
    code points of the piece, end exclusive, null for roles that are not trained. Row-wise expressions, no shuffle.

    The template of a conversation is its pieces in order; a piece a row keeps memory bounded for any conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    trained = role == TRAINED
    piece = formatted_turn(role, text)
    to = F.length(piece) - len(END) - 1
    return turns.select(
        "*",
        piece.alias("piece"),
        F.when(trained, len(START) + len(TRAINED) + 1).cast("int").alias("loss_from"),
        F.when(trained, to).cast("int").alias("loss_to"),
    )


PIECE = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.S)


def parse_piece(piece: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    role, text = PIECE.fullmatch(piece).groups()
    role = re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))
    return role, unescape(text)


class _Digest:
    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.n_turns, self.loss_chars, self.formatted_chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int | None, end: int | None) -> None:
        role, text = parse_piece(piece)
        self.n_turns += 1
        self.formatted_chars += len(piece)
        self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            trained = unescape(piece[start:end])
            self.loss_chars += len(trained)
            self.loss.update(trained.encode())

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def conversation_digests(pieces: DataFrame, id_col: str = "conv_id", order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """Per conversation what its formatted pieces hold when read back: turns, trained text, lengths.

    Rows are dealt by conversation, sorted in the task and read as a stream with one running digest, so that a
    conversation of any length needs a batch of memory. Null ids are one conversation; equal turns are all kept.
    """
    id_type = pieces.schema[id_col].dataType.simpleString()
    dealt = pieces.select(F.col(id_col).alias("conv_id"), "piece", "loss_from", "loss_to", F.struct(*order).alias("place"))
    dealt = dealt.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("place"))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_digest: _Digest | None = None
        for batch in batches:
            done = []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for conv_id, piece, start, end in zip(*columns, strict=True):
                if open_digest is None or open_digest.conv_id != conv_id:
                    if open_digest is not None:
                        done.append(open_digest.row())
                    open_digest = _Digest(conv_id)
                open_digest.add(piece, start, end)
            yield _batch(done, batch.schema.field(0).type, names)
            id_type_arrow = batch.schema.field(0).type
        if open_digest is not None:
            yield _batch([open_digest.row()], id_type_arrow, names)

    schema = f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return dealt.drop("place").mapInArrow(read_back, schema)


def _batch(rows: list[tuple], id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

"""Chat formatting: a finite-state machine over roles emits segments with loss flags from a declarative template.

A ``Template`` names the strings around a turn, the roles whose texts are
learned, and the allowed moves between roles. Rows are dealt by conversation and
sorted by turn; a task streams them through the machine, holding one turn at a
time, so neither a long conversation nor a hot one is gathered in memory.

Control strings inside texts are escaped: ``\\`` becomes ``\\\\`` and ``<|``
becomes ``<\\|`` (in roles a newline also becomes ``\\n``), so the marks of the
template occur only where the template puts them and reading back is exact.

Defined results: a null text is empty, a null role is the role ''. Rows of one
turn (or of null turns, which come first) are ordered by role, then text.
Repeated rows are repeated turns. Rows with a null conversation id form one
conversation with a null id. A turn that the machine doesn't allow is emitted
all the same and flagged, and makes its conversation ``valid`` = false.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for

SEGMENTS = "conv_id long, seq long, turn_no long, role string, kind string, segment string, loss boolean, allowed boolean"


@dataclass(frozen=True)
class Template:
    """``begin``, the role, ``after_role``, the text, ``end``; moves: the roles that may follow each role."""

    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    between: str = "\n"
    learned: frozenset[str] = frozenset({"assistant"})
    moves: dict[str, frozenset[str]] = field(default_factory=lambda: {
        "": frozenset({"system", "user"}),  # the start
        "system": frozenset({"user"}),
        "user": frozenset({"assistant"}),
        "assistant": frozenset({"user"}),
    })
    last: frozenset[str] = frozenset({"assistant"})


class Segment(NamedTuple):
    kind: str  # open, text, close
    text: str
    loss: bool


def escape(text: str, role: bool = False) -> str:
    out = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return out.replace("\n", "\\n") if role else out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


class Machine:
    """Validates the order of roles and turns each turn into segments."""

    def __init__(self, template: Template):
        self.template, self.state = template, ""

    def turn(self, role: str, text: str) -> tuple[bool, list[Segment]]:
        t = self.template
        allowed = role in t.moves.get(self.state, frozenset()) and role != ""
        self.state = role
        return allowed, [
            Segment("open", t.begin + escape(role, True) + t.after_role, False),
            Segment("text", escape(text), role in t.learned),
            Segment("close", t.end + t.between, False),
        ]

    def may_end(self) -> bool:
        return self.state in self.template.last


class Reader:
    """Reads formatted text back, cut into pieces anywhere, into roles, texts and what is under the loss mask.

    Where turns begin and end is parsed from the template's marks, not taken from
    the pieces. At most a mark, a role and one escape are held back.
    """

    def __init__(self, template: Template):
        self.template, self.role = template, None
        self.turns = self.chars = self.loss_chars = 0
        self.seen, self.loss = hashlib.sha256(), hashlib.sha256()
        self.held, self.flags = "", []  # what is not parsed yet, and its runs of [characters, under the loss mask]

    def feed(self, piece: str, loss: bool) -> None:
        self.chars += len(piece)
        self.held += piece
        self.flags.append([len(piece), loss])
        while self._step():
            pass

    def finish(self) -> None:
        if self.role is not None or self.held:
            raise ValueError("the text ends within a turn")

    def _step(self) -> bool:
        t = self.template
        if self.role is None:
            if not self.held.startswith(t.begin[: len(self.held)]):
                raise ValueError("a turn does not open as the template says")
            stop = self.held.find(t.after_role, len(t.begin))
            if not self.held or stop < 0:
                return False
            self.role = unescape(self.held[len(t.begin) : stop])
            self._taken(stop + len(t.after_role))
            self.seen.update(f"{self.role}\n".encode("utf-8", "replace"))
            self.turns += 1
            return True
        mark = t.end + t.between
        stop = self.held.find(mark)
        if stop >= 0:
            self._text(stop)
            self._taken(len(mark))
            self.seen.update(b"\n")
            self.role = None
            return True
        safe = len(self.held) - len(mark) + 1
        while safe > 0 and (len(self.held[:safe]) - len(self.held[:safe].rstrip("\\"))) % 2:
            safe -= 1  # an escape stays whole
        if safe > 0:
            self._text(safe)
        return False

    def _text(self, n: int) -> None:
        for part, loss in self._taken(n, escapes=True):
            text = unescape(part)
            data = text.encode("utf-8", "replace")
            self.seen.update(data)
            if loss:
                self.loss_chars += len(text)
                self.loss.update(data)

    def _taken(self, n: int, escapes: bool = False) -> list[tuple[str, bool]]:
        """Takes n characters off, by runs of the loss mask; a run doesn't part an escape."""
        out, at = [], 0
        while at < n:
            size, loss = self.flags[0]
            take = min(size, n - at)
            if out and escapes and (out[-1][1] == loss or (len(out[-1][0]) - len(out[-1][0].rstrip("\\"))) % 2):
                out[-1] = (out[-1][0] + self.held[at : at + take], out[-1][1])
            else:
                out.append((self.held[at : at + take], loss))
            at += take
            if take == size:
                self.flags.pop(0)
            else:
                self.flags[0][0] -= take
        self.held = self.held[n:]
        return out


def format_turns(turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The segments of all conversations, in order within each partition; a conversation lies in one partition.

    One shuffle by conversation. ``seq`` numbers a conversation's segments; their
    texts end to end are its formatted text, and ``loss`` marks what is learned.
    """
    template = template or Template()
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.repartition(partitions_for(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, now, seq, number = Machine(template), object(), 0, 0
        for batch in batches:
            out: list[tuple] = []
            for c, r, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if c != now:
                    machine, now, seq, number = Machine(template), c, 0, 0
                allowed, segments = machine.turn(r, x)
                for s in segments:
                    out.append((c, seq, number, r, s.kind, s.text, s.loss, allowed))
                    seq += 1
                number += 1
            yield batch_of(out, SEGMENTS)

    return dealt.mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, from the segments as ``format_turns`` leaves them.

    Only the segments' strings and loss flags are read, as one text with a mask;
    turns, roles and texts come from parsing and unescaping it.
    """
    template = template or Template()
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now, fine, machine = None, object(), True, Machine(template)

        def row() -> tuple:
            reader.finish()
            return now, reader.turns, reader.seen.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars, fine and machine.may_end()

        for batch in batches:
            out: list[tuple] = []
            for c, piece, loss in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if c != now or reader is None:
                    if reader is not None:
                        out.append(row())
                    reader, now, fine, machine = Reader(template), c, True, Machine(template)
                opened = reader.turns
                reader.feed(piece, loss)
                if reader.turns > opened:
                    fine &= machine.turn(reader.role, "")[0]
            yield batch_of(out, schema)
        if reader is not None:
            yield batch_of([row()], schema)

    return segments.select("conv_id", "segment", "loss").mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))

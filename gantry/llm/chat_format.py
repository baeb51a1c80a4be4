"""Chat formatting: a role machine, a declarative template, segments with loss flags.

A template gives the markup before and after a text by role, which roles carry loss, and
the transitions of the role machine.  Rows are dealt by conversation and sorted by turn; each task
then streams through its conversations, so no conversation is held in memory.  Out come
segments in order: markup and texts, each with its loss flag.

Inside texts (and unknown role names) the escape character and every character that
can start a control string are written as escape sequences, so an escaped text contains no control
string, whatever the text was, and ``read_back`` restores it exactly.

Defined cases: a null text or role counts as empty; a role the template does not know is
formatted with its name and carries no loss.  A null ``conv_id`` is a conversation of its
own.  Turn order that the machine does not accept is formatted all the same and marked
``valid = false``.  Equal turn numbers are ordered by role, then text.  A null turn comes
first.  An empty table gives no segments.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import partitions_for

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """``turns``: role -> (before, after); ``other`` frames the role names not listed."""

    start: str = "<s>"
    turns: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>"),
            "user": ("[INST] ", " [/INST]"),
            "assistant": ("<s_a>", "</s>"),
        }
    )
    other: tuple[str, str, str] = ("[ROLE ", "[:]", "[/ROLE]")
    loss: frozenset[str] = frozenset({"assistant"})
    moves: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )
    final: frozenset[str] = frozenset({"assistant", "user"})

    def controls(self) -> list[str]:
        return [self.start, *(c.strip(" ") for two in self.turns.values() for c in two), *self.other]

    @cached_property
    def codes(self) -> dict[str, str]:
        """Escape sequences: by character that is to be escaped."""
        first = sorted({c[0] for c in self.controls()})
        return {ESCAPE: ESCAPE + ESCAPE} | {c: ESCAPE + chr(ord("a") + k) for k, c in enumerate(first)}

    def escape(self, text: str) -> str:
        for character, code in self.codes.items():  # the escape character is the first
            text = text.replace(character, code)
        return text

    def unescape(self, text: str) -> str:
        if ESCAPE not in text:
            return text
        back = {code: character for character, code in self.codes.items()}
        return re.sub(r"\\.", lambda m: back[m[0]], text, flags=re.S)

    def framing(self, role: str) -> tuple[str, str]:
        if role in self.turns:
            return self.turns[role]
        name, colon, after = self.other
        return name + self.escape(role) + colon, after


class RoleMachine:
    """Accepts or refuses a sequence of roles, one at a time."""

    def __init__(self, template: Template) -> None:
        self.template, self.state, self.valid = template, "", True

    def step(self, role: str) -> None:
        self.valid = self.valid and role in self.template.moves.get(self.state, ())
        self.state = role

    def accepts(self) -> bool:
        return self.valid and self.state in self.template.final


class Reader:
    """Parses formatted text that arrives in chunks; holds one unfinished turn at most."""

    def __init__(self, template: Template) -> None:
        self.template, self.rest, self.begun = template, "", False

    def feed(self, chunk: str) -> Iterator[tuple[str, str]]:
        self.rest += chunk
        if not self.begun:
            if not self.rest.startswith(self.template.start):
                return
            self.rest, self.begun = self.rest[len(self.template.start) :], True
        while (turn := self._turn()) is not None:
            yield turn

    def _turn(self) -> tuple[str, str] | None:
        name, colon, close = self.template.other
        for role, (before, after) in self.template.turns.items():
            if self.rest.startswith(before):
                break
        else:
            if not self.rest.startswith(name) or (at := self.rest.find(colon)) < 0:
                return None
            role, before, after = self.template.unescape(self.rest[len(name) : at]), self.rest[: at + len(colon)], close
        # No text holds the first character of a control string; an ``after`` may begin with blanks.
        at = self.rest.find(after.strip(" "), len(before))
        if at < 0:
            return None
        lead = len(after) - len(after.lstrip(" "))
        text = self.rest[len(before) : at - lead]
        self.rest = self.rest[at - lead + len(after) :]
        return role, self.template.unescape(text)


def _conversations(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[bool, tuple]]:
    """Rows with a mark on the first of each conversation."""
    before, first = None, True
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            yield first or row[0] != before, row
            before, first = row[0], False


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or weight >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


SEGMENTS = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("turn", pa.int64()), ("segment", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])


def segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id, seg, turn, segment, loss, valid``: segments in order within each conversation.

    ``turn`` is the turn's number from 0 on, -1 for the opening markup; ``valid`` is given on a closing, empty segment.
    """
    template = template or Template()

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        machine, now, seg, turn = None, None, 0, 0
        for first, (conv_id, role, text) in _conversations(batches, ["conv_id", "role", "text"]):
            if first:
                if machine is not None:
                    yield now, seg, turn, "", False, machine.accepts()
                machine, now, seg, turn = RoleMachine(template), conv_id, 1, 0
                yield now, 0, -1, template.start, False, None
            role = role or ""
            machine.step(role)
            before, after = template.framing(role)
            yield now, seg, turn, before, False, None
            yield now, seg + 1, turn, template.escape(text or ""), role in template.loss, None
            yield now, seg + 2, turn, after, False, None
            seg, turn = seg + 3, turn + 1
        if machine is not None:
            yield now, seg, turn, "", False, machine.accepts()

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return (
        rows.repartition(partitions_for(conversations), "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(lambda batches: _batches(formatted(batches), SEGMENTS), "conv_id long, seg long, turn long, segment string, loss boolean, valid boolean")
    )


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Parse what ``segments`` made, as it streams by, and digest turns and loss text.

    The segments may come in any order, as from a table; one that is missing or there twice is an error.
    """
    template = template or Template()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        reader, due, closed = None, 0, True
        for first, (conv_id, seg, segment, loss, valid) in _conversations(batches, ["conv_id", "seg", "segment", "loss", "valid"]):
            if first:
                due = 0
            if seg != due or first and not closed:
                raise ValueError(f"conversation {conv_id}: segment {seg} where {due} is due, or the one before is not closed")
            due, closed = due + 1, valid is not None
            if first:
                reader, turns, n_turns = Reader(template), hashlib.sha256(), 0
                under, loss_chars, chars = hashlib.sha256(), 0, 0
            chars += len(segment)
            if loss:
                text = template.unescape(segment)
                loss_chars += len(text)
                under.update(text.encode())
            for role, text in reader.feed(segment):
                n_turns += 1
                turns.update(f"{role}\n{text}\n".encode())
            if valid is not None:  # the closing segment
                yield conv_id, n_turns, turns.hexdigest(), loss_chars, under.hexdigest(), chars, valid
        if not closed:
            raise ValueError(f"conversation {conv_id} is not closed")

    rows = formatted.select("conv_id", "seg", "segment", "loss", "valid")
    return rows.repartition(partitions_for(formatted), "conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(
        lambda batches: _batches(digests(batches), DIGESTS),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean",
    )


def oracle_sql(template: Template | None = None) -> str:
    """The digests of ``conversations`` and of one with control strings inside its texts, by SQL; for roles and texts that aren't null."""
    t = template or Template()
    name, colon, close = t.other
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda roles: "(" + ", ".join(map(quoted, sorted(roles))) + ")"
    escaped = "[^" + "".join("\\" + c for c in t.codes) + "]"
    size = lambda x: f"length({x}) + length(regexp_replace({x}, {quoted(escaped)}, '', 'g'))"
    framing = " ".join(f"WHEN role = {quoted(r)} THEN {len(before) + len(after)}" for r, (before, after) in t.turns.items())
    allowed = " OR ".join(f"(before {'IS NULL' if r == '' else '= ' + quoted(r)} AND role IN {listed(after)})" for r, after in t.moves.items())
    return f"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w IS NULL AS is_last,
         {size("text")} + CASE {framing} ELSE {len(name) + len(colon) + len(close)} + {size("role")} END AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role IN {listed(t.loss)}), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role IN {listed(t.loss)}), '')) AS loss_sha256,
       (sum(chars) + {len(t.start)})::BIGINT AS formatted_chars,
       bool_and(({allowed}) AND (NOT is_last OR role IN {listed(t.final)})) AS valid
FROM o GROUP BY conv_id
"""

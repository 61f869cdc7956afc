"""Chat formatting that a parser can undo.

Template: ``<|im_start|>role`` newline ``text<|im_end|>`` newline for each turn. A turn is
rendered, read again by the parser of the template's grammar, and compared with its source; where
they differ, the conflicting content is escaped and the turn is rendered again. The escape puts a
backslash into ``<|`` (and one more into a ``<`` followed by backslashes and a bar), so that it
can be undone without loss whatever the text holds. In a role, line ends and
backslashes are escaped as well.

Turns are rendered before the shuffle, each for itself. A conversation is then one run of sorted
rows that streams through a task turn by turn: nothing holds a conversation as a whole, so one
with a third of all rows needs no more memory than others.

Defined results: a null text or role is empty; turns are ordered by (turn, role, text), nulls
first, so ties and repeated rows have one order and repeated rows are turns of their own; rows
with a null conv_id form one conversation; empty turns count; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.text import with_fields
from skygauge.session import ship_package

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<\|[A-Za-z_]+\|>")
ESCAPABLE = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")
LEARNED_ROLE = "assistant"
TURNS = "conv_id long, position long, formatted string, start long, loss_start long, loss_end long"


class NotInGrammar(ValueError):
    """The text is not a sequence of rendered turns."""


def escape(text: str) -> str:
    return ESCAPABLE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the text as it is written."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise NotInGrammar(at)
        head = at + len(START)
        line = formatted.find("\n", head)
        if line < 0 or CONTROL.search(formatted, head, line):
            raise NotInGrammar(at)
        mark = CONTROL.search(formatted, line + 1)
        if mark is None or mark[0] != END or not formatted.startswith("\n", mark.end()):
            raise NotInGrammar(at)
        turns.append((unescape_role(formatted[head:line]), unescape(formatted[line + 1 : mark.start()]), line + 1, mark.start()))
        at = mark.end() + 1
    return turns


def render(role: str, text: str) -> str:
    """A turn that the parser reads back as it was; escaped only if it must be."""
    forms = ((role, text), (role, escape(text)), (escape_role(role), escape(text)))
    for shown_role, shown_text in forms:
        formatted = f"{START}{shown_role}\n{shown_text}{END}\n"
        try:
            turns = parse(formatted)
        except NotInGrammar:
            continue
        if [t[:2] for t in turns] == [(role, text)]:
            return formatted
    raise NotInGrammar(formatted)


def _render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)
        formatted = pa.array([render(role or "", text or "") for role, text in rows], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, formatted], names=[*batch.schema.names, "formatted"])


def _place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Offsets of sorted turns within their conversation, and the learned part of each."""
    last, position, start = (), 0, 0
    for batch in batches:
        rows = []
        for conv_id, formatted in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
            if (conv_id,) != last:
                last, position, start = (conv_id,), 0, 0
            ((role, _, begin, end),) = parse(formatted)
            learned = role == LEARNED_ROLE
            rows.append((conv_id, position, formatted, start, start + begin if learned else None, start + end if learned else None))
            position, start = position + 1, start + len(formatted)
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = ["conv_id", "position", "formatted", "start", "loss_start", "loss_end"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def format_turns(turns: DataFrame) -> DataFrame:
    """Rendered turns in order: conv_id, position, formatted, start, loss_start, loss_end.

    The conversation's text is its ``formatted`` in order of ``position``; ``start`` and the bounds
    of the loss mask count code points from its beginning (null if nothing is learned).
    """
    ship_package(turns.sparkSession)
    rows = turns.select("conv_id", "turn", "role", "text")
    rendered = rows.mapInArrow(_render_batches, with_fields(rows.schema, {"formatted": "string"}))
    order = [F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    return (
        rendered.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", *order)
        .select("conv_id", "formatted")
        .mapInArrow(_place_batches, TURNS)
    )


class _Reading:
    """What is read back from one conversation, turn by turn."""

    def __init__(self):
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, loss_start: int | None, loss_end: int | None) -> None:
        for role, text, _, _ in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if loss_start is not None:
            learned = unescape(formatted[loss_start - start : loss_end - start])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGESTS = {
    "conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
    "loss_sha256": pa.string(), "formatted_chars": pa.int64(),
}


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), DIGESTS.values(), strict=True)], names=list(DIGESTS)
        )

    last, reading = None, None
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if row["position"] == 0:
                if reading:
                    rows.append(reading.row(last))
                last, reading = row["conv_id"], _Reading()
            reading.add(row["formatted"], row["start"], row["loss_start"], row["loss_end"])
        if rows:
            yield made(rows)
    if reading:
        yield made([reading.row(last)])


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted turns say, read back by the parser; rows as ``format_turns`` gives them."""
    return formatted.mapInArrow(
        _digest_batches,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )

"""Chat formatting by a grammar round trip.

Conversations become text in which marks open and close each turn. A rendered turn is parsed again by a deterministic
parser; where what comes back isn't the source, what conflicts is escaped and the turn is rendered and parsed once more,
until both are identical. Turns are delimited by their own marks, so rendered turns in a row parse as the turns in a row:
a conversation of any length is formatted turn by turn, over all tasks, and never held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

#: Marks that open and close the turns of a role. Other roles are named: ROLE, the role, NAMED, the text, END.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, NAMED, END = "[ROLE]", "[/ROLE]", "[/TURN]"
#: The role whose texts are under the loss mask.
LEARNT = "assistant"
ESCAPE = "\\"
#: Every mark starts with a character that no mark has anywhere else, so that marks never overlap. An escaped mark has
#: escapes behind this first character, one more than in the text.
MARK = r"<{0}/?s>|\[{0}(?:/?SYS|/?INST|/?ROLE|/TURN)\]"
CONTROL, ESCAPED, LIKE = (re.compile(f"(?:{MARK.format(n)})") for n in ("", r"\\+", r"\\*"))
CLOSING = {opening: (role, closing) for role, (opening, closing) in MARKS.items()}


def escaped(text: str) -> str:
    return LIKE.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text) if ESCAPE in text else text


class Conflict(ValueError):
    """Not a sentence of the grammar."""


@dataclass
class Turn:
    role: str
    text: str
    #: Where the text as rendered starts and ends.
    start: int
    end: int


def parse(rendered: str) -> list[Turn]:
    """The turns of a formatted conversation: turn := opening text closing | ROLE text NAMED text END, one after another."""
    marks = [(m.start(), m.end(), m[0]) for m in CONTROL.finditer(rendered)]
    turns, at, k = [], 0, 0

    def until(wanted: str) -> tuple[int, int]:
        nonlocal at, k
        if k == len(marks) or marks[k][2] != wanted:
            raise Conflict(f"{wanted} expected")
        start, end, at = at, marks[k][0], marks[k][1]
        k += 1
        return start, end

    while k < len(marks):
        opening = marks[k][2]
        if until(opening) != (marks[k - 1][0],) * 2:
            raise Conflict("text between turns")
        if opening in CLOSING:
            role, closing = CLOSING[opening]
        elif opening == ROLE:
            start, end = until(NAMED)
            role, closing = unescaped(rendered[start:end]), END
        else:
            raise Conflict(f"{opening} opens nothing")
        start, end = until(closing)
        turns.append(Turn(role, unescaped(rendered[start:end]), start, end))
    if at != len(rendered):
        raise Conflict("text between turns")
    return turns


def render(role: str, text: str) -> tuple[str, Turn]:
    """A turn as text, and the same turn as the parser reads it back: identical to the source."""
    for name, body in ((role, text), (escaped(role), escaped(text))):  # what is escaped is always read back
        opening, closing = MARKS[role] if role in MARKS else (ROLE + name + NAMED, END)
        whole = opening + body + closing
        try:
            back = parse(whole)
        except Conflict:
            continue
        if len(back) == 1 and (back[0].role, back[0].text) == (role, text):
            return whole, back[0]
    raise Conflict(f"a turn of {role!r} can't be read back")


@dataclass
class Reader:
    """Reads a formatted conversation back, piece by piece: counts and digests, in a bounded space."""

    n_turns: int = 0
    loss_chars: int = 0
    formatted_chars: int = 0
    turns: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    loss: "hashlib._Hash" = field(default_factory=hashlib.sha256)

    def feed(self, piece: str, loss_start: int | None, loss_end: int | None) -> None:
        self.formatted_chars += len(piece)
        for t in parse(piece):
            self.n_turns += 1
            self.turns.update(f"{t.role}\n{t.text}\n".encode())
        if loss_start is not None:
            learnt = unescaped(piece[loss_start:loss_end])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode())

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def _filled(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per row of ``turns``: conversation, ``turn``, ``role``, ``formatted``, and its loss mask ``loss_start`` to ``loss_end``.

    ``formatted`` in the order of (turn, role, formatted), joined with nothing between, is the conversation; the mask
    (code points, end exclusive) covers the text of an assistant and nothing else, and is null for others. Null texts
    and roles are empty; turns that repeat or tie stay, in the order above; a null conversation id is a conversation
    of its own, and null turns come first; an empty table gives no rows; other columns are ignored, whatever their
    names. Texts are whole, however long. There is no shuffle, so a conversation may hold any share of the rows.
    """
    names = dict(zip(("c", "t"), (conv_col, turn_col), strict=True))
    kinds = {k: turns.schema[c].dataType.simpleString() for k, c in names.items()}

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render(r, x) for r, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            mask = [(t.start, t.end) if t.role == LEARNT else (None, None) for _, t in made]
            columns = [pa.array([s for s, _ in made], pa.string()), *(pa.array([m[i] for m in mask], pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["c", "t", "role", "formatted", "loss_start", "loss_end"])

    rows = spread(turns).select(*(F.col(f"`{c}`").alias(k) for k, c in names.items()), _filled(role_col).alias("r"), _filled(text_col).alias("x"))
    out = rows.mapInArrow(rendered, f"c {kinds['c']}, t {kinds['t']}, role string, formatted string, loss_start bigint, loss_end bigint")
    return out.withColumnsRenamed({"c": conv_col, "t": "turn"})


def read_back(pieces: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation of ``format_chat``'s output, parsed again: counts and digests of its turns and of what the mask covers.

    A digest needs a conversation's pieces in order. They are sorted and streamed past one reader of constant size: no
    conversation is gathered, though one task reads all of a conversation.
    """
    kind = pieces.schema[conv_col].dataType
    schema = f"c {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now = None, None
        for batch in batches:
            done = []
            for conv, *piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader is None or conv != now:
                    if reader is not None:
                        done.append((now, *reader.row()))
                    reader, now = Reader(), conv
                reader.feed(*piece)
            if done:
                yield batch_of(done, batch.schema[0].type)
            held = batch.schema[0].type
        if reader is not None:
            yield batch_of([(now, *reader.row())], held)

    def batch_of(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
        kinds = (conv, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    conv = F.col(f"`{conv_col}`")
    ordered = pieces.repartition(conv).sortWithinPartitions(conv, "turn", "role", "formatted")
    return ordered.select(conv.alias("c"), "formatted", "loss_start", "loss_end").mapInArrow(read, schema).withColumnRenamed("c", conv_col)

"""Chat formatting by a finite-state machine and a declarative template.

The template names the marks of turns; texts are escaped so that no control
string is left in them, and reading a formatted conversation back gives the
turns again. Conversations are formatted in a stream of rows in order, so memory
follows one turn, however long its conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """Marks before and after a conversation and a turn; whose texts carry loss; which role may follow which.

    Every control string begins with a character that it has nowhere else, so
    two of them never overlap.
    """

    begin: str = "<s>"
    end: str = "<eos>\n"
    turns: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[:]", "[/ROLE]")
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: frozenset[str] = frozenset({"assistant"})

    def controls(self) -> list[str]:
        marks = [self.begin, self.end, *(m for pair in self.turns.values() for m in pair), *self.other]
        out = sorted({m.strip() for m in marks}, key=len, reverse=True)
        if any(c[0] in c[1:] or "\\" in c for c in out):
            raise ValueError("a control string must have its first character only once, and no backslash")
        return out


class Formatter:
    """Escapes, marks and reads turns of one template."""

    def __init__(self, template: Template):
        self.template = template
        self._control = re.compile("|".join(map(re.escape, template.controls())))
        self._opens = sorted([(o, c, r) for r, (o, c) in template.turns.items()] + [(template.other[0], template.other[2], None)], key=lambda x: -len(x[0]))

    def escape(self, text: str) -> str:
        """Backslashes doubled, and one put after the first character of each control string."""
        return self._control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Marks and text of a turn, each with its loss flag."""
        body = (self.escape(text), role in self.template.loss)
        if role in self.template.turns:
            opened, closed = self.template.turns[role]
            return [(opened, False), body, (closed, False)]
        opened, named, closed = self.template.other
        return [(opened + self.escape(role) + named, False), body, (closed, False)]

    def read_turn(self, formatted: str, at: int) -> tuple[str, str, int, int, int] | None:
        """Role, text, and the places of its body and end of the turn that begins there; None if it isn't all there yet."""
        for opened, closed, role in self._opens:
            if formatted.startswith(opened, at):
                body = at + len(opened)
                if role is None:
                    named = formatted.find(self.template.other[1], body)
                    if named < 0:
                        return None
                    role, body = self.unescape(formatted[body:named]), named + len(self.template.other[1])
                end = formatted.find(closed, body)
                return None if end < 0 else (role, self.unescape(formatted[body:end]), body, end, end + len(closed))
        return None


def read_conversation(formatted: str, template: Template = Template()) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; ValueError if it doesn't follow the template."""
    f = Formatter(template)
    at, out = len(template.begin), []
    if not formatted.startswith(template.begin):
        raise ValueError("no begin mark")
    while not formatted.startswith(template.end, at):
        turn = f.read_turn(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at {at}")
        out.append(turn[:2])
        at = turn[4]
    return out


_SEGMENTS = ["conv_id", "segment", "text", "loss", "valid"]


def chat_segments(conversations: DataFrame, *, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments of formatted conversations in order: conv_id, segment (from 0), text, loss, valid.

    Joined in order, a conversation's segments are its formatted text; loss
    tells whether a segment is trained on. The machine checks the order of
    roles: valid is null but on the last segment, where it tells whether the
    conversation began, went on and ended as the template allows. Conversations
    in a wrong order are formatted all the same.

    Rows come by turn (null first), ties by role and text. Null role and text
    count as empty; rows with a null conv_id are one conversation. Ids and turns
    are integers. Other columns are ignored. The rows of a conversation pass through one task as a stream
    and are never held; partitions are sorted by conversation and segment.
    """
    frame = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    frame = frame.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, t = Formatter(template), template
        nobody = object()
        held, state, number, good = nobody, "", 0, True
        for batch in batches:
            out: list[tuple] = []

            def close() -> None:
                if held is not nobody:
                    out.append((held, number, t.end, False, good and state in t.final))  # noqa: B023

            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is nobody or conv != held:
                    close()
                    held, state, number, good = conv, "", 1, True
                    out.append((conv, 0, t.begin, False, None))
                good = good and role in t.follows.get(state, ())
                state = role
                for piece, loss in f.segments(role, text):
                    out.append((conv, number, piece, loss, None))
                    number += 1
            yield _segments(out)
        if held is not nobody:
            yield _segments([(held, number, t.end, False, good and state in t.final)])

    return frame.mapInArrow(run, "conv_id long, segment long, text string, loss boolean, valid boolean")


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_SEGMENTS)


def read_segments(segments: DataFrame, *, template: Template = Template()) -> DataFrame:
    """Reads what chat_segments gives back from the formatted text: one row per conversation.

    conv_id, n_turns, turns_sha256 (of role, newline, text, newline per turn),
    loss_chars and loss_sha256 (of all text under the loss mask, unescaped and
    joined), formatted_chars, valid. Raises ValueError where the text doesn't
    follow the template or a loss mask doesn't cover whole texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, t = Formatter(template), template
        text, masks, begun = "", [], False
        turns = losses = None
        n = chars = trained = at = 0
        for batch in batches:
            out = []
            for conv, number, piece, loss, valid in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number == 0:
                    text, masks, begun = "", [], False
                    turns, losses, n, chars, trained, at = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                if loss:
                    masks.append((len(text), len(text) + len(piece)))
                text += piece
                chars += len(piece)
                if not begun and text.startswith(t.begin):
                    begun, at = True, len(t.begin)
                while begun and (turn := f.read_turn(text, at)):
                    role, said, body, end, after = turn
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                    if masks and masks[0][0] < after:
                        if masks.pop(0) != (body, end):
                            raise ValueError(f"loss mask of conversation {conv} cuts a text")
                        losses.update(said.encode())
                        trained += len(said)
                    text, at = text[after:], 0
                    masks = [(a - after, b - after) for a, b in masks]
                if valid is not None:
                    if text[at:] != t.end:
                        raise ValueError(f"conversation {conv} doesn't follow the template")
                    out.append((conv, n, turns.hexdigest(), trained, losses.hexdigest(), chars, valid))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")

"""Chat formatting of typed content parts.

A turn's parts (text, image, audio, document) are visited in order. Text is escaped; any
other part becomes a placeholder, and its reference and the number of tokens that the
placeholder expands to are recorded as an attachment. A formatted turn is

    <|turn|>role\\ntext and placeholders<|end|>\\n

In texts and roles the first character of each control string, and ``%``, is written as ``%``
and its code, so that a reader finds the turns and gets the texts back as they were. The loss
mask covers what assistants say.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
_CONTROL = re.compile(r"%|<(?=\||/?s>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"%([0-9A-F]{2})")
_FRAME = re.compile(r"<\|turn\|>([^\n]*)\n((?:(?!<\|end\|>).)*)<\|end\|>\n", re.DOTALL)

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<part:int,kind:string,ref:string,tokens:long>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)


@dataclass(frozen=True)
class Expansion:
    """Tokens of a placeholder: by patches of an image, seconds of audio, document pages."""

    patch: int = 14
    audio_per_second: float = 25.0
    per_page: int = 512


class PartVisitor:
    """Flattens the parts of one turn into a text; attachments hold what was left out."""

    def __init__(self, expansion: Expansion) -> None:
        self.expansion, self.text, self.attachments = expansion, [], []

    def visit(self, place: int, part: dict) -> None:
        kind = part["kind"] or ""
        if kind in ("", "text"):
            self.text.append(escape(part["text"] or ""))
            return
        count = getattr(self, f"{kind}_tokens", lambda _: 0)(part)
        self.text.append(f"<|{escape(kind)}|>")
        self.attachments.append({"part": place, "kind": kind, "ref": part["ref"], "tokens": count})

    def image_tokens(self, part: dict) -> int:
        across = math.ceil((part["width"] or 0) / self.expansion.patch)
        return across * math.ceil((part["height"] or 0) / self.expansion.patch)

    def audio_tokens(self, part: dict) -> int:
        return math.ceil((part["seconds"] or 0) * self.expansion.audio_per_second)

    def document_tokens(self, part: dict) -> int:
        return (part["pages"] or 0) * self.expansion.per_page


def text_part(text: Column) -> Column:
    """A text as the only part of a turn; null is an empty text."""
    fields = [F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text")]
    fields += [F.lit(None).alias(x) for x in ("ref", "width", "height", "seconds", "pages")]
    return F.array(F.struct(*fields)).cast(PARTS)


def format_chats(
    turns: DataFrame,
    parts: Column,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    trained_role: str = "assistant",
    expansion: Expansion = Expansion(),
) -> DataFrame:
    """One row for each row of turns; a conversation's segments by seq are its formatted text.

    conv_id, seq (from 0, by turn; equal turns by role, then text; nulls first), segment,
    start (of the segment in the conversation, in code points), loss_start and loss_end (of
    what is trained on, null for other roles), attachments (part, kind, ref, tokens),
    first_attachment (how many the conversation has before).

    parts: a column of type PARTS. Null parts are left out, a null array is an empty text, a
    part of an unknown kind becomes a placeholder of 0 tokens. A null role is an empty one;
    rows with a null conv_id form one conversation. No rows give none.

    Turns are formatted one by one, and the running sums of a conversation are windows that
    spill: none of it is gathered in memory.
    """

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments, begins, ends, attachments = [], [], [], []
            for role, of_turn in zip(batch["role"].to_pylist(), batch["parts"].to_pylist(), strict=True):
                visitor = PartVisitor(expansion)
                for place, part in enumerate(of_turn or []):
                    if part is not None:
                        visitor.visit(place, part)
                head = TURN + escape(role or "").replace("\n", "%0A") + "\n"
                body = "".join(visitor.text)
                trained = role == trained_role
                segments.append(head + body + END)
                begins.append(len(head) if trained else None)
                ends.append(len(head) + len(body) if trained else None)
                attachments.append(visitor.attachments)
            made = pa.table(
                {
                    "conv_id": batch["conv_id"],
                    "turn": batch["turn"],
                    "role": batch["role"],
                    "segment": pa.array(segments, pa.string()),
                    "from": pa.array(begins, pa.int64()),
                    "to": pa.array(ends, pa.int64()),
                    "attachments": pa.array(attachments, _ATTACHMENTS),
                }
            )
            yield from made.to_batches()

    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        parts.cast(PARTS).alias("parts"),
    )
    kinds = dict(rows.dtypes)
    formed = rows.mapInArrow(
        form,
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, segment string, "
        f"`from` long, `to` long, attachments {ATTACHMENTS}",
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "segment", "attachments")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chars, things = F.length("segment"), F.size("attachments")
    start = F.sum(chars).over(so_far) - chars
    return formed.select(
        "conv_id",
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        "segment",
        start.alias("start"),
        (start + F.col("from")).alias("loss_start"),
        (start + F.col("to")).alias("loss_end"),
        "attachments",
        (F.sum(things).over(so_far) - things).alias("first_attachment"),
    )


_ATTACHMENTS = pa.list_(
    pa.struct([("part", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
)


class _Reader:
    """Reads a conversation's formatted text piece by piece, keeping only a turn not ended."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.rest = ""

    def feed(self, segment: str, start: int, loss: tuple[int, int] | None) -> None:
        if start != self.chars:
            raise ValueError(f"a segment starts at {start}, after {self.chars} characters")
        self.rest += segment
        self.chars += len(segment)
        if loss:
            begin = self.chars - len(self.rest)
            said = unescape(self.rest[loss[0] - begin : loss[1] - begin])
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        at = 0
        while m := _FRAME.match(self.rest, at):
            role, text, at = unescape(m[1]), unescape(m[2]), m.end()
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        self.rest = self.rest[at:]

    def digest(self) -> dict:
        if self.rest:
            raise ValueError("a formatted conversation ends within a turn")
        return {
            "n_turns": self.n_turns,
            "turns_sha256": self.turns.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.chars,
        }


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from the segments that format_chats gives.

    The segments of a conversation pass through one task in order, a batch at a time.
    """
    kind = dict(formatted.dtypes)["conv_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, current = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if reader is None or row["conv_id"] != current:
                    if reader:
                        done.append({"conv_id": current} | reader.digest())
                    reader, current = _Reader(), row["conv_id"]
                loss = None if row["loss_start"] is None else (row["loss_start"], row["loss_end"])
                reader.feed(row["segment"], row["start"], loss)
            yield _digests(done, batch.schema.field("conv_id").type)
            last_type = batch.schema.field("conv_id").type
        if reader:
            yield _digests([{"conv_id": current} | reader.digest()], last_type)

    in_order = (
        formatted.select("conv_id", "seq", "segment", "start", "loss_start", "loss_end")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "seq")
    )
    return in_order.mapInArrow(
        read,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long",
    )


def _digests(rows: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
    schema = pa.schema(
        [
            ("conv_id", id_type),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
        ]
    )
    return pa.RecordBatch.from_pylist(rows, schema=schema)

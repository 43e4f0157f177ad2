"""Chat formatting: typed content parts, a reversible template, a loss mask, and digests read back from the output.

A message holds parts of type text, image, audio or document. A visitor flattens them in order: text is escaped, and any
other part becomes a numbered placeholder, its reference is recorded as an attachment, and the tokens that it will expand
to are counted. A turn is written as

    ### {role}: {text}</turn>\\n

with `\\`, `#`, `<` and, in a role, `:` escaped by a backslash. No unescaped `#` or `<` of a text is left, so neither the
turn marks nor the placeholders `<|type:n|>` can be forged, and the text is got back by removing the backslashes.

Formatting is local to a row. A conversation's output is its turns' segments joined, with loss spans in offsets of that
output. The digests come from the output alone: a reader that is given the output in pieces, and the spans, finds the
turns by their marks and takes the spans' text out, wherever the pieces were cut. It holds the text of an open turn and
running hashes, a few bytes a character of the longest turn, whatever the conversation's length.
A conversation's SHA-256 is sequential by definition, so its turns do pass through one task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedra.llm.shared import in_batches

OPEN, CLOSE = "### ", "</turn>\n"
TRAINED = "assistant"
#: Tokens that a part expands to, per unit of its size (image tiles, audio seconds, document pages).
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}

# Possessive, so that no state is kept for the characters that have been read.
_ROLE = re.compile(r"### ((?:[^\\#<:]++|\\.)*+): ", re.S)
_TEXT = re.compile(r"(?:[^\\#<]++|\\.|<\|(?:image|audio|document):\d+\|>)*+", re.S)
_PLACEHOLDER = re.compile(r"\\.|<\|(?:image|audio|document):\d+\|>", re.S)
_PIECE = 1 << 16  # characters that are unescaped at once


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescaped(text: str) -> Iterator[str]:
    """The text without its escapes, in pieces."""
    at = 0
    while at < len(text):
        piece = text[at : at + _PIECE]
        if (len(piece) - len(piece.rstrip("\\"))) % 2:  # the piece would end within an escape
            piece = text[at : at + _PIECE + 1]
        at += len(piece)
        # Backslashes come in pairs or before another escaped character, and pairs are found from the left.
        yield "\\".join(part.replace("\\", "") for part in piece.split("\\\\"))


def unescape(text: str) -> str:
    return "".join(unescaped(text))


@dataclass
class Flattener:
    """Visits the parts of one message."""

    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("type")
        if kind == "text":
            self.out.append(escape(part.get("text") or ""))
        elif kind in TOKENS_PER_UNIT:
            self.out.append(f"<|{kind}:{len(self.attachments)}|>")
            self.attachments.append({"type": kind, "ref": part.get("ref"), "tokens": TOKENS_PER_UNIT[kind] * max(1, int(part.get("size") or 1))})
        else:
            raise ValueError(f"no such content part: {kind!r}")


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """The turn's segment, the loss span in its code points (empty at 0 unless the role is trained on), and the attachments. Null role: empty."""
    flat = Flattener()
    for p in parts:
        flat.visit(p)
    head = f"{OPEN}{escape_role(role or '')}: "
    body = "".join(flat.out)
    span = (len(head), len(head) + len(body)) if role == TRAINED else (0, 0)
    return head + body + CLOSE, *span, flat.attachments


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders stay as they are."""
    head = _ROLE.match(segment)
    body = head and _TEXT.match(segment, head.end())
    if not body or segment[body.end() :] != CLOSE:
        raise ValueError(f"not a formatted turn: {segment[:80]!r}")
    return unescape(head[1]), unescape(body[0])


SEGMENTS = "conv_id {kind}, turn long, segment string, loss_start int, loss_end int, attachments string, expanded_tokens long"


def format_turns(df: DataFrame) -> DataFrame:
    """One row for each row of df (conv_id, turn, role, and text or `parts`): the segment, its loss span, its attachments as JSON and the tokens they expand to.

    `parts`, if there, is array<struct<type,text,ref,size>> and wins over text where not null; a null text is an empty
    one. Concatenated by turn, the segments of a conversation are its formatted text. Other columns are not read.
    """
    source = df.select(F.col("conv_id").alias("c"), F.col("turn").cast("long").alias("t"), F.col("role").alias("r"), (F.col("text") if "text" in df.columns else F.lit(None).cast("string")).alias("x"), (F.col("parts") if "parts" in df.columns else F.lit(None).cast("array<struct<type:string,text:string,ref:string,size:int>>")).alias("p"))
    kind = source.schema["c"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seg, lo, hi, att, tok = [], [], [], [], []
            for role, text, parts in zip(b["r"].to_pylist(), b["x"].to_pylist(), b["p"].to_pylist(), strict=True):
                s, start, end, found = format_turn(role, [{"type": "text", "text": text}] if parts is None else parts)
                seg.append(s)
                lo.append(start)
                hi.append(end)
                att.append(json.dumps(found))
                tok.append(sum(a["tokens"] for a in found))
            yield pa.RecordBatch.from_arrays([b["c"], b["t"], pa.array(seg, pa.string()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(att, pa.string()), pa.array(tok, pa.int64())], names=["conv_id", "turn", "segment", "loss_start", "loss_end", "attachments", "expanded_tokens"])

    return in_batches(source, run, SEGMENTS.format(kind=kind))


@dataclass
class Reader:
    """Reads the output of one conversation from pieces of it; piece bounds are of no account. close() tells of an output that ends within a turn."""

    key: object = None
    turns: int = 0
    chars: int = 0  # of the output, read or waiting
    loss_chars: int = 0
    placeholders: int = 0
    all_sha: object = field(default_factory=hashlib.sha256)
    loss_sha: object = field(default_factory=hashlib.sha256)
    waiting: list[str] = field(default_factory=list)  # what follows the last whole turn
    spans: list[tuple[int, int]] = field(default_factory=list)  # of the loss mask, in the output, not yet read

    def feed(self, piece: str, spans: list[tuple[int, int]]) -> None:
        """More of the output, and loss spans (start, end in the whole output) that end in what is known of it by now."""
        self.waiting.append(piece)
        self.chars += len(piece)
        self.spans += spans
        # A turn can only end where a piece, or a piece and the end of what is before it, holds the mark.
        if CLOSE in piece or (len(self.waiting) > 1 and CLOSE in "".join(self.waiting)[-len(piece) - len(CLOSE) :]):
            self._turns()

    def _turns(self) -> None:
        output = self.waiting[0] if len(self.waiting) == 1 else "".join(self.waiting)
        base, at = self.chars - len(output), 0  # the output's offset of what waits, and of what is read in it
        while at < len(output):
            head = _ROLE.match(output, at)
            body = head and _TEXT.match(output, head.end())
            if not body or not output.startswith(CLOSE, body.end()):
                break
            self.turns += 1
            self._add(self.all_sha, head[1])
            self.all_sha.update(b"\n")
            self._add(self.all_sha, output[head.end() : body.end()])
            self.all_sha.update(b"\n")
            self.placeholders += sum(m[0][0] == "<" for m in _PLACEHOLDER.finditer(output, head.end(), body.end()))
            at = body.end() + len(CLOSE)
            while self.spans and self.spans[0][1] <= base + at:
                lo, hi = self.spans.pop(0)
                self.loss_chars += self._add(self.loss_sha, output[lo - base : hi - base])
        self.waiting = [output[at:]] if at < len(output) else []

    @staticmethod
    def _add(sha, escaped: str) -> int:
        n = 0
        for part in unescaped(escaped):
            sha.update(part.encode("utf-8", "surrogatepass"))
            n += len(part)
        return n

    def close(self) -> Reader:
        self._turns()
        if self.waiting:
            raise ValueError(f"not a formatted turn: {self.waiting[0][:80]!r}")
        return self


DIGESTS = "conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"


def digests(segments: DataFrame) -> DataFrame:
    """One row for each conversation of format_turns(), read back from its joined output and the loss spans in it.

    Turns go by number (null first), equal numbers by segment. A null conv_id is a conversation of its own. A table
    without rows gives none. n_attachments counts the output's placeholders. Memory: a batch of rows, the text of one
    turn and two running hashes.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Reader | None = None
        expanded = 0

        def row(d: Reader, tokens: int) -> tuple:
            d.close()
            return d.key, d.turns, d.all_sha.hexdigest(), d.loss_chars, d.loss_sha.hexdigest(), d.chars, d.placeholders, tokens

        def rows(done: list[tuple]) -> pa.RecordBatch:
            kinds = (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            cols = zip(*done, strict=True) if done else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"])

        for b in batches:
            key_type, done = b.schema.field("conv_id").type, []
            for key, segment, lo, hi, tokens in zip(*(b[c] for c in ("conv_id", "segment", "loss_start", "loss_end", "expanded_tokens")), strict=True):
                key, lo, hi = key.as_py(), lo.as_py(), hi.as_py()
                if now is None or now.key != key:
                    if now is not None:
                        done.append(row(now, expanded))
                    now, expanded = Reader(key), 0
                start = now.chars  # where the segment begins in the conversation's output
                now.feed(segment.as_py(), [(start + lo, start + hi)] if hi > lo else [])
                expanded += tokens.as_py()
            yield rows(done)
        if now is not None:
            yield rows([row(now, expanded)])

    dealt = segments.select("conv_id", "turn", "segment", "loss_start", "loss_end", "expanded_tokens").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return in_batches(dealt, run, DIGESTS.format(kind=kind))

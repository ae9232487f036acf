"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens them in order into one string;
attachments become placeholders, and the visitor records their references, places and how many tokens each will expand to. The
turn goes between control strings, and control strings inside texts are escaped so that the output reads back exactly.

Escaping: a backslash is doubled, and a control string gets a backslash after its first character. Thus no text holds a control
string, and dropping one backslash before any character restores it.

Turns are flattened where they are read; only then are they shuffled by conversation and joined in order, as a stream. A conversation
longer than `SEGMENT_CHARS` comes in several rows, so memory stays bounded however long it is.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pa_schema

#: Control strings of this template and of common others; `<|` starts this template's own.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]")
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
SEGMENT_CHARS = 4_000_000

#: Tokens an attachment expands to: an image one for each square of so many pixels, audio so many a second, a document so many a page.
IMAGE_SQUARE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512

_CONTROL_RE = re.compile("|".join(map(re.escape, CONTROL)))
_TURN_RE = re.compile(r"<\|turn\|>((?:\\.|[^\\\n])*)\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL_RE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@dataclass(frozen=True)
class Text:
    text: str | None

    def accept(self, visitor: Flattener) -> None:
        visitor.visit_text(self)


@dataclass(frozen=True)
class Image:
    ref: str
    width: int = 0
    height: int = 0

    def accept(self, visitor: Flattener) -> None:
        visitor.visit_image(self)


@dataclass(frozen=True)
class Audio:
    ref: str
    seconds: float = 0.0

    def accept(self, visitor: Flattener) -> None:
        visitor.visit_audio(self)


@dataclass(frozen=True)
class Document:
    ref: str
    pages: int = 0

    def accept(self, visitor: Flattener) -> None:
        visitor.visit_document(self)


_PARTS = {"text": (Text, ("text",)), "image": (Image, ("ref", "width", "height")), "audio": (Audio, ("ref", "seconds")), "document": (Document, ("ref", "pages"))}


def read_parts(content: str | None, as_json: bool) -> list[Text | Image | Audio | Document]:
    """Parts of a turn: one text, or what a JSON list of objects with a `type` says. Null is an empty text."""
    if not as_json or content is None:
        return [Text(content)]
    parts = []
    for item in json.loads(content):
        kind, names = _PARTS[item["type"]]
        parts.append(kind(**{n: item[n] for n in names if item.get(n) is not None}) if item["type"] != "text" else Text(item.get("text")))
    return parts


@dataclass
class Flattener:
    """Visits the parts of one turn; placeholders are numbered by their order in it."""

    turn: str
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    chars: int = 0

    def put(self, text: str) -> None:
        self.out.append(text)
        self.chars += len(text)

    def visit_text(self, part: Text) -> None:
        self.put(escape(part.text or ""))

    def attach(self, kind: str, ref: str, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": ref, "at": self.chars, "tokens": tokens})
        self.put(f"<|{kind}:{self.turn}.{len(self.attachments)}|>")

    def visit_image(self, part: Image) -> None:
        self.attach("image", part.ref, math.ceil(part.width / IMAGE_SQUARE) * math.ceil(part.height / IMAGE_SQUARE))

    def visit_audio(self, part: Audio) -> None:
        self.attach("audio", part.ref, math.ceil(part.seconds * AUDIO_RATE))

    def visit_document(self, part: Document) -> None:
        self.attach("document", part.ref, part.pages * PAGE_TOKENS)


def flatten_turn(turn: int | None, role: str | None, content: str | None, as_json: bool = False) -> tuple[str, int, int, list[dict]]:
    """A turn's string, where its body starts and ends in it, and its attachments with places in the string."""
    visitor = Flattener("" if turn is None else str(turn))
    for part in read_parts(content, as_json):
        part.accept(visitor)
    head = OPEN + escape(role or "").replace("\n", "\\\n") + "\n"
    return head + "".join(visitor.out) + CLOSE, len(head), len(head) + visitor.chars, [a | {"at": a["at"] + len(head)} for a in visitor.attachments]


_ATTACHMENT = "struct<kind:string,ref:string,at:bigint,tokens:bigint>"
_LOSS = "array<struct<start:bigint,end:bigint>>"


def format_chats(turns: DataFrame, as_json: bool = False, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, segment, n_turns, formatted, loss and attachments of every conversation.

    turns has conv_id, turn, role and text (with as_json: a JSON list of parts). loss holds spans of the formatted string, in code
    points: the bodies of the turns of loss_roles. Nearly every conversation is one segment; a longer one goes on in
    segment 1 and so on, in the same partition and in order. Turns are ordered by turn (null first), then role, then their formatted strings; equal rows
    all stay. Null role and text are empty; null conv_id is one conversation. Other columns are not read.
    """
    kind = dict(turns.dtypes)["conv_id"]

    def flat(cols: dict) -> dict:
        made = [flatten_turn(t, r, x, as_json) for t, r, x in zip(cols["turn"], cols["role"], cols["text"], strict=True)]
        return {"conv_id": cols["conv_id"], "turn": cols["turn"], "role": cols["role"], "flat": [m[0] for m in made], "start": [m[1] for m in made], "end": [m[2] for m in made], "attachments": [m[3] for m in made]}

    flattened = map_batches(turns.select("conv_id", "turn", "role", "text"), flat, f"conv_id {kind}, turn {dict(turns.dtypes)['turn']}, role string, flat string, start bigint, end bigint, attachments array<{_ATTACHMENT}>")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "flat")]
    schema = f"conv_id {kind}, segment int, n_turns bigint, formatted string, loss {_LOSS}, attachments array<{_ATTACHMENT}>"
    types = pa_schema(turns.sparkSession, schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        loss: list[dict] = []
        attached: list[dict] = []
        at, segment, current, begun = 0, 0, None, False

        def row() -> dict:
            return {"conv_id": current, "segment": segment, "n_turns": len(texts), "formatted": "".join(texts), "loss": list(loss), "attachments": list(attached)}

        for batch in batches:
            done, size = [], 0
            for turn in batch.to_pylist():
                new = not begun or turn["conv_id"] != current
                if texts and (new or at >= SEGMENT_CHARS):
                    done.append(row())
                    size += at
                    texts, loss, attached, at = [], [], [], 0
                    segment += 1
                if new:
                    current, segment, begun = turn["conv_id"], 0, True
                if turn["role"] in loss_roles:
                    loss.append({"start": at + turn["start"], "end": at + turn["end"]})
                attached += [a | {"at": at + a["at"]} for a in turn["attachments"]]
                texts.append(turn["flat"])
                at += len(turn["flat"])
                if size >= SEGMENT_CHARS:
                    yield pa.RecordBatch.from_pylist(done, types)
                    done, size = [], 0
            if done:
                yield pa.RecordBatch.from_pylist(done, types)
        if texts:
            yield pa.RecordBatch.from_pylist([row()], types)

    return flattened.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(join, schema)


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted string; placeholders stay as they are. An error for a string that is not turns from end to end."""
    at = 0
    for match in _TURN_RE.finditer(formatted):
        if match.start() != at:
            break
        at = match.end()
        yield unescape(match[1]), unescape(match[2])
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")

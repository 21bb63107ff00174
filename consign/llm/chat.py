"""Chat formatting with typed content parts (operator 13).

A turn's content is a list of parts of the types text, image, audio and document.
``Flattener`` visits them in order: texts are escaped and joined, every other part
becomes its type's placeholder, and its reference, place and expanded token count are
recorded.  The template's marks stand around a turn; in texts and roles a
backslash goes before every mark, placeholder and backslash, so that ``parse`` gives back
roles and parts exactly.  The loss mask is the spans of the assistant's texts, in code
points, without marks and placeholders.

``format_conversations`` returns pieces: a row holds consecutive turns of one conversation, all
of them unless they exceed about ``PIECE`` characters.  Turns are range-partitioned by
(conversation, turn), so a conversation of any size is spread over tasks, and each task
holds one piece at a time.  A conversation's pieces are in the order of ``piece``.

Defined cases: turns sort by turn (null first), then role, then a hash of the content, so
repeated rows are turns of their own in a fixed order; a null role is the role ''; a null
text, part list or part is empty; neighbouring texts are one text; a part of another
type is an attachment of one token with its own placeholder; a null conversation id is a
conversation; texts of any length are whole; an empty table gives no pieces; columns
beside those named are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package
from .tokens import slices

PIECE = 1 << 20  # characters
PART = "struct<type:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"
ATTACHMENT = pa.struct([("turn", pa.int64()), ("part", pa.int64()), ("kind", pa.string()), ("ref", pa.string()),
                        ("at", pa.int64()), ("tokens", pa.int64())])
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


@dataclass(frozen=True)
class Template:
    """The marks around a turn by role; other roles are spelled out between the marks of ``named``."""

    opens: dict[str, str] = field(default_factory=lambda: {"system": "[SYS]", "user": "[INST]", "assistant": "[ANS]"})
    closes: dict[str, str] = field(default_factory=lambda: {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"})
    named: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    placeholders: dict[str, str] = field(default_factory=lambda: {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"})
    other: str = "[FILE]"
    loss_role: str = "assistant"

    def __post_init__(self) -> None:
        heads = {c[:1] for c in self.controls}
        if any(not c or "\\" in c or heads & set(c[1:]) for c in self.controls):
            raise ValueError("a mark may not be empty, hold a backslash or, after its first character, one that a mark begins with")

    @cached_property
    def controls(self) -> list[str]:
        """As no mark holds another's first character further on, no two of them overlap in a text."""
        return sorted({"<s>", *self.opens.values(), *self.closes.values(), *self.named, *self.placeholders.values(), self.other})

    @cached_property
    def special(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, ["\\", *self.controls])))

    @cached_property
    def tokens(self) -> re.Pattern:
        """An escaped character, a mark, or a run of others."""
        heads = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        return re.compile("|".join([r"\\.", *map(re.escape, self.controls), rf"[^\\{heads}]+", "."]), re.DOTALL)

    def escape(self, text: str) -> str:
        return self.special.sub(r"\\\g<0>", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@dataclass(frozen=True)
class Expansion:
    """How many tokens a model's own encoder makes of an attachment."""

    patch: int = 28          # pixels of an image's side to a token
    image: int = 256         # an image of unknown size
    audio_rate: float = 25   # tokens a second
    page: int = 512          # tokens a page


class Flattener:
    """Visits the parts of one turn after another and writes them as one text."""

    def __init__(self, template: Template, expansion: Expansion) -> None:
        self.template, self.expansion = template, expansion
        self.start()

    def start(self) -> None:
        self.out: list[str] = []
        self.chars = self.turns = 0
        self.spans: list[dict] = []
        self.attachments: list[dict] = []

    def write(self, s: str) -> None:
        self.out.append(s)
        self.chars += len(s)

    def turn(self, role: str | None, parts: list[dict | None] | None) -> None:
        t, role = self.template, role or ""
        if role in t.opens:
            self.write(t.opens[role])
        else:
            self.write(t.named[0] + t.escape(role) + t.named[1])
        run: list[str] = []
        for number, part in enumerate(parts or []):
            if part is None:
                continue
            if part["type"] == "text":
                run.append(part["text"] or "")
                continue
            self.text("".join(run), role == t.loss_role)
            run = []
            visit = getattr(self, f"visit_{part['type']}", None) if part["type"] in t.placeholders else None
            tokens = visit(part) if visit else 1
            self.attachments.append({"turn": self.turns, "part": number, "kind": part["type"], "ref": part["ref"],
                                     "at": self.chars, "tokens": tokens})
            self.write(t.placeholders.get(part["type"], t.other))
        self.text("".join(run), role == t.loss_role)
        self.write(t.closes[role] if role in t.opens else t.named[2])
        self.turns += 1

    def text(self, text: str, loss: bool) -> None:
        if text:
            at = self.chars
            self.write(self.template.escape(text))
            if loss:
                self.spans.append({"start": at, "end": self.chars})

    def visit_image(self, part: dict) -> int:
        side = self.expansion.patch
        if not part["width"] or not part["height"]:
            return self.expansion.image
        return -(-part["width"] // side) * -(-part["height"] // side)

    def visit_audio(self, part: dict) -> int:
        seconds = part["seconds"]
        return math.ceil(seconds * self.expansion.audio_rate) if seconds and math.isfinite(seconds) and seconds > 0 else 1

    def visit_document(self, part: dict) -> int:
        return max(1, part["pages"] or 1) * self.expansion.page


def parse(formatted: str, template: Template) -> list[tuple[str, list[str | tuple[str]]]]:
    """(role, contents) of each turn; a content is a text or, for a placeholder, (its mark,)."""
    t = template
    role_of = {mark: role for role, mark in t.opens.items()}
    places = {*t.placeholders.values(), t.other}
    turns, role, closes, contents, text = [], None, "", [], []

    def end_text() -> None:
        if text:
            contents.append(t.unescape("".join(text)))
            text.clear()

    named = None  # the parts of a spelled-out role
    for token in t.tokens.findall(formatted):
        if named is not None:
            if token == t.named[1]:
                role, closes, named = t.unescape("".join(named)), t.named[2], None
            else:
                named.append(token)
        elif role is None:
            if token == t.named[0]:
                named = []
            else:
                role = role_of[token]
                closes = t.closes[role]
        elif token == closes:
            end_text()
            turns.append((role, contents))
            role, contents = None, []
        elif token in places:
            end_text()
            contents.append((token,))
        else:
            text.append(token)
    if role is not None or named is not None:
        raise ValueError("the text ends inside a turn")
    return turns


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), *[
        F.lit(None).cast(kind).alias(name) for name, kind in
        (("ref", "string"), ("width", "long"), ("height", "long"), ("seconds", "double"), ("pages", "long"))]))


def format_conversations(turns: DataFrame, template: Template | None = None, expansion: Expansion | None = None,
                         content: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role") -> DataFrame:
    """Pieces (conv_id, piece, n_turns, formatted, loss, attachments, expanded_tokens) of every conversation.

    ``content`` is a column of type array<``PART``>; if not given, the column ``text`` is each turn's only part.
    """
    template, expansion = template or Template(), expansion or Expansion()
    ship_package(turns.sparkSession)
    content = (text_parts(F.col("text")) if content is None else content).cast(f"array<{PART}>")
    id_type = turns.schema[id_col].dataType.simpleString()
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), content.alias("parts"))
    order = ["id", "turn", "role", "h"]
    rows = rows.withColumn("h", F.xxhash64("parts")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, number, now, kind = Flattener(template, expansion), TaskContext.get().partitionId() << 32, None, pa.int64()

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], kind), pa.array([number]), pa.array([f.turns]), pa.array(["".join(f.out)]),
                 pa.array([f.spans], pa.list_(SPAN)), pa.array([f.attachments], pa.list_(ATTACHMENT)),
                 pa.array([sum(a["tokens"] for a in f.attachments)], pa.int64())],
                ["conv_id", "piece", "n_turns", "formatted", "loss", "attachments", "expanded_tokens"])

        for b in slices(batches):
            kind = b.schema.field("id").type
            for own, role, parts in zip(*(b.column(c).to_pylist() for c in ("id", "role", "parts"))):
                if f.turns and (own != now or f.chars > PIECE):
                    yield piece()
                    number += 1
                    f.start()
                now = own
                f.turn(role, parts)
        if f.turns:
            yield piece()

    span, attachment = "struct<start:long,end:long>", "struct<turn:long,part:long,kind:string,ref:string,at:long,tokens:long>"
    return rows.select("id", "role", "parts").mapInArrow(
        run, f"conv_id {id_type}, piece long, n_turns long, formatted string, loss array<{span}>, "
             f"attachments array<{attachment}>, expanded_tokens long")


def read_back(pieces: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, from its
    pieces alone: turns from ``formatted``, the trained texts from its spans.

    A digest runs over a conversation's pieces in their order, one piece in memory at a time.
    """
    template = template or Template()
    ship_package(pieces.sparkSession)
    id_type = pieces.schema["conv_id"].dataType.simpleString()
    rows = (pieces.select("conv_id", "piece", "formatted", "loss").repartition("conv_id")
            .sortWithinPartitions("conv_id", "piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, any_yet = pa.int64(), None, False
        n = chars = trained = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], kind), pa.array([n]), pa.array([turns.hexdigest()]), pa.array([trained]),
                 pa.array([loss.hexdigest()]), pa.array([chars])],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in slices(batches, 64):
            kind = b.schema.field("conv_id").type
            for own, formatted, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if any_yet and own != now:
                    yield row()
                    n = chars = trained = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                now, any_yet = own, True
                for role, contents in parse(formatted, template):
                    n += 1
                    text = "".join(c if isinstance(c, str) else c[0] for c in contents)
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    text = template.unescape(formatted[s["start"]:s["end"]])
                    trained += len(text)
                    loss.update(text.encode("utf-8", "surrogatepass"))
                chars += len(formatted)
        if any_yet:
            yield row()

    return rows.mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, "
                                "loss_sha256 string, formatted_chars long")

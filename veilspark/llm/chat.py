"""Chat formatting with typed content parts.

A turn's content is plain text or a JSON array of typed parts, e.g. [{"type": "text", "text": "see"},
{"type": "image", "ref": "a.png", "width": 640, "height": 480}]. A visitor flattens the parts in order: text stays,
an image, audio or document part becomes a placeholder, its reference is recorded with the number of tokens it will
expand to. Each turn is marked by `[INST] ... [/INST]` (user), `</s>` (after an assistant) or `<<SYS>> ... <</SYS>>`,
and control strings inside texts are escaped by a reversible rule: `\\` before a control string or a run of
backslashes that would be read as one.

Formatted output is one row per turn, so a conversation of any length streams; its rows in turn order, joined, are
the formatted conversation. Turns are ordered by turn, then role and text (ties and repeated rows stay, each as a
turn of its own). A null text is empty, a null role is "". Rows with a null conversation id form one conversation. An
empty table gives no rows. Other columns are not read. A part's extent that isn't a sensible number counts as its
default, a part of another type is written as JSON, and content that isn't a list of typed parts is plain text.

All turns of a conversation come to one task, in order, since its digests run through its whole text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template; none is a prefix of another.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role:", "<|attach:", "|>")
_ANY = "|".join(map(re.escape, CONTROLS))
# Runs of backslashes are taken whole, from their first one, so no text takes more than linear time.
_ESCAPE = re.compile(rf"(?<!\\)\\++(?={_ANY}|\Z)|(?:{_ANY})")
_UNESCAPE = re.compile(rf"(?<!\\)(\\++)({_ANY}|\Z)")
_SURROGATE = re.compile("[\ud800-\udfff]")
OPEN = {"user": "[INST] ", "system": "<<SYS>> ", "assistant": "<s> "}
CLOSE = {"user": " [/INST]", "system": " <</SYS>>", "assistant": " </s>"}


def escape(text: str) -> str:
    """A backslash goes before each control string; backslashes just before one, or at the end, are doubled."""
    return _ESCAPE.sub(lambda m: m[0] * 2 if m[0][0] == "\\" else "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], text)


def _extent(value, default: float) -> float:
    """A declared width, length or number of pages; the default where it isn't a number between 0 and a million."""
    try:
        number = float(value)
    except (TypeError, ValueError, OverflowError):
        return default
    return number if 0 < number <= 1e6 else default


class Visitor:
    """Flattens typed parts into text with placeholders. Token counts follow from a part's declared extent."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        handler: Callable = getattr(self, f"visit_{part.get('type')}", self.visit_other)
        handler(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text")
        self.out.append(escape("" if text is None else str(text)))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, ceil(_extent(part.get("width"), 336) / 14) * ceil(_extent(part.get("height"), 336) / 14))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, ceil(_extent(part.get("seconds"), 0) * 25))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, ceil(_extent(part.get("pages"), 1)) * 512)

    def visit_other(self, part: dict) -> None:
        self.out.append(escape(json.dumps(part, ensure_ascii=False, sort_keys=True)))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": str(part.get("ref") or ""), "tokens": tokens})
        self.out.append(f"<|attach:{kind}:{len(self.attachments) - 1}|>")


def flatten(content: str, typed: bool) -> tuple[str, list[dict]]:
    """(escaped text with placeholders, attachments). Only with typed is a JSON array of objects read as parts."""
    if typed and content[:1] == "[":
        v = Visitor()
        try:
            parts = json.loads(content)
            if isinstance(parts, list) and parts and all(isinstance(p, dict) and "type" in p for p in parts):
                for p in parts:
                    v.visit(p)
                return _whole("".join(v.out)), [x | {"ref": _whole(x["ref"])} for x in v.attachments]
        except (ValueError, RecursionError):  # not JSON, or nested beyond any use: plain text
            pass
    return escape(content), []


def _whole(text: str) -> str:
    """Halves of surrogate pairs, which JSON can name but no text can hold, as replacement characters."""
    return text if text.isascii() else _SURROGATE.sub("\ufffd", text)


def segment(role: str, content: str, typed: bool = False) -> tuple[str, int, int, list[dict]]:
    """(formatted turn, start and end of its text, attachments)."""
    text, attachments = flatten(content, typed)
    start = OPEN.get(role, f"<|role:{escape(role)}|> ")
    return start + text + CLOSE.get(role, " </s>"), len(start), len(start) + len(text), attachments


_MARK = re.compile(rf"(?<!\\)(\\*+)({_ANY})")


def _next_mark(text: str, at: int, marks: tuple[str, ...]) -> re.Match:
    """The next of these control strings that is not escaped (an even number of backslashes before it)."""
    for m in _MARK.finditer(text, at):
        if len(m[1]) % 2 == 0 and m[2] in marks:
            return m
    raise ValueError("a turn is not closed")


def parse(formatted: str) -> Iterator[tuple[str, int, int]]:
    """(role, start, end of the escaped text) of each turn of a formatted conversation or of some of its turns."""
    at = 0
    while at < len(formatted):
        if formatted.startswith("<|role:", at):
            m = _next_mark(formatted, at + 7, ("|>",))
            role, start, close = unescape(formatted[at + 7 : m.start(2)]), m.end() + 1, " </s>"
        else:
            role = next((r for r, mark in OPEN.items() if formatted.startswith(mark, at)), None)
            if role is None:
                raise ValueError(f"no turn begins at {at}")
            start, close = at + len(OPEN[role]), CLOSE[role]
        m = _next_mark(formatted, start, (close[1:],))
        end = m.start(2) - 1
        yield role, start, end
        at = m.end()


def format_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", typed: bool = True, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, seq, formatted, text_start, text_end, in_loss, attachments), conversations together and in order.

    One shuffle by conversation with a sort that spills; a turn at a time is formatted.
    """
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), kind]
    names = ["conv_id", "seq", "formatted", "text_start", "text_end", "in_loss", "attachments"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = object()
        seq = 0
        for batch in batches:
            out = []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                seq = seq + 1 if conv == last else 0
                last = conv
                formatted, a, b, attachments = segment(role, text, typed)
                out.append((conv, seq, formatted, a, b, role in loss_roles, attachments))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return rows.mapInArrow(run, "conv_id long, seq long, formatted string, text_start long, text_end long, in_loss boolean, attachments array<struct<kind:string,ref:string,tokens:long>>")


def as_parts(text: str = "text"):
    """A column of plain texts as content of one text part each, for the visitor; null stays null."""
    part = F.struct(F.lit("text").alias("type"), F.col(text).alias("text"))
    return F.when(F.col(text).isNotNull(), F.to_json(F.array(part)))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, attached_tokens),
    parsed from format_turns' output.

    Rows must come as format_turns gives them; the digests of a conversation are built turn by turn.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attached_tokens"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    class Sums:
        def __init__(self, conv):
            self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()
            self.attached, self.tokens = 0, 0

        def add(self, formatted: str, a: int, b: int, in_loss: bool, attached: int, tokens: int) -> None:
            self.chars += len(formatted)
            self.attached += attached
            self.tokens += tokens
            for role, start, end in parse(formatted):
                self.turns += 1
                self.all.update(f"{role}\n{unescape(formatted[start:end])}\n".encode())
            if in_loss:
                text = unescape(formatted[a:b])
                self.loss_chars += len(text)
                self.loss.update(text.encode())

        def row(self) -> tuple:
            return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.attached, self.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            out = []
            for conv, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sums is None or sums.conv != conv:
                    if sums:
                        out.append(sums.row())
                    sums = Sums(conv)
                sums.add(*rest)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(sums.row(), types, strict=True)], names)

    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, x: n + x["tokens"])
    cols = formatted.select("conv_id", "formatted", "text_start", "text_end", "in_loss", F.size("attachments").alias("n"), tokens.alias("tokens"))
    return cols.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attached_tokens long")

"""Redaction of structured documents: parse, detect natively on leaves, number, propagate, rewrite.

One pass over the documents, without a shuffle: a document's leaves stay an array beside it, native detectors run over
that array, and numbering, propagation and rewriting take the document, its leaves and their spans together. So a
document is parsed once, and what one task holds is bounded by one document. Without native detectors the leaves never
leave the Python that parsed them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import detectors as D
from ..functions import spans as S
from ..functions.globs import FileGlobs, FileKeyPaths, any_of, glob, python
from ..functions.literals import byte_offsets
from ..functions.patterns import to_python
from ..functions.tokens import Template
from ..sources import formats
from .detection import Detector, Leaf, resolve

LEAF = "struct<leaf_idx:int,key:string,path:string,value:string,credential_context:boolean,offset:long,end:long,style:string,comment:boolean>"
_LEAF = pa.struct([("leaf_idx", pa.int32()), ("key", pa.string()), ("path", pa.string()), ("value", pa.string()), ("credential_context", pa.bool_()), ("offset", pa.int64()), ("end", pa.int64()), ("style", pa.string()), ("comment", pa.bool_())])
FINDING = "struct<id:int,secret:string,detector:string,field:string,path:string,token:string,len:int,offsets:array<long>,line:int,column:int,occurrences:int,allowed:boolean>"
_FINDING = pa.struct([("id", pa.int32()), ("secret", pa.string()), ("detector", pa.string()), ("field", pa.string()), ("path", pa.string()), ("token", pa.string()), ("len", pa.int32()), ("offsets", pa.list_(pa.int64())), ("line", pa.int32()), ("column", pa.int32()), ("occurrences", pa.int32()), ("allowed", pa.bool_())])


class Allow:
    """Secrets that stay in the text: listed ones, those that match a pattern as a whole, or all."""

    def __init__(self, values: Iterable[str] = (), regexes: Iterable[str] = (), everything: bool = False):
        from .detection import _checked

        self.values, self.regexes, self.everything = frozenset(values), tuple(_checked(regexes)), everything

    @classmethod
    def none(cls) -> Allow:
        return cls()

    @classmethod
    def all(cls) -> Allow:
        return cls(everything=True)

    def with_values(self, values: Iterable[str]) -> Allow:
        return Allow({*self.values, *values}, self.regexes, self.everything)

    def with_regexes(self, regexes: Iterable[str]) -> Allow:
        return Allow(self.values, (*self.regexes, *regexes), self.everything)

    def tester(self) -> Callable[[str], bool]:
        import regex

        whole = regex.compile("|".join(f"(?s:{to_python(p)})" for p in self.regexes), regex.V1) if self.regexes else None
        return lambda secret: self.everything or secret in self.values or bool(whole and whole.fullmatch(secret))


@dataclass(frozen=True)
class Options:
    """How documents are read and which leaves are looked at."""

    template: Template = field(default_factory=Template.parse)
    comments: bool = False
    policy: formats.Policy = field(default_factory=formats.Policy)
    format: str | None = None
    formats: tuple[str, ...] | None = None  # those to choose from; None for all
    allow_paths: tuple[str, ...] = ()
    file_paths: FileKeyPaths = field(default_factory=FileKeyPaths)
    files: FileGlobs = field(default_factory=FileGlobs)
    within: tuple[str, ...] = ()
    allow: Allow = field(default_factory=Allow)


def _column_value(leaf: formats.Leaf) -> str:
    """A leaf's value for a column; a byte that isn't UTF-8 becomes one `?`, so byte offsets stay."""
    return leaf.value if leaf.value.isascii() else re.sub("[\ud800-\udfff]", "?", leaf.value)


def parsed(docs: DataFrame, options: Options | None = None) -> DataFrame:
    """(doc_id, path, content, format, warning, leaves) of (doc_id, path, content) documents.

    Leaves are those that the policy lets through and no allowed key path spares; their index counts all of them.
    """
    options = options or Options()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(options)
        for part in _parts(batches):
            names, every, warnings = [], [], []
            for path, data in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                name, rows, warning = reader.leaves(data or b"", path)
                names.append(name)
                warnings.append(warning)
                every.append(rows)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(warnings, pa.string()), _lists(every, _LEAF)], ["doc_id", "path", "content", "format", "warning", "leaves"])

    return _base(docs).mapInArrow(run, f"doc_id string, path string, content binary, format string, warning string, leaves array<{LEAF}>")


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content"))


class _Reader:
    """Leaves of one document after the other."""

    def __init__(self, options: Options):
        self.options, spared = options, any_of(map(glob, options.allow_paths))
        self.spared_in = lru_cache(maxsize=1024)(lambda path: [python(x) for x in ([spared] if spared else []) + [glob(g) for g in options.file_paths.for_file(path)]])

    def leaves(self, data: bytes, path: str | None) -> tuple[str, list[tuple], str | None]:
        """(format, rows of LEAF, warning)."""
        options, here = self.options, self.spared_in(path)
        name, found, warning = formats.parse(data, path, options.format, options.comments, options.formats)
        judged, rows = formats.Judged(options.policy), []
        for i, x in enumerate(found):
            if not judged.lets_through(x) or (here and any(_path_spared(x.path, p) for p in here)):
                continue
            rows.append((i, x.key, x.path, _column_value(x), judged.credential_context(x), x.start, x.end, x.style, x.comment))
        return name, rows, warning


def _lists(every: list[list[tuple]], kind: pa.StructType) -> pa.ListArray:
    """Lists of rows as an array, made column by column."""
    flat = list(chain.from_iterable(every))
    columns = zip(*flat, strict=True) if flat else [()] * kind.num_fields
    items = pa.StructArray.from_arrays([pa.array(c, kind.field(i).type) for i, c in enumerate(columns)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, every))], pa.int32()), items)


def _rows(lists: pa.ListArray) -> list[list]:
    """Lists (of lists) of structs without nulls as tuples, read column by column."""
    inner = lists.flatten()
    items = _rows(inner) if pa.types.is_list(inner.type) else list(zip(*map(_plain, inner.flatten()), strict=True))
    ends = list(accumulate(_plain(pc.list_value_length(lists)), initial=0))
    return [items[a:b] for a, b in pairwise(ends)]


def _plain(column: pa.Array) -> list:
    """to_pylist, faster for whole numbers."""
    return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_integer(column.type) and not column.null_count else column.to_pylist()


def _parts(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches with contents (the third column) of at most limit bytes, or of one document."""
    for batch in batches:
        start = size = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()):
            if size + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def _path_spared(path: str, pattern: re.Pattern) -> bool:
    """Whether the path, or that of something it lies in, is spared."""
    parts = path.split(".")
    return any(pattern.search(".".join(parts[:n])) for n in range(1, len(parts) + 1))


def leaves(docs: DataFrame, comments: bool = False, scan_all: bool = False, policy: formats.Policy | None = None, allow_paths: Iterable[str] = ()) -> DataFrame:
    """Leaves of (doc_id, path, content) documents as rows; the index counts all of them."""
    policy = formats.ScanAll() if scan_all else policy or formats.Policy()
    rows = parsed(docs, Options(comments=comments, policy=policy, allow_paths=tuple(allow_paths)))
    rows = rows.select("doc_id", "format", F.explode("leaves").alias("x"))
    return rows.select("doc_id", "format", "x.leaf_idx", "x.key", "x.path", "x.value", "x.credential_context", "x.offset")


def _native_spans(detectors: list[Detector]):
    """Raw spans of each leaf by the native detectors."""
    of = lambda x: Leaf(x["value"], x["key"], x["path"], x["credential_context"])
    each = lambda x: F.concat(*[d.native(of(x)) for d in detectors]) if detectors else S.none()
    return F.transform("leaves", each)


def merged(found: Iterable[tuple[int, int, str]], zones: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Spans outside the zones, sorted and joined where they overlap or touch; the first label stays."""
    out: list[tuple[int, int, str]] = []
    zones, reach, z = sorted(zones), -1, 0
    for a, b, label in sorted(found, key=lambda s: (s[0], -s[1], s[2])):
        while z < len(zones) and zones[z][0] <= a:
            reach, z = max(reach, zones[z][1]), z + 1
        if b <= a or b <= reach:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2])
        else:
            out.append((a, b, label))
    return out


class _Document:
    """Numbering, propagation and rewriting of one document."""

    def __init__(self, options: Options, detectors: list[Detector]):
        import regex

        self.options, self.python, self.whole = options, [d for d in detectors if d.python], [d for d in detectors if d.document]
        self.within = [regex.compile(to_python(p), regex.V1) for p in options.within]
        self.tester = options.allow.tester()
        self.listed = lru_cache(maxsize=1024)(options.files.matches)

    def finish(self, path: str | None, data: bytes, name: str, rows: list[tuple], native: list[list[tuple[int, int, str]]] | None = None) -> tuple[bytes, list[dict]]:
        """(rendered document, findings in order). Rows are those of LEAF; native are the spans that are known of each."""
        template = self.options.template
        found = native or [[] for _ in rows]
        if self.python or self.whole:
            infos = [Leaf(value, key, at, context) for _, key, at, value, context, *_ in rows]
            if self.python:
                for i, info in enumerate(infos):
                    for d in self.python:
                        found[i] += d.python(info) if info.value else []
            for d in self.whole:
                for mine, more in zip(found, d.document(infos), strict=True):
                    mine += more
        if not any(found):
            return data, []
        spans: list[tuple[tuple, list[tuple[int, int, str]], str]] = []
        number: dict[bytes, int] = {}
        first: list[dict] = []
        text = data.decode("utf-8", "surrogateescape")
        for r, some in zip(rows, found, strict=True):
            _, key, at, value, _, _, _, style, _ = r
            kept = self._kept(value, some) if some else some
            whole = text if style == "raw" and name == "text" else value
            spans.append((r, kept, whole))
            if not kept:
                continue
            raw = whole.encode("utf-8", "surrogateescape")
            for a, b, label in kept:
                secret = raw[a:b]
                if secret not in number:
                    number[secret] = len(number) + 1
                    shown = secret.decode("utf-8", "replace")
                    token = template.token(number[secret], label)
                    first.append({"id": number[secret], "secret": shown, "detector": label, "field": key, "path": at, "token": token, "len": len(secret), "offsets": [], "line": None, "column": None, "occurrences": 0, "allowed": self._allowed(path, shown)})
        if not first:
            return data, []
        edits: dict[int, list[tuple[int, int, str]]] = {}
        by_index: dict[int, formats.Leaf] = {}
        places: list[tuple[int, int, int]] = []  # (character where the value stands in the document, bytes from there, id)
        for (i, key, at, _, _, start, end, style, _), kept, value in spans:
            raw = value.encode("utf-8", "surrogateescape")
            whole = number.get(raw)
            if whole:  # a value that is a known secret goes as a whole
                kept = [(0, len(raw), first[whole - 1]["detector"])]
            if not kept:
                continue
            inner = text[start:end].find(value) if name != "bplist" else -1
            mine = []
            for a, b, _ in kept:
                f = first[number[raw[a:b]] - 1]
                f["occurrences"] += 1
                if inner >= 0:
                    places.append((start + inner, a, f["id"]))
                if not f["allowed"]:
                    mine.append((a, b, f["token"]))
            if mine:
                edits[i] = mine
                by_index[i] = formats.Leaf(value, key, at, start, end, style)
        places.sort()
        for (_, a, i), at in zip(places, _bytes_at(text, [p for p, _, _ in places]), strict=True):
            first[i - 1]["offsets"].append(at + a)
        for f in first:
            f["offsets"].sort()
            at = f["offsets"][0] if f["offsets"] else None
            f["line"] = None if at is None else data.count(b"\n", 0, at) + 1
            f["column"] = None if at is None else at - (data.rfind(b"\n", 0, at) + 1) + 1
        return formats.rewrite(data, name, by_index, edits) if edits else data, first

    def _kept(self, value: str, some: list) -> list[tuple[int, int, str]]:
        """Merged spans without those inside tokens, then without those inside an allowed pattern."""
        if not some:
            return []
        out = merged(some, self.options.template.find_tokens(value))
        for pattern in self.within if out else ():
            marks = [x for m in pattern.finditer(value) for x in m.span()]
            places = list(_bytes_at(value, marks))
            zones = list(zip(places[::2], places[1::2], strict=True))
            out = [s for s in out if not any(a <= s[0] and s[1] <= b for a, b in zones)] if zones else out
        return out

    def _allowed(self, path: str | None, secret: str) -> bool:
        return self.tester(secret) or bool(path and not self.options.files.is_empty and self.listed(path))


def _bytes_at(text: str, places: list[int]) -> list[int]:
    """Byte offsets of rising character offsets."""
    return places if text.isascii() else list(byte_offsets(_one_byte(text), places))


def _one_byte(text: str) -> str:
    """The text with each stand-in for an undecodable byte as one byte."""
    return re.sub("[\ud800-\udfff]", "?", text)


def redact_all(docs: DataFrame, names: Iterable[str | Detector] = (*D.DEFAULT, "credential_key"), options: Options | None = None) -> DataFrame:
    """(doc_id, path, format, content, warning, findings) of (doc_id, path, content) documents.

    Documents without findings keep their bytes. findings is an array, numbered by first appearance.
    """
    options = options or Options()
    detectors = resolve(names)
    native = [d for d in detectors if d.native]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, reader = _Document(options, detectors), _Reader(options)
        for part in _parts(batches):
            if native:
                doc, paths, data, name, warning, some, spans = part.columns
                given = zip(name.to_pylist(), _rows(some), warning.to_pylist(), _rows(spans), strict=True)
            else:
                doc, paths, data = part.columns
                given = ((*reader.leaves(x or b"", path), None) for path, x in zip(paths.to_pylist(), data.to_pylist(), strict=True))
            out, every = [], []
            for path, body, (name, rows, warning, found) in zip(paths.to_pylist(), data.to_pylist(), given, strict=True):
                content, found = document.finish(path, body or b"", name, rows, found)
                out.append((name, content, warning))
                every.append([tuple(f.values()) for f in found])
            names, contents, warnings = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([doc, paths, pa.array(names, pa.string()), pa.array(contents, pa.binary()), pa.array(warnings, pa.string()), _lists(every, _FINDING)], ["doc_id", "path", "format", "content", "warning", "findings"])

    rows = parsed(docs, options).withColumn("spans", _native_spans(native)) if native else _base(docs)
    return rows.mapInArrow(run, f"doc_id string, path string, format string, content binary, warning string, findings array<{FINDING}>")


def redact_documents(docs: DataFrame, names: Iterable[str | Detector] = D.DEFAULT, template: Template | None = None, comments: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """(rendered, findings) of redact_all, the credential_key detector included; findings as rows."""
    names = list(names)
    names += [] if "credential_key" in names else ["credential_key"]
    done = redact_all(docs, names, Options(template=template or Template.parse(), comments=comments, **options))
    found = done.select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.*")
    return done.drop("findings"), found

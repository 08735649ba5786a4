"""Secret scan with a recursive decoding worklist.

Each text is a layer. A layer is searched for secrets; then every encoding found in it is unwrapped into a new
layer that goes on the worklist: URL escapes and backslash-u escapes (whole layer), base64 runs, also joined over
line breaks and from each of the four places where their first group may begin (they may stand behind letters of the
same alphabet, such as a path), and base64 runs that hold gzip or zlib data. Bytes with as many zeros as UTF-16 has are
also read as that. A layer carries a map from its characters to spans of the original text, so a secret
found at any depth is reported as the smallest span of the original that produced it. Layers that were seen before
(same content over the same original span) end their branch, so data that unpack to themselves stop at a fixpoint.
Every layer is scanned, also if it isn't text: bytes that aren't UTF-8 stand in it as lone surrogates.

A null or empty text has no secrets. Ties are resolved by the output order (start, then kind as listed, then end);
a span found at several depths is reported once. Repeated rows are scanned again, an empty table gives no rows, and
other columns are not read (`mask` passes them through, whatever their names). No text is cut: a packed layer
is unpacked in full, all members of it, and one of more than `max_layer_bytes` (64 MiB) is scanned in overlapping
pieces that don't cut encoded runs. Only a run inside such a layer that is longer than that by itself, or streams in
streams of that size more than 16 deep, aren't read whole: n_oversize counts them, and mask() puts `[unread]` for them.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

KINDS = ("assign", "access", "hex")
_ci = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
ASSIGN = re.compile(f"(?:{_ci('password')}|{_ci('passwd')}|{_ci('secret')}|{_ci('token')}|{_ci('api')}_?{_ci('key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_HINT = re.compile(r"""[DdTtNnYy]["']?\x20*[:=]""")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
BREAK = re.compile(rb"[^A-Za-z0-9+/_=%\\\r\n \t-]|(?<=[^\r\n \t])[ \t]")
MAX_LAYER_BYTES = 64 << 20
#: Bytes fed to and taken from a stream at once; size and overlap of the pieces of larger layers; streams in streams.
STEP, CHUNK, PIECE, OVERLAP, DEPTH = 64 << 10, 1 << 20, 4 << 20, 4 << 10, 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the three base patterns; a match that is too short still uses up its text."""
    out = []
    if ("=" in text or ":" in text) and ASSIGN_HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


class Layer:
    """Decoded text with breakpoints: characters from at[i] on come from source[i], one to one where linear[i]."""

    def __init__(self, text: str, at: list[int], source: list[tuple[int, int]], linear: list[bool]):
        self.text, self.at, self.source, self.linear = text, at, source, linear

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """Smallest original span that produced characters start to end."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        low = self.source[i][0] + (start - self.at[i] if self.linear[i] else 0)
        high = self.source[j][0] + (end - self.at[j]) if self.linear[j] else self.source[j][1]
        return low, high


def unescape(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each run of escapes replaced."""
    text, at, source, linear, parts, last, size = layer.text, [], [], [], [], 0, 0

    def keep(a: int, b: int) -> None:
        nonlocal size
        i = bisect_right(layer.at, a) - 1
        while a < b:  # a kept stretch may cross breakpoints of the layer below
            stop = min(b, layer.at[i + 1] if i + 1 < len(layer.at) else b)
            at.append(size)
            source.append(layer.origin(a, stop))
            linear.append(layer.linear[i])
            parts.append(text[a:stop])
            size += stop - a
            a, i = stop, i + 1

    changed = False
    for m in pattern.finditer(text):
        changed = True
        new = decode(m.group())
        keep(last, m.start())
        at.append(size)
        source.append(layer.origin(m.start(), m.end()))
        linear.append(False)
        parts.append(new)
        size += len(new)
        last = m.end()
    if not changed:
        return None
    keep(last, len(text))
    return Layer("".join(parts), at, source, linear)


def _from_url(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape")


def _from_unicode(run: str) -> str:
    units = [int(x[2:], 16) for x in re.findall(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}", run)]
    return b"".join(u.to_bytes(2, "little") for u in units).decode("utf-16-le", "surrogatepass")


def _packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0


def _inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """All members of gzip or zlib data, unpacked in chunks; from where data aren't compressed they come as they are."""
    data, unpack = b"", None
    while True:
        if unpack is None:
            while len(data) < 3 and (more := next(chunks, b"")):
                data += more
            if not _packed(data):
                break
            unpack = zlib.decompressobj(47)
        part, data = data[:STEP], data[STEP:]
        before = unpack.copy()
        try:
            out = unpack.decompress(part, CHUNK)
        except zlib.error:
            data = part + data
            for i in range(len(part)):  # what the bytes before the fault unpack to
                try:
                    out = before.decompress(part[i : i + 1])
                except zlib.error:
                    break
                if out:
                    yield out
            break
        if out:
            yield out
        if unpack.eof:
            data = (unpack.unused_data + data).lstrip(b"\0")
            unpack = None
            continue
        data = unpack.unconsumed_tail + data
        if not data and not (data := next(chunks, b"")):
            if out := unpack.flush():
                yield out
            return
    if data:
        yield data
    yield from chunks


def _steps(data: bytes) -> Iterator[bytes]:
    return (data[i : i + STEP] for i in range(0, len(data), STEP))


def _head(chunks: Iterator[bytes], size: int) -> bytes:
    """The next chunks, size bytes or more unless the data end before."""
    out, n = [], 0
    while n < size and (more := next(chunks, b"")):
        out.append(more)
        n += len(more)
    return b"".join(out)


def _pieces(chunks: Iterator[bytes], limit: int) -> Iterator[tuple[bytes, bool]]:
    """(piece, whether a run was cut before it) of data over the limit.

    Pieces overlap, and begin where no run of base64 or escapes goes on, so each run is whole in one of them. Only
    a run that is longer than the limit is cut.
    """
    size, least, depth = min(limit, PIECE), min(limit // 2, OVERLAP), 0
    head = _head(chunks, size)
    while _packed(head):
        rest = _inflate(chain([head], chunks))
        inner = _head(rest, size)
        if inner[:size] == head[:size]:  # not compressed, or a fixpoint
            head, chunks = inner, rest
            break
        head, chunks, depth = inner, rest, depth + 1
        if depth == DEPTH:
            yield head, True
            break
    cut = False
    while head:
        more = _head(chunks, size)
        if not more:
            yield head, cut
            return
        look, at = least, -1
        while at < 0 and look < len(head):
            look = min(8 * look + 1, len(head))
            at = max((m.start() for m in BREAK.finditer(head, max(1, len(head) - look), len(head) - least)), default=-1)
        if at < 0 and len(head) < limit:
            head += more
            continue
        yield head, cut
        cut = at < 0
        head = head[len(head) - least if cut else at :] + more


def _unpack(run: str, limit: int) -> Iterator[tuple[str, bool]]:
    """(layer, whether something before it is unread) inside a base64 run, plain or compressed at any depth.

    Bytes that aren't UTF-8 become lone surrogates. Data of more than `limit` bytes are several layers.
    """
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        data = base64.b64decode(body[: len(body) - (len(body) % 4 == 1)] + "=" * (-len(body) % 4 if len(body) % 4 != 1 else 0))
    except (binascii.Error, ValueError):
        return
    seen = set()
    while (key := hashlib.blake2b(data).digest()) not in seen and _packed(data):
        seen.add(key)
        chunks = _inflate(_steps(data))
        inner = _head(chunks, limit + 1)
        if len(inner) > limit:
            for piece, cut in _pieces(chain(_steps(inner), chunks), limit):
                yield piece.decode("utf-8", "surrogateescape"), cut
            return
        data = inner
    if data:
        yield data.decode("utf-8", "surrogateescape"), False


def _shifted(run: str) -> Iterator[int]:
    """Where in a base64 run the data may begin: its first four characters, what follows a slash, and gzip's mark."""
    starts = {0, 1, 2, 3}
    starts.update(m.end() for m in re.finditer("/", run))
    starts.update(m.start() for m in re.finditer("H4sI", run))
    return (i for i in sorted(starts) if len(run) - i >= 16)


def _packed_head(run: str, start: int) -> bool:
    return _packed(base64.b64decode(run[start : start + 8].replace("-", "+").replace("_", "/")))


def _as_utf16(text: str) -> Iterator[str]:
    """What a layer's bytes say as UTF-16, where every other one is mostly zero."""
    zeros = text.count("\0")
    if zeros > len(text) // 4:
        data = text.encode("utf-8", "surrogateescape")
        low = data[1::2].count(0)
        yield data[: len(data) // 2 * 2].decode("utf-16-le" if 2 * low >= zeros else "utf-16-be", "replace")


def base64_runs(text: str) -> Iterator[tuple[str, int, int]]:
    """(run, start, end) of base64 runs: within lines, and joined over single line breaks with indentation.

    Lines that follow each other are joined as a whole, and in blocks of lines of one width with a shorter last one, with
    and without the line before (text before or after the data may be of the same alphabet). Each line is in six
    runs at most.
    """
    for m in BASE64.finditer(text):
        yield m.group(), m.start(), m.end()
    if "\n" not in text:
        return
    for m in WRAPPED.finditer(text):
        lines = [x.span() for x in LINE.finditer(text, m.start(), m.end())]
        pad = m.end() - lines[-1][1]
        spans, i = {(0, len(lines))}, 0
        while i < len(lines):
            j, width = i + 1, lines[i][1] - lines[i][0]
            while j < len(lines) and lines[j][1] - lines[j][0] == width:
                j += 1
            end = j + (j < len(lines) and lines[j][1] - lines[j][0] < width)
            spans |= {(max(i - 1, 0), end), (i, end)}
            i = j
        for i, j in spans:
            if j - i > 1:
                run = "".join(text[a:b] for a, b in lines[i:j])
                if len(run) >= 16:
                    last = j == len(lines)
                    yield run + "=" * (last and pad), lines[i][0], m.end() if last else lines[j - 1][1]


def scan_text(text: str, limit: int = MAX_LAYER_BYTES) -> tuple[list, list, int, int]:
    """(base spans, all spans, decoded layers, unread runs), spans as (start, kind index, end), sorted."""
    base, found, layers, unread = _scan(text, limit)
    return base, found, layers, len(unread)


def _scan(text: str, limit: int) -> tuple[list, list, int, list]:
    """As scan_text, with the (start, end) of the original spans that hold a run too long to read whole."""
    base = base_spans(text)
    found, layers, unread = set(base), 0, set()
    seen: set[bytes] = set()
    work = [_children(Layer(text, [0], [(0, len(text))], [True]), limit)]
    while work:
        layer, cut = next(work[-1], (None, False))
        if layer is None:
            work.pop()
            continue
        low, high = layer.source[0][0], layer.source[-1][1]
        if cut:
            unread.add((low, high))
        key = hashlib.blake2b(f"{low}:{high}:".encode() + layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        layers += 1
        for s, k, e in base_spans(layer.text):
            low, high = layer.origin(s, e)
            found.add((low, k, high))
        work.append(_children(layer, limit))
    return sorted(base), sorted(found), layers, sorted(unread)


def _children(layer: Layer, limit: int) -> Iterator[tuple[Layer, bool]]:
    """(layer, whether something before it is unread) for what is encoded in a layer, one at a time."""
    if "%" in layer.text and (new := unescape(layer, URL, _from_url)):
        yield new, False
    if "\\" in layer.text and (new := unescape(layer, UNICODE, _from_unicode)):
        yield new, False
    for run, start, end in base64_runs(layer.text):
        for shift in _shifted(run) if end - start == len(run) else (0,):
            if shift > 3 and not _packed_head(run, shift):
                continue  # what is not compressed is read from one of the first four places anyway
            origin = layer.origin(start + shift, end)
            for inner, cut in _unpack(run[shift:], limit):
                yield Layer(inner, [0], [origin], [False]), cut
                for wide in _as_utf16(inner):
                    yield Layer(wide, [0], [origin], [False]), cut


def spans_text(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer_bytes: int = MAX_LAYER_BYTES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, found, n_layers, n_oversize) of each row.

    `found` lists the spans as structs with the text they cover. No shuffle, one pass over the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
        for ids, texts in common.texts_of(batches):
            rows = []
            for doc, text in zip(ids, texts, strict=True):
                base, spans, layers, oversize = scan_text(text, max_layer_bytes)
                kinds = [k for _, k, _ in base]
                found = [{"kind": KINDS[k], "start": s, "end": e, "value": text[s:e]} for s, k, e in spans]
                rows.append((doc, *map(kinds.count, range(3)), hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(spans), found, layers, oversize))
            cols = list(zip(*rows, strict=True))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(span), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found", "n_layers", "n_oversize"]
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long,value:string>>, n_layers long, n_oversize long"
    return common.id_text(df, id_col, text_col).mapInArrow(run, schema)


def mask(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with every secret of text_col, at any depth, replaced by `[kind]`; all columns stay. Null stays null."""
    at = df.schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("secrets")
        for batch in batches:
            for part in common.slices(batch, at):
                out = [None if t is None else mask_text(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(out, part.schema.field(at).type) if i == at else c for i, c in enumerate(part.columns)], schema=part.schema)

    return df.mapInArrow(run, df.schema)


def mask_text(text: str, max_layer_bytes: int = MAX_LAYER_BYTES) -> str:
    """The text with its secrets as `[kind]`, and with what can't be read whole as `[unread]`."""
    _, found, _, unread = _scan(text, max_layer_bytes)
    spans = sorted([(s, KINDS[k], e) for s, k, e in found] + [(s, "unread", e) for s, e in unread], key=lambda x: (x[0], x[1] == "unread"))
    if not spans:
        return text
    parts, last = [], 0
    for s, kind, e in spans:
        if s >= last:
            parts += [text[last:s], f"[{kind}]"]
        last = max(last, e)
    return "".join([*parts, text[last:]])

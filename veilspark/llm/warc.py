"""WARC archives of pages and a globally ordered capture index by external merge.

`write` gives each task's pages to one archive of gzip members in the shared folder and lays a capture run beside it:
the (URL key, timestamp, page_id) entries of the archive, sorted, in blocks with a sparse index of first keys.
`read` opens the archives and returns their records. `merge_index` cuts the key space into ranges by the sparse index
and merges, in each range, the blocks of all runs with a loser tree, so the ranges together are one ordered history.

Equal payloads (by SHA-1 digest, at least `least_bytes` long) are stored once, under the largest page_id; the others
become revisit records that name it. A null or empty page has an empty payload and counts like any other. Rows that
repeat a page_id are each written, as responses where theirs is the largest of its payload. Captures of one key and time are
ordered by page_id; a missing page_id stays missing and comes first. A null URL has an empty key. An empty table writes nothing. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
BLOCK = 512
NO_ID = -(1 << 63)  # stands in the index for a missing page_id
STEP = 8 << 10  # bytes handed to the unpacker at once
FAN_IN = 512  # runs merged at once by one tree; more are merged in rounds


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels reversed, then port, path and query; no scheme, www or fragment."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)(:\d+)?([^#]*)", url or "")
    if not m:
        return (url or "").split("#")[0].lower()
    host = m[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (m[2] or "") + ")" + (m[3] or "/")


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def record(page_id: int, url: str, date: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda c: f'%{ord(c[0]):02X}', url)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return _member("\r\n".join(head).encode() + body + b"\r\n\r\n")


def parse(data: bytes) -> dict:
    """Fields of one unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut off")
    number = lambda k: int(x) if (x := fields.get(k, "")[len("<urn:page:") : -1]) else None
    return {"type": fields["WARC-Type"], "page_id": number("WARC-Record-ID"), "refers_to": number("WARC-Refers-To"), "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "length": int(fields["X-Payload-Length"]), "date": fields["WARC-Date"], "url": fields["WARC-Target-URI"], "body": rest[:size]}


def members(stream) -> Iterator[bytes]:
    """Unpacked gzip members of a stream, one at a time; what is read is handed on in small steps, so many small
    members cost no copies of all that follows them."""
    pack, parts, data, at = zlib.decompressobj(31), [], b"", 0
    while True:
        if at == len(data):
            data, at = stream.read(1 << 20), 0
            if not data:
                if parts or pack.unconsumed_tail:
                    raise ValueError("archive ends inside a member")
                return
        step = data[at : at + STEP]
        parts.append(pack.decompress(step))
        at += len(step) - len(pack.unused_data)
        if pack.eof:
            yield b"".join(parts)
            pack, parts = zlib.decompressobj(31), []


def write(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives and capture runs; (archive, run, blocks array) per task, as a table in the shared folder.

    The largest page_id of each digest is found by a pre-aggregated group; the join that hands it out is split by Spark
    where one payload is very common. Files get new names in every attempt and only those of finished tasks are listed.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html")))
    first = rows.select("digest", "page_id", F.octet_length("html").alias("size")).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"), F.max("size").alias("size"))
    first = common.materialize(first.filter((F.col("copies") > 1) & (F.col("size") >= least_bytes)).select(F.col("digest").alias("d"), "keeper"), "digests")
    rows = rows.join(first, rows.digest == first.d, "left").drop("d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = common.open_store(folder)
        name = uuid.uuid4().hex
        out, entries, offset = None, [], 0
        for batch in batches:
            for page, url, body, digest, keeper in zip(*(batch.column(i) for i in range(5)), strict=True):
                page, url, body, digest, keeper = page.as_py(), url.as_py(), body.as_py(), digest.as_py(), keeper.as_py()
                if out is None:
                    store.create_dir(at, recursive=True)
                    out = store.open_output_stream(f"{at}/{name}.warc.gz", compression=None)
                date = (EPOCH + timedelta(seconds=(page or 0) % 2_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")
                data = record(page, url, date, body, base64.b32encode(digest).decode(), None if keeper is None or keeper == page else keeper)
                out.write(data)
                entries.append((url_key(url), date, NO_ID if page is None else page, offset, len(data)))
                offset += len(data)
        if out is None:
            return
        out.close()
        entries.sort()
        blocks, size = [], 0
        with store.open_output_stream(f"{at}/{name}.cdx", compression=None) as index:
            for i in range(0, len(entries), BLOCK):
                data = zlib.compress("\n".join("\t".join(map(str, (k.replace("\t", "%09").replace("\n", "%0A"), *rest))) for k, *rest in entries[i : i + BLOCK]).encode(), 1)
                index.write(data)
                blocks.append({"key": entries[i][0], "date": entries[i][1], "page_id": entries[i][2], "offset": size, "length": len(data)})
                size += len(data)
        kind = pa.list_(pa.struct([("key", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.warc.gz"]), pa.array([f"{folder}/{name}.cdx"]), pa.array([blocks], kind)], ["archive", "run", "blocks"])

    schema = "archive string, run string, blocks array<struct<key:string,date:string,page_id:long,offset:long,length:long>>"
    return common.materialize(rows.select("page_id", "url", "html", "digest", "keeper").mapInArrow(run, schema), "archives")


def read(archives: DataFrame) -> DataFrame:
    """(page_id, url, date, record_type, refers_to, payload_bytes, payload_digest, payload) of all records.

    A response's length and digest are computed from its payload and held against its header; a revisit has those of
    the payload it stands for in its header, and no payload of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = common.open_store(path)
                rows, size = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for data in members(stream):
                        x = parse(data)
                        if x["type"] == "response" and (len(x["body"]), base64.b32encode(hashlib.sha1(x["body"]).digest()).decode()) != (x["length"], x["digest"]):
                            raise ValueError(f"payload of page {x['page_id']} does not match its header")
                        rows.append((x["page_id"], x["url"], x["date"], x["type"], x["refers_to"], x["length"], x["digest"], x["body"] if x["type"] == "response" else None))
                        size += len(x["body"])
                        if size > common.SLICE_BYTES or len(rows) >= 2000:
                            yield _records(rows)
                            rows, size = [], 0
                if rows:
                    yield _records(rows)

    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that few bytes of paths aren't one task
    return archives.select("archive").repartition(tasks, "archive").mapInArrow(run, "page_id long, url string, date string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def _records(rows: list) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "date", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


class LoserTree:
    """Merge of sorted iterators: each inner node keeps the loser of its match, the winner goes up, so the next item
    costs one match per level."""

    def __init__(self, runs: list[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.size = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.tree = [-1] * self.size
        for i in range(self.size):
            self._play(i, filling=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, i: int, filling: bool = False) -> None:
        winner, node = i, (i + self.size) // 2
        while node:
            other = self.tree[node]
            if filling and other < 0:
                self.tree[node] = winner
                return
            if self._before(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while (item := self.heads[i := self.tree[0]]) is not None:
            yield item
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def merge(runs: list[Iterator]) -> Iterator:
    """Ordered items of any number of sorted iterators; FAN_IN of them share a tree, and trees merge trees."""
    while len(runs) > FAN_IN:
        runs = [iter(LoserTree(runs[i : i + FAN_IN])) for i in range(0, len(runs), FAN_IN)]
    return iter(LoserTree(runs))


def _entries(path: str, blocks: list[tuple[int, int]], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Entries of a run from low on and before high, reading one block at a time."""
    store, at = common.open_store(path)
    with store.open_input_file(at) as f:
        for offset, length in sorted(blocks):
            f.seek(offset)
            for line in zlib.decompress(f.read(length)).decode().split("\n"):
                key, date, page, start, size = line.split("\t")
                entry = (key, date, int(page), path, int(start), int(size))
                if (low is None or entry[:3] >= low) and (high is None or entry[:3] < high):
                    yield entry


def merge_index(archives: DataFrame, ranges: int | None = None) -> DataFrame:
    """(part, pos, url_key, date, page_id, archive, offset, length): captures in global order of (part, pos).

    Range bounds come from the sparse index (one entry per BLOCK captures): a range partitioning of it gives the
    first key of each range, so only as many rows as there are ranges reach the driver.
    """
    spark: SparkSession = archives.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sparse = archives.select("run", F.posexplode("blocks").alias("nr", "b")).select("run", "nr", "b.key", "b.date", "b.page_id", "b.offset", "b.length")
    cuts = sparse.select("key", "date", "page_id").repartitionByRange(ranges, "key", "date", "page_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("key", "date", "page_id")).alias("k")).collect()
    bounds = sorted((r.k.key, r.k.date, r.k.page_id) for r in cuts)[1:]
    shared = spark.sparkContext.broadcast(bounds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block lies in the ranges from that of its first key to that of the next block's first key."""
        from bisect import bisect_right

        bounds = shared.value
        for batch in batches:
            out = []
            for run, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, b in enumerate(blocks):
                    first = bisect_right(bounds, (b["key"], b["date"], b["page_id"]))
                    after = blocks[i + 1] if i + 1 < len(blocks) else None
                    last = bisect_right(bounds, (after["key"], after["date"], after["page_id"])) if after else len(bounds)
                    out += [(p, run, b["offset"], b["length"]) for p in range(first, last + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.string(), pa.int64(), pa.int64()], strict=True)], ["part", "run", "offset", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for part, blocks in _by_part(batches):
            low = bounds[part - 1] if part else None
            high = bounds[part] if part < len(bounds) else None
            rows = []
            for pos, x in enumerate(merge([_entries(path, b, low, high) for path, b in sorted(blocks.items())])):
                rows.append((part, pos, *x[:3], x[3].removesuffix(".cdx") + ".warc.gz", *x[4:]))
                if len(rows) == 10_000:
                    yield _captures(rows)
                    rows = []
            if rows:
                yield _captures(rows)

    placed = archives.select("run", "blocks").mapInArrow(place, "part int, run string, offset long, length long")
    return placed.repartition(ranges, "part").sortWithinPartitions("part", "run", "offset").mapInArrow(run, "part int, pos long, url_key string, date string, page_id long, archive string, offset long, length long")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
    part, blocks = None, {}
    for batch in batches:
        for p, run, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                if blocks:
                    yield part, blocks
                part, blocks = p, {}
            blocks.setdefault(run, []).append((offset, length))
    if blocks:
        yield part, blocks


def _captures(rows: list) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["part", "pos", "url_key", "date", "page_id", "archive", "offset", "length"])


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages, read them back and join each record with its place in the merged index.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, part, pos)
    """
    spark = pages.sparkSession
    archives = write(pages, common.scratch(spark, "warc"), least_bytes)
    records = read(archives).drop("payload", "url", "date")
    index = merge_index(archives).select(F.nullif("page_id", F.lit(NO_ID)).alias("id"), "part", "pos")
    index = index.groupBy("id").agg(F.min(F.struct("part", "pos")).alias("at"))
    # a sort-merge join: the index grows with the pages, so it is never broadcast, whatever its size is thought to be
    out = records.join(index.hint("merge"), records.page_id.eqNullSafe(index.id), "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("at.part").alias("index_part"), F.col("at.pos").alias("index_pos"))

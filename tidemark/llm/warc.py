"""WARC archives as a Python data source, ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing: each task writes gzip archives, one gzip member for each record, to names of its own; a manifest names the files of the tasks that committed, so
leftovers of lost or repeated attempts are never read. The manifest also lists record starts every ``SPLIT`` bytes, along which a file is
cut into partitions. A member carries its length in the ``sl`` extra field. Reading without a manifest takes every ``.warc`` and ``.warc.gz``
file as one partition.

Reading: headers are parsed first. Predicates on record type and header columns are pushed into the scan; a record that fails is skipped by its length (or
read over without keeping it where no length is known), and its payload is never decoded. ``option("payload", "false")`` leaves payloads out.

Files are opened with pyarrow's file systems, so a folder must be one that those reach from every executor.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringStartsWith,
    WriterCommitMessage,
)

from ..session import ensure_checkpoint_dir

SPLIT = 8 << 20
FILE_BYTES = 1 << 30
BATCH = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Column, WARC header, type. Ids stand between angle brackets, digests after their algorithm.
COLUMNS = (
    ("record_id", "warc-record-id", "string"), ("record_type", "warc-type", "string"), ("target_uri", "warc-target-uri", "string"),
    ("date", "warc-date", "string"), ("payload_digest", "warc-payload-digest", "string"), ("refers_to", "warc-refers-to", "string"),
    ("content_type", "content-type", "string"), ("content_length", "content-length", "bigint"), ("payload_length", "x-payload-length", "bigint"),
)
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def header_line(value: str) -> str:
    """A header value cannot hold line breaks."""
    return " ".join(value.split("\r")).replace("\n", " ")


def record(row: dict) -> bytes:
    """One WARC record. Payloads are wrapped in an HTTP response; a revisit has the HTTP header only."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    block = http + (payload if row["record_type"] == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{header_line(row['record_id'])}>", f"WARC-Date: {row['date']}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {header_line(row['target_uri'])}")
    lines += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_length']}"]
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{header_line(row['refers_to'])}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member that names its own length, where 32 bits hold it."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body) + 8
    if size >= 1 << 32:
        return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + tail
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF) + body + tail


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.level = options["path"], overwrite, int(options.get("level", "4"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = place(self.path)
        fs.create_dir(root, recursive=True)
        out, done = None, []
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, at, splits = fs.open_output_stream(f"{root}/{name}", compression=None), 0, [0]
                if at - splits[-1] >= SPLIT:
                    splits.append(at)
                data = member(record(row), self.level)
                out.write(data)
                at += len(data)
                if at >= FILE_BYTES:
                    out.close()
                    done.append((name, at, splits))
                    out = None
        if out is not None:
            out.close()
            done.append((name, at, splits))
        return Written(done)

    def commit(self, messages) -> None:
        fs, root = place(self.path)
        fs.create_dir(root, recursive=True)
        old = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(root)) if f.base_name.startswith("_manifest-")] if self.overwrite else []
        listed = [f for m in messages if m is not None for f in m.files]
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(listed).encode())
        for f in old:
            fs.delete_file(f.path)

    def abort(self, messages) -> None:
        """Nothing refers to the files of a failed job."""


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int

    def __init__(self, path, start, stop):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


_COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
            LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b, StringStartsWith: lambda a, b: a.startswith(b)}


def passes(f, value) -> bool | None:
    """Whether a header value satisfies a filter; None where SQL has NULL."""
    if isinstance(f, Not):
        inner = passes(f.child, value)
        return None if inner is None else not inner
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    return None if value is None else _COMPARE[type(f)](value, f.value)


class _Window:
    """Bytes of a file from an offset on, read as needed."""

    def __init__(self, handle, start: int):
        self.handle, self.at, self.data = handle, start, b""
        handle.seek(start)

    def need(self, offset: int, n: int) -> bytes:
        """``n`` bytes from a file offset, fewer at the end of the file."""
        if not self.at <= offset <= self.at + len(self.data):
            self.handle.seek(offset)
            self.at, self.data = offset, b""
        elif offset - self.at > BATCH:
            self.data, self.at = self.data[offset - self.at:], offset
        lack = offset + n - self.at - len(self.data)
        if lack > 0:
            self.data += self.handle.read(max(lack, 1 << 20))
        return self.data[offset - self.at:offset - self.at + n]


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.names, self.filters = options["path"], [f.name for f in schema.fields], []
        self.types = [f.dataType.simpleString() for f in schema.fields]

    def pushFilters(self, filters):
        known = {c for c, _, _ in COLUMNS}
        for f in filters:
            base = f.child if isinstance(f, Not) else f
            if (type(base) in _COMPARE or isinstance(base, (IsNull, IsNotNull))) and len(base.attribute) == 1 and base.attribute[0] in known:
                self.filters.append((base.attribute[0], f))
            else:
                yield f

    def partitions(self):
        fs, root = place(self.path)
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        manifests = [f for f in found if f.base_name.startswith("_manifest-")]
        out = []
        for m in manifests:
            with fs.open_input_stream(m.path) as f:
                for name, size, splits in json.loads(f.read()):
                    out += [Range(f"{root}/{name}", a, b) for a, b in zip(splits, [*splits[1:], size], strict=True)]
        if not manifests:
            out = [Range(f.path, 0, f.size) for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and f.size]
        return out or [Range("", 0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = place(self.path)
        rows, size = [], 0
        with fs.open_input_file(partition.path) as handle:
            scan = _members if partition.path.endswith(".gz") else _plain
            for row in scan(_Window(handle, partition.start), partition.start, partition.stop, self._wanted, "payload" in self.names):
                rows.append(row)
                size += 500 + len(row.get("payload") or b"")
                if size > BATCH:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _wanted(self, row: dict) -> bool:
        return all(passes(f, row[c]) for c, f in self.filters)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _ARROW[t]) for n, t in zip(self.names, self.types, strict=True)], names=self.names)


def headers(head: bytes) -> dict:
    """The columns of a record from its header block."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            named.setdefault(name.strip().lower(), value.strip())
    row: dict = {}
    for column, header, kind in COLUMNS:
        value = named.get(header)
        if value is not None and column in ("record_id", "refers_to"):
            value = value.removeprefix("<").removesuffix(">")
        elif value is not None and column == "payload_digest":
            value = value.partition(":")[2] or value
        row[column] = int(value) if value is not None and kind == "bigint" else value
    return row


def payload_of(row: dict, block: bytes) -> bytes | None:
    """The payload in a block: what follows the HTTP header of a response, the whole block of other records, nothing for a revisit."""
    if row["record_type"] == "revisit":
        return None
    if row["record_type"] == "response" and (row["content_type"] or "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _plain(window: _Window, at: int, stop: int, wanted, payload: bool):
    while at < stop:
        head, n = window.need(at, 4096), 4096
        while b"\r\n\r\n" not in head and len(head) == n:
            n *= 2
            head = window.need(at, n)
        head = head.partition(b"\r\n\r\n")[0]
        if not head.strip():
            return
        row = headers(head)
        begin, length = at + len(head) + 4, row["content_length"] or 0
        if wanted(row):
            if payload:
                row["payload"] = payload_of(row, window.need(begin, length))
            yield row
        at = begin + length + 4


class _Member:
    """A deflate stream inside a file."""

    def __init__(self, window: _Window, at: int):
        self.window, self.fed, self.stream = window, at, zlib.decompressobj(-15)

    def more(self, limit: int) -> bytes:
        data = self.stream.unconsumed_tail
        if not data:
            data = self.window.need(self.fed, 1 << 15)
            self.fed += len(data)
        out = self.stream.decompress(data, limit)
        if not out and not data and not self.stream.eof:
            raise ValueError("truncated archive")
        return out

    def rest(self) -> Iterator[bytes]:
        while not self.stream.eof:
            yield self.more(1 << 20)

    def end(self) -> int:
        """Where the next member starts, known once this one has been read to its end."""
        return self.fed - len(self.stream.unused_data) + 8


def _members(window: _Window, at: int, stop: int, wanted, payload: bool):
    while at < stop:
        head = window.need(at, 1 << 12)
        if len(head) < 18 or head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at {at}")
        flags, skip, length = head[3], 10, None
        if flags & 4:
            extra = struct.unpack_from("<H", head, 10)[0]
            part = head[12:12 + extra]
            while len(part) >= 4:
                n = struct.unpack_from("<H", part, 2)[0]
                if part[:2] == b"sl" and n == 8:
                    length = struct.unpack_from("<I", part, 4)[0]
                part = part[4 + n:]
            skip += 2 + extra
        for bit in (8, 16):
            if flags & bit:
                skip = head.index(b"\0", skip) + 1
        member = _Member(window, at + skip + 2 * bool(flags & 2))
        text = b""
        while b"\r\n\r\n" not in text and not member.stream.eof:
            text += member.more(4096)
        first, _, body = text.partition(b"\r\n\r\n")
        row = headers(first)
        if wanted(row):
            if payload:
                row["payload"] = payload_of(row, b"".join([body, *member.rest()])[:row["content_length"] or 0])
            yield row
        if length is None:
            for _ in member.rest():
                pass
            length = member.end() - at
        at += length


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        columns = [f"{c} {t}" for c, _, t in COLUMNS]
        return ", ".join(columns + ["payload binary"] * (self.options.get("payload", "true") == "true"))

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record for each page to new archives in a folder; copies of a payload of at least ``least`` bytes revisit the one with the largest id.

    A null body is an empty payload, a null URL is left out. Rows that tie for the largest id are responses all; a null id counts as the smallest.
    Other columns are ignored, no pages give an empty archive. Copies are found on digests alone; bodies are not shuffled unless the
    table of copied digests is too large to broadcast, and then a frequent digest is split by adaptive execution.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("long"))
    copied = rows.filter(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(copied, "payload_digest", "left")
    again = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows.select(
        urn("id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("date"), "payload_digest",
        F.when(again, urn("keeper")).alias("refers_to"), "payload_length", F.when(~again, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    return register(spark).read.format("warc").option("payload", str(payload).lower()).load(path)


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"

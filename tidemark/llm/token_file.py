"""Token ids in patched frame-of-reference files, as a Python data source: ``spark.read.format("pfor")`` and ``df.write.format("pfor")``.

A file holds the ids of consecutive documents, end to end, cut into blocks of ``BLOCK`` ids:

    b"PFOR1\\n\\0\\0"
    blocks          for each: minimum (uint32), width (uint8), number of exceptions (uint16), then the ids less the minimum, ``width`` low bits each,
                    64 ids to ``width`` words of 64 bits, then the exceptions: places (uint16 each) and high bits (uint32 each)
    document index  ids of the documents (int64, least value: null), then their numbers of ids (int64)
    block index     byte at which each block starts (int64)
    footer          numbers of ids, documents and blocks (int64 each), b"PFOR1\\n\\0\\0"

The width of a block is the least that ``PERCENTILE`` percent of its ids fit; the rest are exceptions. The last block is filled up with its minimum. All numbers are
little-endian. Any range of ids is read through the block index without touching the blocks before it.

A write adds one manifest that lists the files of committed tasks in the order of their partitions, so leftovers of lost attempts are never read, and says
where parts of whole documents start, along which a file is read by several tasks. Files are opened with pyarrow's file systems: the folder must be one that those reach.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..session import ensure_checkpoint_dir
from .text import LAST, tagged, untag
from .warc import place

MAGIC = b"PFOR1\n\0\0"
BLOCK, PERCENTILE = 1024, 95
#: Ids packed at a time; ids and documents of a file, and ids of a part of it, before the next one starts; bytes of a batch that a reader hands on.
GATHER, FILE_IDS, FILE_DOCS, PART_IDS, BATCH = 1 << 18, 1 << 28, 1 << 20, 1 << 22, 4 << 20
#: Bytes of text encoded at a time.
SLICE = 2 << 20
MANIFEST, TOKENIZER = "_manifest.json", "_tokenizer.json"
NULL_ID = -(1 << 63)
HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("odd", "<u2")])


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value of every row (a multiple of 64 values): 64 values in ``width`` words."""
    rows, n = values.shape
    lanes = values.reshape(rows, n // 64, 64).astype(np.uint64) & np.uint64((1 << width) - 1)
    out = np.zeros((rows, n // 64, width), np.uint64)
    for k in range(64 if width else 0):
        word, shift = divmod(k * width, 64)
        out[:, :, word] |= lanes[:, :, k] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= lanes[:, :, k] >> np.uint64(64 - shift)
    return out.reshape(rows, n // 64 * width)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """Rows of packed words back to values."""
    rows = words.shape[0]
    lanes = words.reshape(rows, -1, width)
    out = np.zeros((rows, lanes.shape[1], 64), np.uint64)
    for k in range(64 if width else 0):
        word, shift = divmod(k * width, 64)
        out[:, :, k] = lanes[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            out[:, :, k] |= lanes[:, :, word + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << width) - 1)).reshape(rows, -1).astype(np.uint32)


def block_bytes(width: int) -> int:
    return BLOCK // 8 * width


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of ``BLOCK`` ids (their number is a multiple of it), each as bytes."""
    rows = ids.reshape(-1, BLOCK)
    least = rows.min(1)
    above = rows - least[:, None]
    bits = np.frexp(above.astype(np.float64))[1].astype(np.uint8)
    widths = np.partition(bits, BLOCK * PERCENTILE // 100 - 1, axis=1)[:, BLOCK * PERCENTILE // 100 - 1]
    odd = bits > widths[:, None]
    head = np.zeros(len(rows), HEAD)
    head["least"], head["width"], head["odd"] = least, widths, odd.sum(1)
    packed: list[bytes] = [b""] * len(rows)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        for i, words in zip(at.tolist(), pack(above[at], int(w)).astype("<u8"), strict=True):
            packed[i] = words.tobytes()
    out = []
    for i in range(len(rows)):
        places = np.flatnonzero(odd[i])
        high = above[i, places] >> np.uint32(widths[i])
        out.append(head[i:i + 1].tobytes() + packed[i] + places.astype("<u2").tobytes() + high.astype("<u4").tobytes())
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at these bytes of ``data``."""
    out = np.zeros((len(starts), BLOCK), np.uint32)
    heads = np.zeros(len(starts), HEAD)
    for i, s in enumerate(starts.tolist()):
        heads[i] = np.frombuffer(data, HEAD, 1, s)[0]
    for w in np.unique(heads["width"]):
        at, size = np.flatnonzero(heads["width"] == w), block_bytes(int(w))
        words = np.frombuffer(b"".join(data[s + HEAD.itemsize:s + HEAD.itemsize + size] for s in starts[at].tolist()), "<u8").reshape(len(at), -1)
        out[at] = unpack(words, int(w)) if w else 0
    for i in np.flatnonzero(heads["odd"]).tolist():
        n, s = int(heads["odd"][i]), int(starts[i]) + HEAD.itemsize + block_bytes(int(heads["width"][i]))
        places, high = np.frombuffer(data, "<u2", n, s), np.frombuffer(data, "<u4", n, s + 2 * n)
        out[i, places] |= high << np.uint32(heads["width"][i])
    return (out + heads["least"][:, None]).ravel()


class FileWriter:
    """One file, written from front to back; holds at most ``GATHER`` ids and one document besides its indexes."""

    def __init__(self, out):
        self.out, self.at = out, len(MAGIC)
        self.waiting, self.held = [], 0
        self.ids, self.docs, self.sizes, self.starts = 0, [], [], []
        out.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(NULL_ID if doc is None else doc)
        self.sizes.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= GATHER:
            self._blocks(self.held // BLOCK * BLOCK)

    def _blocks(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        for lo in range(0, n, GATHER):
            for b in encode_blocks(ids[lo:min(lo + GATHER, n)]):
                self.starts.append(self.at)
                self.out.write(b)
                self.at += len(b)
        self.waiting, self.held = [ids[n:].copy()], len(ids) - n

    def close(self) -> None:
        self._blocks(self.held // BLOCK * BLOCK)
        if self.held:
            rest = self.waiting[0]
            self.waiting = [np.concatenate([rest, np.full(BLOCK - len(rest), rest.min(), np.uint32)])]
            self.held = BLOCK
            self._blocks(BLOCK)
        tail = [np.array(x, "<i8").tobytes() for x in (self.docs, self.sizes, self.starts, [self.ids, len(self.docs), len(self.starts)])]
        self.out.write(b"".join(tail) + MAGIC)
        self.out.close()


class FileReader:
    """Random access to one file."""

    def __init__(self, handle, size: int):
        self.handle, foot = handle, 24 + len(MAGIC)
        handle.seek(size - foot)
        tail = handle.read(foot)
        if tail[24:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        self.ids, self.docs, self.blocks = np.frombuffer(tail, "<i8", 3).tolist()
        self.index = size - foot - 8 * self.blocks
        self.doc_index = self.index - 16 * self.docs

    def _numbers(self, at: int, n: int) -> np.ndarray:
        self.handle.seek(at)
        return np.frombuffer(self.handle.read(8 * n), "<i8")

    def documents(self, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of ``n`` documents from the ``first`` one on."""
        return self._numbers(self.doc_index + 8 * first, n), self._numbers(self.doc_index + 8 * (self.docs + first), n)

    def range(self, lo: int, hi: int) -> np.ndarray:
        """The ids at places ``lo`` to ``hi`` of the file."""
        if hi <= lo:
            return np.zeros(0, np.uint32)
        a, b = lo // BLOCK, -(-hi // BLOCK)
        starts = self._numbers(self.index + 8 * a, min(b - a + 1, self.blocks - a))
        stop = int(starts[b - a]) if b < self.blocks else self.doc_index
        self.handle.seek(int(starts[0]))
        data = self.handle.read(stop - int(starts[0]))
        return decode_blocks(data, starts[:b - a] - starts[0])[lo - a * BLOCK:hi - a * BLOCK]


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: name, bytes, ids, documents, and (first document, first id) of each part."""

    task: int = 0
    files: list = field(default_factory=list)


class TokenWriter(DataSourceArrowWriter):
    """Takes rows of ``doc_id, ids``, or of ``doc_id, text`` where the folder holds a tokenizer."""

    def __init__(self, options):
        self.path, self.file_ids = options["path"], int(options.get("file_ids", FILE_IDS))
        self.end = options.get("end")

    def _documents(self, fs, root: str, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
        tail = np.array([] if self.end is None else [int(self.end)], "<u4")
        for b in iterator:
            names = b.column("doc_id").to_pylist()
            if "text" not in b.schema.names:
                yield from zip(names, (np.frombuffer(x.as_buffer(), "<u4") for x in b.column("ids")), strict=True)
                continue
            lo, texts = 0, b.column("text")
            sizes = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], "<i4", len(texts) + 1, 4 * texts.offset)))
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE, "right")))
                for name, ids in zip(names[lo:hi], encoder(fs, root).encode(texts[lo:hi]), strict=True):
                    yield name, np.concatenate([ids, tail])
                lo = hi

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = place(self.path)
        fs.create_dir(root, recursive=True)
        done, writer = [], None

        def close():
            writer.close()
            done.append((name, writer.at + 16 * len(writer.docs) + 8 * len(writer.starts) + 24 + len(MAGIC), writer.ids, len(writer.docs), parts))

        for doc, ids in self._documents(fs, root, iterator):
            if writer is None:
                name, parts = f"part-{uuid.uuid4().hex}.pfor", [(0, 0)]
                writer = FileWriter(fs.open_output_stream(f"{root}/{name}", compression=None))
            if writer.ids - parts[-1][1] >= PART_IDS:
                parts.append((len(writer.docs), writer.ids))
            writer.add(doc, ids)
            if writer.ids >= self.file_ids or len(writer.docs) >= FILE_DOCS:
                close()
                writer = None
        if writer is not None:
            close()
        return Written(TaskContext.get().partitionId(), done)

    def commit(self, messages) -> None:
        fs, root = place(self.path)
        fs.create_dir(root, recursive=True)
        if fs.get_file_info(f"{root}/{MANIFEST}").type != pyarrow.fs.FileType.NotFound:
            raise FileExistsError(f"{root} holds token files already")
        listed = [f for m in sorted((m for m in messages if m is not None), key=lambda m: m.task) for f in m.files]
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages) -> None:
        """Nothing refers to the files of a failed job."""


class Part(InputPartition):
    def __init__(self, path: str, size: int, docs: tuple[int, int], first: int, start: int):
        super().__init__((path, size, docs, first, start))
        self.path, self.size, self.docs, self.first, self.start = path, size, docs, first, start


class TokenReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.wanted = options["path"], "ids" in [f.name for f in schema.fields]

    def partitions(self):
        fs, root = place(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            files = json.loads(f.read())
        out, start = [], 0
        for name, size, ids, docs, parts in files:
            ends = [p[0] for p in parts[1:]] + [docs]
            out += [Part(f"{root}/{name}", size, (a, b), first, start) for (a, first), b in zip(parts, ends, strict=True)]
            start += ids
        return out or [Part("", 0, (0, 0), 0, 0)]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = place(self.path)
        with fs.open_input_file(part.path) as handle:
            file = FileReader(handle, part.size)
            docs, sizes = file.documents(part.docs[0], part.docs[1] - part.docs[0])
            ends = np.cumsum(sizes)
            lo = 0
            while lo < len(docs):
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + BATCH // 4, "right")))
                own = slice(lo, hi)
                columns = [pa.array(docs[own], mask=docs[own] == NULL_ID), pa.array(part.start + part.first + ends[own] - sizes[own]), pa.array(sizes[own])]
                if self.wanted:
                    ids = file.range(part.first + before, part.first + int(ends[hi - 1])).astype("<u4")
                    offsets = np.concatenate([[0], np.cumsum(4 * sizes[own])]).astype("<i8")
                    columns.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"][:len(columns)])
                lo = hi


class TokenSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pfor"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, n_tokens bigint" + ", ids binary" * (self.options.get("ids", "true") == "true")

    def reader(self, schema):
        return TokenReader(self.options, schema)

    def writer(self, schema, overwrite):
        return TokenWriter(self.options)


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct piece between white space once.

    A byte-level pre-tokenizer never joins a character with white space after it, so a text may be cut before every run of blanks and line ends, and pieces
    that start with one may be encoded as one long text in any order. Texts with other white space, or characters that some regular expressions take for
    it, are encoded whole. Pieces are kept in two generations of ``most``.
    """

    _OTHER = re.compile(r"[^\S \t\r\n]|[\u180e\u200b\ufeff]")
    _BLANKS = " \t\r\n"

    def __init__(self, definition: bytes, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(definition)
        # What looks like a special token inside a text is text.
        self.tokenizer.encode_special_tokens = True
        # A character of a token stands for one byte.
        self.bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])
        self.most, self.new, self.old = most, {}, {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> set[bytes]:
        """Encode new pieces: all that start with a blank and end otherwise as one text, cut again by the bytes that tokens stand for. Returns the pieces that cannot stand alone."""
        blank, odd, joint, alone = self._BLANKS.encode(), set(), [], []
        if self._OTHER.search(b"".join(pieces).decode("utf-8", "replace")):
            odd = {p for p in pieces if self._OTHER.search(p.decode("utf-8", "replace"))}
            pieces = [p for p in pieces if p not in odd]
        for p in pieces:
            (joint if p[0] in blank and p[-1] not in blank else alone).append(p)
        if joint:
            ids = np.frombuffer(self._ids([b"".join(joint).decode("utf-8", "replace")])[0], "<u4")
            reached, ends = np.append(0, np.cumsum(self.bytes[ids])), np.cumsum(np.fromiter(map(len, joint), np.int64, len(joint)))
            at = np.searchsorted(reached, ends)
            if reached[-1] == ends[-1] and (reached[at] == ends).all():
                data, stops = ids.tobytes(), (4 * at).tolist()
                self.new.update(zip(joint, [data[a:z] for a, z in zip([0, *stops[:-1]], stops, strict=True)], strict=True))
            else:
                alone += joint
        self.new.update(zip(alone, self._ids([p.decode("utf-8", "replace") for p in alone]), strict=True))
        return odd

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text (UTF-8, no nulls)."""
        texts = pa.concat_arrays([texts.cast(pa.large_binary())])
        bounds = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[:bounds[-1]]
        blank = np.isin(data, np.frombuffer(self._BLANKS.encode(), np.uint8))
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        first[:bounds[0]] = False
        starts = np.flatnonzero(first)
        offsets = np.append(starts, bounds[-1]).astype("<i8")
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        index, distinct = pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()

        found, odd = list(map(self.new.get, distinct)), set()
        missing = [p for p, ids in zip(distinct, found, strict=True) if ids is None]
        if missing:
            if len(self.new) + len(missing) > self.most:
                self.old, self.new, missing = self.new, {}, distinct
            self.new.update((p, self.old[p]) for p in missing if p in self.old)
            odd = self._learn([p for p in missing if p not in self.new])
            found = [self.new.get(p, b"") if ids is None else ids for p, ids in zip(distinct, found, strict=True)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        count = sizes[index]
        ends = np.append(0, np.cumsum(count))
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[index] - ends[:-1], count) + np.arange(ends[-1])]
        cuts = ends[np.searchsorted(starts, bounds)].tolist()
        out = [ids[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
        if odd:
            at = starts[np.isin(index, [i for i, p in enumerate(distinct) if p in odd])]
            for i in np.unique(np.searchsorted(bounds, at, "right") - 1).tolist():
                out[i] = np.frombuffer(self._ids([texts[i].as_py().decode("utf-8", "replace")])[0], "<u4")
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(fs, root: str) -> PieceEncoder:
    """The encoder of a folder's tokenizer; a worker keeps one for each definition."""
    if root not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with fs.open_input_stream(f"{root}/{TOKENIZER}") as f:
            definition = f.read()
        key = hashlib.sha256(definition).hexdigest()
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = PieceEncoder(definition)
        _ENCODERS[root] = _ENCODERS[key]
    return _ENCODERS[root]


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(TokenSource)
    return spark


def write_tokens(docs: DataFrame, path: str, definition: str, end: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text without special tokens, append ``end``, and write the ids to a new folder in ascending order of the id.

    ``definition`` is the path of a tokenizer's JSON file on the driver; a copy is put into the folder, from which the writing tasks take it. A null text is empty.
    Tied ids are ordered by a hash of the text, equal rows are written as often as they occur, null ids come last. Other columns are ignored; no rows give no files.

    Texts are shuffled once, by ranges of the id, and sorted inside each range; a range is encoded and written by one task, file after file.
    """
    register(docs.sparkSession)
    fs, root = place(path)
    fs.create_dir(root, recursive=True)
    if fs.get_file_info(f"{root}/{MANIFEST}").type != pyarrow.fs.FileType.NotFound:
        raise FileExistsError(f"{root} holds token files already")
    with open(definition, "rb") as f, fs.open_output_stream(f"{root}/{TOKENIZER}", compression=None) as out:
        out.write(f.read())
    rows = tagged(docs, id_col, text_col).repartitionByRange("id", "rid").sortWithinPartitions("id", "rid").select(untag("id").alias("doc_id"), "text")
    writer = rows.write.format("pfor").mode("append").option("path", path)
    (writer if end is None else writer.option("end", str(end))).save()


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """``doc_id, start`` (ids before the document in the whole folder), ``n_tokens`` and, unless left out, ``ids`` as little-endian unsigned 32-bit integers."""
    return register(spark).read.format("pfor").option("ids", str(ids).lower()).load(path)


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"

"""Token files in patched frame-of-reference blocks.

A file is a run of segments and a footer. A segment holds up to ``SEGMENT`` blocks of ``BLOCK``
ids (the last is filled with its smallest id): per block the minimum, the bit width, the number
of exceptions and its start in the packed words (the index), then the packed words of all
blocks, then the exceptions (position, high bits). The width of a block is the least that holds
the ``PERCENTILE`` of its differences from the minimum; the high bits of wider ones are stored
as exceptions. The footer has the documents (doc_id, number of ids), and where segments start.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.llm import textkernel as tk
from moiety.llm.bpe import Encoder, default_path
from moiety.llm.cluster import cut, folder, qualified, small_batches

BLOCK, SEGMENT, PERCENTILE = 128, 2048, 0.9
#: Bytes of text that a file holds, about.
FILE_BYTES = 64 << 20
MAGIC = b"PFORTOK1"
_U = np.uint64


def pack_blocks(ids: np.ndarray) -> bytes:
    """One segment."""
    n = len(ids)
    nb = -(-n // BLOCK)
    full = np.full(nb * BLOCK, ids[-1] if n else 0, np.uint64)
    full[:n] = ids
    v = full.reshape(nb, BLOCK)
    low = v.min(axis=1)
    v = v - low[:, None]
    bits = np.zeros(v.shape, np.uint8)
    for b in range(32):
        if not (more := v >= _U(1 << b)).any():
            break
        bits += more
    width = np.partition(bits, int(PERCENTILE * BLOCK) - 1, axis=1)[:, int(PERCENTILE * BLOCK) - 1].astype(np.int64)
    start = np.concatenate(([0], np.cumsum(2 * width))).astype(np.uint32)
    words = np.zeros(int(start[-1]), np.uint64)
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        x = v[rows] & _U((1 << int(w)) - 1)
        out = np.zeros((len(rows), 2 * int(w)), np.uint64)
        for j in range(BLOCK):
            at, shift = divmod(j * int(w), 64)
            out[:, at] |= x[:, j] << _U(shift)
            if shift + w > 64:
                out[:, at + 1] |= x[:, j] >> _U(64 - shift)
        words[start[rows].astype(np.int64)[:, None] + np.arange(2 * int(w))] = out
    high = v >> width.astype(np.uint64)[:, None]
    er, ep = np.nonzero(high)
    head = struct.pack("<IIII", n, nb, len(words), len(er))
    return b"".join((head, low.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), np.bincount(er, minlength=nb).astype("<u2").tobytes(), start[:-1].astype("<u4").tobytes(), words.astype("<u8").tobytes(), ep.astype(np.uint8).tobytes(), high[er, ep].astype("<u4").tobytes()))


def unpack_blocks(raw: bytes, a: int = 0, b: int | None = None) -> np.ndarray:
    """Ids a to b (all) of a segment; only the blocks that hold them are decoded."""
    n, nb, nw, ne = struct.unpack_from("<IIII", raw)
    b = n if b is None else min(b, n)
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(raw, kind, count, at)
        at += x.nbytes
        return x

    low, width, exceptions, start = take("<u4", nb), take("u1", nb), take("<u2", nb), take("<u4", nb)
    words, ep, eh = take("<u8", nw), take("u1", ne), take("<u4", ne)
    first, last = a // BLOCK, max(a // BLOCK, -(-b // BLOCK))
    skip, until = int(exceptions[:first].sum()), int(exceptions[:last].sum())
    low, width, exceptions, start, ep, eh = low[first:last], width[first:last], exceptions[first:last], start[first:last], ep[skip:until], eh[skip:until]
    v = np.zeros((last - first, BLOCK), np.uint64)
    for w in np.unique(width):
        if not w:
            continue
        w = int(w)
        rows = np.flatnonzero(width == w)
        x = words[start[rows].astype(np.int64)[:, None] + np.arange(2 * w)]
        own = np.empty((len(rows), BLOCK), np.uint64)
        for j in range(BLOCK):
            k, shift = divmod(j * w, 64)
            own[:, j] = x[:, k] >> _U(shift)
            if shift + w > 64:
                own[:, j] |= x[:, k + 1] << _U(64 - shift)
        v[rows] = own & _U((1 << w) - 1)
    er = np.repeat(np.arange(last - first), exceptions)
    v[er, ep] |= eh.astype(np.uint64) << width[er].astype(np.uint64)
    return (v + low[:, None]).reshape(-1)[a - first * BLOCK : b - first * BLOCK].astype(np.uint32)


class Writer:
    """Writes one file; it has its name only once it is whole."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.wait, self.waiting, self.starts, self.docs, self.counts = [], 0, [], [], []

    def add(self, names: list[int], ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append(np.array(names, np.int64))
        self.counts.append(np.asarray(counts, np.int64))
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= SEGMENT * BLOCK:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate(self.wait) if self.wait else np.zeros(0, np.uint32)
        size, i = SEGMENT * BLOCK, 0
        while len(ids) - i >= size or last and i < len(ids):
            self.starts.append(self.out.tell())
            self.out.write(pack_blocks(ids[i : i + size]))
            i += size
        self.wait = [ids[i:]]
        self.waiting = len(ids[i:])

    def close(self) -> tuple[int, int]:
        self._write(True)
        at = self.out.tell()
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, np.int64)
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        self.out.write(docs.astype("<i8").tobytes() + counts.astype("<i8").tobytes() + np.array(self.starts, "<i8").tobytes())
        self.out.write(struct.pack("<QQQ", at, len(docs), len(self.starts)) + MAGIC)
        self.out.close()
        self.fs.move(self.temp, self.path)
        return len(docs), int(counts.sum())


class Reader:
    """Random access by document and by segment, through the footer."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        at, nd, ns, magic = struct.unpack("<QQQ8s", self.file.read_at(32, size - 32))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        foot = self.file.read_at(size - 32 - at, at)
        self.docs, self.counts = np.frombuffer(foot, "<i8", nd), np.frombuffer(foot, "<i8", nd, 8 * nd)
        self.starts = np.append(np.frombuffer(foot, "<i8", ns, 16 * nd), at)
        self.before = np.concatenate(([0], np.cumsum(self.counts)))

    def segment(self, k: int, a: int = 0, b: int | None = None) -> np.ndarray:
        return unpack_blocks(self.file.read_at(int(self.starts[k + 1] - self.starts[k]), int(self.starts[k])), a, b)

    def ids(self, k: int) -> np.ndarray:
        """Ids of the document at place k."""
        a, b, size = int(self.before[k]), int(self.before[k + 1]), SEGMENT * BLOCK
        if a == b:
            return np.zeros(0, np.uint32)
        return np.concatenate([self.segment(s, max(0, a - s * size), min(size, b - s * size)) for s in range(a // size, (b - 1) // size + 1)])

    def documents(self) -> Iterator[tuple[int, int, int]]:
        """doc_id, number of ids and crc32 of each document, in order, a segment in memory at a time."""
        k, seg = 0, np.zeros(0, np.uint32)
        for name, n in zip(self.docs.tolist(), self.counts.tolist()):
            crc, need = 0, n
            while need:
                if not len(seg):
                    seg, k = self.segment(k), k + 1
                part, seg = seg[:need], seg[need:]
                crc, need = zlib.crc32(part.astype("<u4").tobytes(), crc), need - len(part)
            yield name, n, crc


def write(docs: DataFrame, uri: str, path: str | None = None, end_id: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode and write all texts in ascending doc_id order; one row a file: file, n_docs, n_tokens.

    A null text is empty. Rows without doc_id come first, as -2^63. An empty table writes no file
    with documents. Repeated ids keep all their rows, in the order of a hash of their texts, and may
    lie in several files. ``uri`` names its file system. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    path = path or default_path("byte_bpe_50k.json")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = Encoder.of(path), TaskContext.get().partitionId()
        writer = Writer(f"{uri}/part-{part:06d}.pfor")
        for batch in batches:
            data, offsets = tk.buffers(batch.column(1))
            names = batch.column(0).to_pylist()
            for i, j in tk.chunks(offsets):
                ids, before = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                writer.add(names[i:j], np.insert(ids, before[1:], end_id), np.diff(before) + 1)
        n, tokens = writer.close()
        yield pa.RecordBatch.from_pydict({"file": [part], "n_docs": [n], "n_tokens": [tokens]}, schema=pa.schema([("file", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), "text")
    size = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1), F.lit(0))).first()[0]
    tie = F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie")
    ordered = rows.select("doc_id", "text", tie).repartitionByRange(max(1, -(-size // file_bytes)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return cut(ordered.mapInArrow(scan, "file int, n_docs long, n_tokens long"))


def read(spark: SparkSession, uri: str, manifest: DataFrame) -> DataFrame:
    """What the files say of each document: doc_id, start, n_tokens, ids_crc32."""
    files, at = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["file"]):  # one row a file
        files.append((r["file"], at))
        at += r["n_tokens"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])
        for batch in batches:
            for part, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for name, n, crc in Reader(f"{uri}/part-{part:06d}.pfor").documents():
                    rows.append((None if name == -(2**63) else name, start, n, crc))
                    start += n
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    table = spark.createDataFrame(files, "file int, start long").repartition(max(1, len(files)), "file")
    return table.mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def roundtrip(docs: DataFrame, path: str | None = None, end_id: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``docs`` to a folder of the shared one, and read the files back."""
    uri = qualified(docs.sparkSession, folder(docs.sparkSession, "token-files"))
    return read(docs.sparkSession, uri, write(docs, uri, path, end_id, file_bytes))

"""Harmonic packing of token sequences.

A class k holds pieces of at most floor(capacity / k) ids, and each of its bins holds exactly k
of them. A document is first cut into full sequences; what remains is cut greedily into pieces
that fill their class's share exactly (1/k1 + 1/k2 + ...), so that full bins carry almost no
padding; only the last few ids of a document may fall short of their share. Each worker fills
its bins alone. Pieces left in bins that were not filled (fewer than the sum of k a worker) are
moved together by a hash, and filled the same way; what then remains in a group, a fixed number
at most, goes first-fit by falling length.

Defined results: a null or empty text is the end id alone; repeated rows are separate documents;
an empty table gives no pieces; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moiety.llm import textkernel as tk
from moiety.llm.bpe import Encoder, default_path
from moiety.llm.cluster import cut, small_batches

CLASSES = (*range(1, 17), 20, 24, 28, 32, 40, 48, 56, 64, 80, 96, 112, 128, 256)
#: Pieces that one task of the second round takes, about.
GROUP = 200_000
_COLUMNS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("k", pa.int32())]
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, k int"


@lru_cache(maxsize=None)
def shares(capacity: int) -> tuple[tuple[int, int], ...]:
    """(ids, k) by falling ids."""
    return tuple((capacity // k, k) for k in CLASSES if capacity // k)


@lru_cache(maxsize=1 << 16)
def divide(length: int, capacity: int) -> tuple[tuple[int, int], ...]:
    """Pieces (ids, k) of a remainder shorter than the capacity."""
    out, table = [], shares(capacity)
    while length:
        fit = next(((n, k) for n, k in table if n <= length), None)
        if fit is None:
            out.append((length, table[-1][1]))  # shorter than the smallest share: padded to it
            break
        out.append(fit)
        length -= fit[0]
    return tuple(out)


class Bins:
    """Open bins of one worker: per class, the pieces that wait for their bin to be full."""

    def __init__(self, first: int) -> None:
        self.open: dict[int, list[list]] = {}
        self.next = first

    def add(self, row: list, k: int) -> list[list]:
        """Rows of a bin that this piece filled, with sequence and offset."""
        wait = self.open.setdefault(k, [])
        wait.append(row)
        if len(wait) < k:
            return []
        del self.open[k]
        return self.close(wait)

    def close(self, rows: list[list]) -> list[list]:
        at = 0
        for r in rows:
            r[5], r[6] = self.next, at
            at += r[2]
        self.next += 1
        return rows

    def rest(self) -> list[list]:
        return [r for rows in self.open.values() for r in rows]


def first_fit(rows: list[list], capacity: int) -> list[list[list]]:
    bins: list[tuple[int, list[list]]] = []
    for r in sorted(rows, key=lambda r: -r[2]):
        for i, (room, own) in enumerate(bins):
            if r[2] <= room:
                own.append(r)
                bins[i] = (room - r[2], own)
                break
        else:
            bins.append((capacity - r[2], [r]))
    return [own for _, own in bins]


def _batch(rows: list[list], tokens: bool) -> pa.RecordBatch:
    schema = pa.schema(_COLUMNS + ([("tokens", pa.list_(pa.int32()))] if tokens else []))
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def pieces(docs: DataFrame, capacity: int, path: str, end_id: int, with_tokens: bool) -> DataFrame:
    """First round: every piece, with its sequence where a worker filled the bin."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, bins, out = Encoder.of(path), Bins(TaskContext.get().partitionId() << 32), []
        for batch in batches:
            data, offsets = tk.buffers(batch.column(1))
            names = batch.column(0).to_pylist()
            for i, j in tk.chunks(offsets):
                ids, before = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for r in range(j - i):
                    own = np.append(ids[before[r] : before[r + 1]], end_id).astype("<u4")
                    n, at = len(own), 0
                    full, left = divmod(n, capacity)
                    for size, k in (((capacity, 1),) * full + divide(left, capacity)):
                        part = own[at : at + size]
                        row = [names[i + r], at, len(part), zlib.crc32(part.tobytes()), n, None, None, k]
                        if with_tokens:
                            row.append(part.astype(np.int32))
                        out += bins.add(row, k)
                        at += size
                if len(out) >= 4000:
                    yield _batch(out, with_tokens)
                    out = []
        yield _batch(out + bins.rest(), with_tokens)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, _DDL + (", tokens array<int>" if with_tokens else ""))


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None, end_id: int = 1, with_tokens: bool = False) -> DataFrame:
    """One row per piece: where it comes from, its sequence and its offset there.

    ``path`` is a tokenizers file (word_bpe_49k.json of public_tokenizers if None). With
    ``with_tokens`` each piece carries its ids, and ``sequences`` can build the padded rows.
    """
    small_batches(docs.sparkSession)
    all_ = cut(pieces(docs, capacity, path or default_path("word_bpe_49k.json"), end_id, with_tokens))
    done = all_.filter(F.col("sequence_id").isNotNull())
    wait = all_.filter(F.col("sequence_id").isNull())
    groups = 1 + wait.count() // GROUP

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, out = Bins((1 << 62) | (TaskContext.get().partitionId() << 32)), []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out += bins.add(list(row), row[7])
            if len(out) >= 4000:
                yield _batch(out, with_tokens)
                out = []
        for own in first_fit(bins.rest(), capacity):
            out += bins.close(own)
        yield _batch(out, with_tokens)

    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int")
    second = wait.repartition(groups, key).sortWithinPartitions("k", "doc_id", "start").mapInArrow(again, all_.schema)
    return done.unionByName(second).drop("k")


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """Padded sequences of pieces that carry ids: sequence_id, used, tokens.

    A sequence is padded to the capacity, except where its ids are a power of two in number.
    """
    s = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.array_sort(F.collect_list(F.struct("offset", "tokens"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["tokens"]))
    power = F.bit_count(F.col("used")) == 1
    pad = F.when(power, F.lit(0)).otherwise(F.lit(capacity) - F.col("used")).cast("int")
    return s.select("sequence_id", "used", F.concat(ids, F.array_repeat(F.lit(pad_id), pad)).alias("tokens"))

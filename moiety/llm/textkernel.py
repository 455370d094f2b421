"""Vectorised byte kernels over Arrow string columns.

Word classes are byte classes: every UTF-8 byte of a non-ASCII character is >= 0x80, so a
regular expression over code points whose class holds either all or no non-ASCII characters
can be evaluated on bytes. Work goes on in blocks of about ``BLOCK`` bytes, so memory is
bounded by the Arrow batch and by the longest single word, not by the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | _U(1)
_P = _U(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, dtype=bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
ALNUM_RAW = ALNUM.copy()
ALNUM_RAW[0x41:0x5B] = True
NONSPACE = np.ones(256, dtype=bool)  # [^\x20\x09-\x0D]
NONSPACE[0x20] = False
NONSPACE[0x09:0x0E] = False


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on uint64 arrays."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    d = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[o[0] : o[-1]]
    return d, o - o[0]


def chunks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``most`` bytes (a longer text is alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes in ``keep`` that lie in one text: starts, ends, words before each text."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    m = keep[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a text starts here
    s = m.copy()
    s[1:] &= ~m[:-1] | first[1:-1]
    e = m.copy()
    e[:-1] &= ~m[1:] | first[1:-1]
    starts = np.flatnonzero(s)
    ends = np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = LOWER) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (not empty), after ``fold``."""
    n = len(starts)
    out = np.empty(n, np.uint64)
    if n == 0:
        return out
    lens = ends - starts
    total = np.concatenate(([0], np.cumsum(lens)))
    table = _BYTE if fold is None else _BYTE[fold]
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(total, total[i] + BLOCK, "right")) - 1))
        ln = lens[i:j]
        st = total[i:j] - total[i]
        pos = np.arange(total[j] - total[i]) - np.repeat(st, ln)
        b = data[pos + np.repeat(starts[i:j], ln)]
        pw = np.full(int(ln.max()), _P, np.uint64)
        pw[0] = 1
        np.multiply.accumulate(pw, out=pw)
        out[i:j] = np.add.reduceat(table[b] * pw[pos], st)
        i = j
    return mix(out + lens.astype(np.uint64))


def text_of(data: np.ndarray, start: int, end: int) -> bytes:
    return data[start:end].tobytes()

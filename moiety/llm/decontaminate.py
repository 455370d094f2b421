"""Benchmark decontamination with a generalised suffix automaton.

The automaton accepts every substring of every item's word sequence. A document's words are
streamed through it, giving at each word the longest suffix that is a substring of an item.
Words and word pairs that no item holds break the stream, so only runs of item pairs are
walked; numpy finds these runs. Items of more than ``MAX_ITEM_BYTES`` in all are spread over several
automata by a hash; texts pass them one after another, and spans and items are united.

Defined results: a null or empty text has no words, no hits and is not contaminated; items
without words match nothing; repeated rows give repeated results; an empty documents table
gives an empty result and an empty benchmark gives no hits. Extra columns are not read, and
their names cannot clash, as only doc_id and text (item_id and text) are selected.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from moiety.llm import textkernel as tk
from moiety.llm.cluster import cut, small_batches

WINDOW = 8
#: An automaton travels to every executor (some 80 bytes for each byte of item text): it holds about this much text at most.
MAX_ITEM_BYTES = 8 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(tk.LOWER)
REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>, coverage double"


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_FOLD))


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word numbers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]

    def _clone(self, p: int, c: int, q: int, length: int) -> int:
        k = len(self.next)
        self.next.append(dict(self.next[q]))
        self.len.append(length)
        self.link.append(self.link[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        self.link[q] = k
        return k

    def add(self, sequence: Iterable[int]) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q, self.len[last] + 1)
                continue
            cur = len(self.next)
            self.next.append({})
            self.len.append(self.len[last] + 1)
            self.link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q, self.len[p] + 1)
            last = cur

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """The state and length of the longest suffix that is a substring, after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        q = self.next[state].get(c)
        return (0, 0) if q is None else (q, length + 1)


@dataclass
class Index:
    """The automaton, the vocabulary, and which items own each window."""

    automaton: SuffixAutomaton
    vocabulary: dict[bytes, int]
    windows: dict[tuple[int, ...], tuple[int, ...]]
    sizes: tuple[int, ...]
    words: np.ndarray  # sorted hashes of the vocabulary
    pairs: np.ndarray  # sorted hashes of adjacent pairs
    window: int

    @classmethod
    def build(cls, items: Iterable[tuple[int, str | None]], window: int = WINDOW) -> Index:
        automaton, vocabulary, windows = SuffixAutomaton(), {}, {}
        for item, text in items:
            seq = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
            if not seq or item is None:
                continue
            automaton.add(seq)
            size = min(window, len(seq))
            for i in range(len(seq) - size + 1):
                windows.setdefault(tuple(seq[i : i + size]), set()).add(item)
        names = list(vocabulary)
        blob = np.frombuffer(b"".join(names) or b"", np.uint8)
        ends = np.cumsum([len(x) for x in names]).astype(np.int64)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if names else ends
        h = tk.hash_spans(blob, starts, ends)
        ab = np.array([(w[i], w[i + 1]) for w in windows for i in range(len(w) - 1)], np.int64).reshape(-1, 2)
        pairs = np.unique(pair_hash(h[ab[:, 0]], h[ab[:, 1]])) if len(ab) else np.zeros(0, np.uint64)
        return cls(automaton, vocabulary, {k: tuple(sorted(v)) for k, v in windows.items()}, tuple(sorted({len(k) for k in windows}, reverse=True)), np.sort(h), pairs, window)

    def walk(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (word positions, half open) and items of a run of words."""
        a, state, length, hits, items = self.automaton, 0, 0, [], set()
        ids = [self.vocabulary.get(w, -1) for w in words]
        for i, c in enumerate(ids):
            state, length = a.step(state, length, c)
            for size in self.sizes:
                if size <= length and (own := self.windows.get(tuple(ids[i + 1 - size : i + 1]))):
                    items.update(own)
                    if hits and hits[-1][1] >= i + 1 - size:
                        lo = i + 1 - size
                        while hits and hits[-1][1] >= lo:
                            lo = min(lo, hits.pop()[0])
                        hits.append((lo, i + 1))
                    else:
                        hits.append((i + 1 - size, i + 1))
        return hits, items


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tk.mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == x


class _Filter:
    """Membership by a bitmap of 2^22 slots first; only what it lets through is searched."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.bits = keys, np.zeros(1 << 22, bool)
        self.bits[(keys >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = self.bits[(x >> np.uint64(42)).astype(np.int64)]
        at = np.flatnonzero(out)
        out[at] = member(self.keys, x[at])
        return out


def matches(index: Index, data: np.ndarray, offsets: np.ndarray, filters: tuple) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[int, int]], set[int]]]:
    """For each text: its number of words, their starts and ends, hit spans and items."""
    starts, ends, before = tk.spans(data, offsets, tk.ALNUM_RAW)
    n = len(starts)
    h = tk.hash_spans(data, starts, ends)
    known, pair = filters
    least = min(index.sizes, default=0)
    good = np.zeros(n + 1, bool)  # good[i]: words i-1 and i are an item pair of one text
    if n > 1 and len(index.pairs):
        good[1:n] = pair(pair_hash(h[:-1], h[1:]))
    good[before] = False  # a text's first word has no pair
    edge = np.diff(good.astype(np.int8), prepend=np.int8(0))
    lo, hi = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1)
    lo, hi = lo[: len(hi)], hi
    long = hi - lo >= max(2, least)
    runs = list(zip(lo[long].tolist(), hi[long].tolist()))
    if least == 1:  # items of one word: words in no run can match too
        ones = np.flatnonzero(known(h))
        runs += [(int(i), int(i) + 1) for i in ones]
    runs.sort()
    row_of = np.searchsorted(before, [r[0] for r in runs], "right") - 1
    found: dict[int, tuple[list, set]] = {}
    for row, (a, b) in zip(row_of.tolist(), runs):
        words = [tk.text_of(data, s, e).translate(_FOLD) for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
        hits, items = index.walk(words)
        if hits:
            base = int(before[row])
            own = found.setdefault(row, ([], set()))
            own[0].extend((x + a - base, y + a - base) for x, y in hits)
            own[1].update(items)
    for row in range(len(offsets) - 1):
        hits, items = found.get(row, ((), ()))
        yield row, starts[before[row] : before[row + 1]], ends[before[row] : before[row + 1]], merged(hits), set(items)


def merged(hits: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _parts(benchmark: DataFrame) -> list[DataFrame]:
    """The items in parts of bounded size, by a hash; each is collected by itself."""
    own = benchmark.select("item_id", "text")
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= MAX_ITEM_BYTES:
        return [own]
    parts = -(-2 * size // MAX_ITEM_BYTES)
    return [own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _over(rows: DataFrame, benchmark: DataFrame, window: int, finish, schema: StructType) -> DataFrame:
    """Stream texts through the automata; ``finish`` makes the output of a batch.

    It gets the batch, the texts' bytes and offsets, and per text its words' starts and ends, merged
    spans and items (as strings). Between two automata, rows are kept with what was found so far.
    """
    spark = rows.sparkSession
    small_batches(spark)
    at, width = rows.columns.index("text"), len(rows.columns)
    between = StructType([*rows.schema.fields, *_parse_datatype_string("_spans array<struct<start:long,end:long>>, _items array<string>").fields])
    parts, out = _parts(benchmark), rows
    for k, part in enumerate(parts):
        shared = spark.sparkContext.broadcast(Index.build([(r[0], r[1]) for r in part.collect()], window))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, again=k > 0, last=k == len(parts) - 1) -> Iterator[pa.RecordBatch]:
            index = shared.value
            filters = _Filter(index.words), _Filter(index.pairs)
            for batch in batches:
                data, offsets = tk.buffers(batch.column(at))
                for i, j in tk.chunks(offsets):
                    own, here = batch.slice(i, j - i), (data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    found = [(starts, ends, hits, {*map(str, items)}) for _, starts, ends, hits, items in matches(index, *here, filters)]
                    if again:
                        before = zip(own.column(width).to_pylist(), own.column(width + 1).to_pylist())
                        found = [(s, e, merged([*h, *((x["start"], x["end"]) for x in spans)]), {*it, *items}) for (s, e, h, it), (spans, items) in zip(found, before)]
                    own = pa.RecordBatch.from_arrays(own.columns[:width], names=own.schema.names[:width])
                    if last:
                        yield finish(own, *here, found)
                    else:
                        spans = pa.array([[{"start": a, "end": b} for a, b in h] for _, _, h, _ in found], _SPANS)
                        yield pa.RecordBatch.from_arrays([*own.columns, spans, pa.array([sorted(it) for *_, it in found], pa.list_(pa.string()))], names=[*own.schema.names, "_spans", "_items"])

        out = (cut(out) if k else out).mapInArrow(scan, schema if k == len(parts) - 1 else between)
    return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: counts, items, and the merged hit spans in words."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", _SPANS), ("coverage", pa.float64())])

    def report(own: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, found: list) -> pa.RecordBatch:
        rows = []
        for starts, _, hits, items in found:
            hit = sum(b - a for a, b in hits)
            rows.append((len(starts), hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2, [{"start": a, "end": b} for a, b in hits], hit / len(starts) if len(starts) else 0.0))
        return pa.RecordBatch.from_arrays([own.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:]))], schema=schema)

    return _over(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window, report, _parse_datatype_string(REPORT))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = 2, max_coverage: float = 0.8) -> DataFrame:
    """``docs`` without matched spans of ``min_words`` words or more.

    Spans are of ``window`` words at least, or a whole item of fewer. A document more than
    ``max_coverage`` of whose words are hit goes as a whole. A removed span leaves one space.
    n_chars, where it is a column, becomes the new length of a changed text. All columns stay. A
    null text stays null.
    """
    at = docs.columns.index("text")

    def rest(own: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, found: list) -> pa.RecordBatch:
        texts, keep, changed = own.column(at).to_pylist(), [], {}
        for row, (starts, ends, hits, _) in enumerate(found):
            hit = sum(b - a for a, b in hits)
            if hit and hit > max_coverage * len(starts):
                continue
            keep.append(row)
            spans = [(int(starts[a]), int(ends[b - 1])) for a, b in hits if b - a >= min_words]
            if spans:
                pieces, p = [], int(offsets[row])
                for a, b in spans:
                    pieces.append(data[p:a].tobytes())
                    p = b
                pieces.append(data[p : offsets[row + 1]].tobytes())
                changed[row] = b" ".join(pieces).decode()
        out = []
        for k, name in enumerate(own.schema.names):
            col = own.column(k)
            if changed and k == at:
                col = pa.array([changed.get(r, t) for r, t in enumerate(texts)], col.type)
            elif changed and name == "n_chars":
                col = pa.array([len(changed[r]) if r in changed else v for r, v in enumerate(col.to_pylist())], col.type)
            out.append(col)
        return pa.RecordBatch.from_arrays(out, schema=own.schema).take(pa.array(keep, pa.int64()))

    return _over(docs, benchmark, window, rest, docs.schema)

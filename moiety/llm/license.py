"""License scans: shared words or word runs pick candidates, banded alignment confirms them.

Templates and documents are words (letters, digits and non-ASCII bytes, A-Z lower-cased). Each
run of ``GRAM`` words is hashed; an inverted index maps a template's hashes to (template, place).
A document's hashes that it holds are seeds; a banded alignment of the template against the words
around each seed (longest common subsequence, at most ``BAND`` words off its diagonal) gives the
matched share of the template and the span in the document.

How a template is looked up depends on what its least coverage leaves whole: if e of n words may be
lost, some run of (n - e) / (e + 1) words stays. Templates of up to ``SHORT`` words, and those whose
run is shorter than GRAM, are looked up by every word, so no match can be missed. The others are
looked up by all word runs of the document, or, where the run is of GRAM + WINDOW - 1 words at
least, by its winnowed ones (of every ``WINDOW`` neighbouring hashes the least is kept, the last of
equal ones); a match of these is found unless words added to the document break every such run.

Defined results: null and empty texts match nothing; templates without words are left out, those
shorter than GRAM words are one hash; several places in a document are separate rows; of matches
that overlap, the one of largest coverage stays (then most words, then the one that ends first and is shortest), and
the words left on both sides are searched again, so adjacent copies are separate rows; repeated rows get equal results; an empty table gives
an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moiety.llm import textkernel as tk
from moiety.llm.cluster import small_batches
from moiety.llm.decontaminate import member, words_of

GRAM, WINDOW, BAND, MIN_COVERAGE = 3, 3, 8, 0.8
#: Templates of at most so many words are looked up by each of their words.
SHORT = 16
MAX_TEMPLATE_BYTES = 4 << 20
#: Short notices; any other templates can be passed.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("mpl-2.0", "Released under the Mozilla Public License, Version 2.0."),
    ("cc0-1.0", "Dedicated to the public domain under CC0 1.0."),
)
#: Full texts and standard headers of licenses, <name>.text and <name>.header.
FILES = Path(__file__).parent / "licenses"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("template", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())])


def standard(kind: str) -> tuple[tuple[str, str], ...]:
    """(name-kind, text) of the files of a kind, text or header."""
    return tuple((f"{p.stem}-{kind}", p.read_text(encoding="utf-8")) for p in sorted(FILES.glob(f"*.{kind}")))


def grams(h: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hash of each run of n word hashes; of all words where there are fewer."""
    n = min(n, len(h))
    if not n:
        return np.zeros(0, np.uint64)
    g = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        g = tk.mix(g * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return g


def winnow(g: np.ndarray, w: int = WINDOW) -> np.ndarray:
    """Places kept: the least of every w neighbours, the last of equal ones."""
    if len(g) <= w:
        return np.array([len(g) - 1 - int(np.argmin(g[::-1]))]) if len(g) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, w)
    return np.unique(np.arange(len(view)) + w - 1 - view[:, ::-1].argmin(axis=1))


def align(template: list, words: list, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Matched words, and the first and last matched place in ``words``.

    A longest common subsequence in which word j of the template meets only words within
    ``band`` of j + shift. Of equally long ones the one that ends first and is shortest.
    """
    best = (0, 0, 0)  # matched, -last, first
    row: dict[int, tuple[int, int]] = {}  # place -> (matched, first), the shortest of the longest up to there
    for j, t in enumerate(template):
        new: dict[int, tuple[int, int]] = {}
        lo, hi = max(0, j + shift - band), min(len(words), j + shift + band + 1)
        for i in range(lo, hi):
            value = max(row.get(i, (0, 0)), new.get(i - 1, (0, 0)))
            if words[i] == t:
                diagonal = row.get(i - 1)
                take = (diagonal[0] + 1, diagonal[1]) if diagonal else (1, i)
                value, best = max(value, take), max(best, (take[0], -i, take[1]))
            if value[0]:
                new[i] = value
        row = new
    return best[0], best[2], -best[1]


def _hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(x) for x in words])
    return tk.hash_spans(np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], ends[:-1])), ends)


def bound(template: np.ndarray, h: np.ndarray, shift: int, band: int) -> int:
    """Words of the template with an equal one in the band: no fewer than can be aligned."""
    some = np.zeros(len(template), bool)
    for d in range(shift - band, shift + band + 1):
        a, b = max(0, -d), min(len(template), len(h) - d)
        if b > a:
            some[a:b] |= template[a:b] == h[a + d : b + d]
    return int(np.count_nonzero(some))


class Index:
    def __init__(self, templates: list[tuple[str, str]]) -> None:
        self.names, self.words = [], []
        post: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, text in templates:
            words = words_of(text)
            if not words:
                continue
            g = grams(_hashes(words)) if len(words) > SHORT else ()
            # every hash of a template is indexed, so that its ends cannot hide the one a document keeps
            for p in range(len(g)):
                post[int(g[p])].append((len(self.names), p))
            self.names.append(name)
            self.words.append(words)
        self.post = dict(post)
        self.keys = np.array(sorted(post), np.uint64)
        #: of equal matches of several templates, the last name stays
        self.rank = [sorted(set(self.names), reverse=True).index(x) for x in self.names]
        self.hashes = [_hashes(w) for w in self.words]
        self._made: dict[float, tuple] = {}

    def lookup(self, min_coverage: float) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray, set[int]]:
        """Words of the templates looked up by word, the templates of each and how often they hold it, the words
        each template needs, and the templates looked up by winnowed runs."""
        if min_coverage not in self._made:
            need = np.array([max(1, math.ceil(min_coverage * len(w) - 1e-9)) for w in self.words], np.int64)
            run = [-(-n // (len(w) - n + 1)) if n <= len(w) else len(w) for n, w in zip(need.tolist(), self.words)]
            post: dict[int, dict[int, int]] = defaultdict(dict)
            for t, w in enumerate(self.hashes):
                if len(w) <= SHORT or run[t] < GRAM:
                    for x in w.tolist():
                        post[x][t] = post[x].get(t, 0) + 1
            keys = np.array(sorted(post), np.uint64)
            self._made[min_coverage] = keys, [np.array([*post[int(x)]]) for x in keys], [np.array([*post[int(x)].values()]) for x in keys], need, {t for t, w in enumerate(self.words) if len(w) > SHORT and run[t] >= GRAM + WINDOW - 1}
        return self._made[min_coverage]

    def _by_word(self, h: np.ndarray, min_coverage: float, band: int) -> Iterator[tuple[int, list[int]]]:
        """(template, diagonals) where a document has enough of a template's words together."""
        keys, of, times, need, _ = self.lookup(min_coverage)
        hit = np.flatnonzero(member(keys, h))
        if not len(hit):
            return
        which = np.searchsorted(keys, h[hit])
        held, count = np.unique(which, return_counts=True)
        total = np.zeros(len(self.words), np.int64)
        for k, n in zip(held.tolist(), count.tolist()):
            total[of[k]] += np.minimum(times[k], n)
        for t in np.flatnonzero((total > 0) & (total >= need)).tolist():
            own = self.hashes[t]
            places = {x: hit[h[hit] == np.uint64(x)] for x in set(own.tolist())}
            shifts = np.unique(np.concatenate([places[x] - q for q, x in enumerate(own.tolist())]))
            lo, hi = shifts - band, shifts + len(own) + band
            # at most so many words can match between lo and hi
            most = sum(np.minimum(np.searchsorted(p, hi) - np.searchsorted(p, lo), np.count_nonzero(own == np.uint64(x))) for x, p in places.items())
            yield t, shifts[most >= need[t]].tolist()

    def scan(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, min_coverage: float, band: int) -> list[tuple]:
        """Matches in one document, given its word spans and hashes."""
        seeds: dict[int, set[int]] = defaultdict(set)
        for t, shifts in self._by_word(h, min_coverage, band):
            seeds[t].update(shifts)
        _, _, _, need, sparse = self.lookup(min_coverage)
        g = grams(h) if len(h) >= GRAM else np.zeros(0, np.uint64)
        kept = set(winnow(g).tolist()) if sparse else set()
        for p in np.flatnonzero(member(self.keys, g)).tolist():
            for t, q in self.post[int(g[p])]:
                if p in kept or t not in sparse:
                    seeds[t].add(p - q)
        heap: list[tuple] = []
        done: set[tuple] = set()

        def push(t: int, shift: int, lo: int, hi: int) -> None:
            """The best match of a template on one diagonal within some words."""
            n = len(self.words[t])
            lo, hi = max(lo, shift - band, 0), min(hi, shift + n + band, len(h))
            if hi <= lo or hi - lo < min_coverage * n or (t, shift, lo, hi) in done:
                return
            done.add((t, shift, lo, hi))
            words = [tk.text_of(data, a, b).lower() for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
            matched, a, b = align(self.words[t], words, shift - lo, band)
            if matched and matched >= min_coverage * n:
                heapq.heappush(heap, (-matched / n, -matched, b + lo + 1, -(a + lo), self.rank[t], t, shift, lo, hi))

        for t, shifts in seeds.items():
            if len(h) >= need[t]:
                # words of the template up to each place: a diagonal with too few around it holds no match
                some = np.concatenate(([0], np.cumsum(member(np.unique(self.hashes[t]), h))))
                for shift in shifts:
                    if some[min(len(h), max(0, shift + len(self.words[t]) + band))] - some[max(0, shift - band)] >= need[t] and bound(self.hashes[t], h, shift, band) >= need[t]:
                        push(t, shift, 0, len(h))
        taken: list[tuple[int, int]] = []
        best = []
        while heap:
            _, matched, b, a, _, t, shift, lo, hi = heapq.heappop(heap)
            a, n = -a, len(self.words[t])
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                best.append((self.names[t], -matched / n, -matched, a, b, int(starts[a]), int(ends[b - 1])))
            # what is free of the candidate's words may hold another match
            for x, y in sorted(v for v in taken if v[0] < hi and v[1] > lo):
                push(t, shift, lo, x)
                lo = y
            push(t, shift, lo, hi)
        return best


def scan(docs: DataFrame, templates: tuple | list | DataFrame = NOTICES, min_coverage: float = MIN_COVERAGE, band: int = BAND, apart: tuple = ()) -> DataFrame:
    """One row per template found in a document: coverage, matched words, span in words and bytes.

    ``apart`` holds further lists of pairs; each is scanned for in the same pass, and its matches are
    held against each other only, so that a header does not hide the full text that quotes it.

    ``templates`` are (name, text) pairs or a DataFrame with these columns, collected behind a
    check of their size.
    """
    if isinstance(templates, DataFrame):
        size = templates.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        if size > MAX_TEMPLATE_BYTES:
            raise ValueError(f"templates hold {size} bytes; {MAX_TEMPLATE_BYTES} fit on every executor")
        templates = [(r[0], r[1]) for r in templates.select("name", "text").collect()]
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast([Index(list(x)) for x in (templates, *apart)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = shared.value
        keys = np.unique(np.concatenate([x.keys for x in indexes]))
        words = np.unique(np.concatenate([x.lookup(min_coverage)[0] for x in indexes]))
        for batch in batches:
            data, offsets = tk.buffers(batch.column(1))
            names = batch.column(0).to_pylist()
            rows = []
            for i, j in tk.chunks(offsets):
                part = data[offsets[i] : offsets[j]]
                starts, ends, before = tk.spans(part, offsets[i : j + 1] - offsets[i], tk.ALNUM_RAW)
                h = tk.hash_spans(part, starts, ends)
                # texts with no indexed hash at all are passed by
                g = grams(h) if len(h) >= GRAM else np.zeros(0, np.uint64)
                some = member(words, h)
                some[: len(g)] |= member(keys, g)
                some = np.concatenate(([0], np.cumsum(some)))
                for r in range(j - i):
                    a, b = before[r], before[r + 1]
                    if some[b] > some[a]:
                        base = int(offsets[i + r] - offsets[i])
                        rows += [(names[i + r], *x[:5], x[5] - base, x[6] - base) for index in indexes for x in index.scan(part, starts[a:b], ends[a:b], h[a:b], min_coverage, band)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_SCHEMA), _SCHEMA)], schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, template string, coverage double, matched long, start_word long, end_word long, start_byte long, end_byte long")

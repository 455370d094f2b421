"""Toxicity by compression distance.

Two zstandard dictionaries (of SIZE bytes, or of all windows where these are fewer) are trained: one on windows of ordinary texts, one on
windows of toxic texts. A window is ``WINDOW`` folded words. Its distance is the difference of its two
compressed lengths, over the bytes that a whole match would save; it runs from -1 (only the
ordinary dictionary knows it) to 1 (only the toxic one does).

Most windows of a toxic text are ordinary. So the toxic dictionary is trained again in ``ROUNDS``
on those windows of toxic texts that dictionaries of the *other* labelled texts already find
nearer to toxic (at a distance ``LIFT`` times as frequent there as in ordinary texts).

How likely each distance is in toxic and in ordinary texts gives a log likelihood ratio per
window; the sum and mean of a text's distinct windows and their number enter a logistic model. Ratios and
model are fitted on texts that the dictionaries haven't seen, and weighted to the share of toxic
rows in all labelled ones: 0.5 is the calibrated threshold.

Defined results: a null or empty text has no window and gets the score of one without a toxic
window; with no labelled row of a class the score is the share of toxic ones (0 with none); with
one row of a class nothing can be held back, and the model is fitted on what it learnt from;
repeated rows get equal scores; an empty table gives an empty result. Columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moiety.llm import textkernel as tk
from moiety.llm.cluster import small_batches
from moiety.llm.neardup import shingle_sets
from moiety.llm.sample import PER_CLASS, draw

WINDOW, MAX_WINDOW = 1, 400
SIZE, FOLDS, ROUNDS, LIFT = 131_072, 4, 2, 3.0
BINS = 21  # distances from -1 to 1
#: Windows whose distance a worker remembers; words come back, so most are not compressed twice.
REMEMBER = 200_000

#: Begins every window and ends both dictionaries (bytes that no text holds in this order): without a sure
#: match zstandard would store short windows as they are, and the two lengths would tell nothing.
MARK = bytes(range(0x80, 0xA0)) + bytes(range(0x01, 0x08)) + b" "
#: Ends every window: zstandard looks for no match in the last eight bytes.
TAIL = bytes(range(0xF5, 0xFD))


def windows(raw: bytes, n: int = WINDOW) -> list[bytes]:
    """The distinct windows of n folded words, spaces around; none longer than MAX_WINDOW bytes."""
    words = _folded(raw).tobytes().split()
    if n > 1:
        words = [b" ".join(words[i : i + n]) for i in range(0, len(words), n)]
    out = []
    for w in dict.fromkeys(words):
        out += [b" " + w + b" "] if len(w) <= MAX_WINDOW else [b" " + w[k : k + MAX_WINDOW] + b" " for k in range(0, len(w), MAX_WINDOW)]
    return out


_FOLD = tk.LOWER.copy()
_FOLD[~tk.ALNUM & ~tk.ALNUM_RAW] = 32


def _folded(raw: bytes) -> np.ndarray:
    """Bytes with A-Z lower-cased and all but letters, digits and non-ASCII bytes as spaces."""
    return _FOLD[np.frombuffer(b" " + raw + b" ", np.uint8)]


def _copies(sets: list[np.ndarray]) -> np.ndarray:
    """Texts most of whose shingles are those of one earlier text (near copies)."""
    seen: dict[int, list[int]] = {}
    out = np.zeros(len(sets), bool)
    for i, g in enumerate(sets):
        own = g.tolist()
        met = Counter(k for x in own for k in seen.get(x, ()))
        out[i] = len(own) > 3 and 2 * max(met.values(), default=0) > len(own)
        if not out[i]:
            for x in own:
                seen.setdefault(x, []).append(i)
    return out


def _train(samples: list[bytes], size: int = SIZE) -> bytes:
    """What zstandard's trainer picks of the samples; where all fit in, the distinct ones, frequent ones last."""
    count = Counter(samples)
    if sum(map(len, count)) <= size:
        return b"".join(x for x, _ in reversed(count.most_common()))
    return zstandard.train_dictionary(size, [samples[i] for i in np.random.default_rng(1).permutation(len(samples))], k=32, d=6, level=3).as_bytes()


def _distances(ordinary: bytes, toxic: bytes):
    """A function from a text's bytes to its windows and their distances (0 to BINS - 1)."""
    make = lambda d: zstandard.ZstdCompressor(compression_params=_parameters(), dict_data=zstandard.ZstdCompressionDict(d + MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress
    by_ordinary, by_toxic = make(ordinary), make(toxic)
    known: dict[bytes, int] = {}
    half = BINS // 2

    def find(own: list[bytes]) -> np.ndarray:
        out = []
        for w in own:
            d = known.get(w)
            if d is None:
                if len(known) >= REMEMBER:
                    known.clear()
                x = MARK + w + TAIL
                d = known[w] = half + max(-half, min(half, round(half * (len(by_ordinary(x)) - len(by_toxic(x))) / max(1, len(w) - 3))))
            out.append(d)
        return np.array(out, np.int64)

    return find


@dataclass
class Model:
    """Dictionary contents, logistic weights; the share of toxic rows where nothing was learnt."""

    share: float
    ordinary: bytes = b""
    toxic: bytes = b""
    ratios: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def extractor(self):
        """A function from a text's bytes to its histogram of distances."""
        find = _distances(self.ordinary, self.toxic)
        return lambda raw: np.bincount(find(windows(raw)), minlength=BINS)

    def scorer(self):
        if not len(self.weights):
            return lambda raw: self.share
        find, w = self.extractor(), self.weights
        return lambda raw: 1 / (1 + math.exp(-max(-30.0, min(30.0, float(features(find(raw), self.ratios) @ w)))))


def _parameters():
    """Matches of 5 bytes and more only: shorter ones are chance, and drown what the words tell."""
    return zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTLAZY2, min_match=5, window_log=18, hash_log=17, chain_log=18, search_log=7, target_length=64, write_content_size=False, write_dict_id=False, write_checksum=False)


def features(histogram: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """1, the log likelihood ratio of all windows (and of the mean one), the log of their number."""
    n = int(histogram.sum())
    total = float(histogram @ ratios)
    return np.array([1.0, max(-4.0, min(4.0, total / 5)), total / max(1, n) * 10, math.log1p(n) / 4])


def window_ratios(histograms: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log ratio of each distance's share in windows of toxic and of ordinary texts; texts weigh by their root length."""
    n = np.maximum(1, histograms.sum(axis=1, keepdims=True))
    share = [(h / np.sqrt(m)).sum(axis=0) for h, m in ((histograms[y == v], n[y == v]) for v in (0, 1))]
    low, high = ((x + 0.5) / (x + 0.5).sum() for x in share)
    return np.log(high / low)


def _nearer_to_toxic(toxic: np.ndarray, ordinary: np.ndarray) -> int:
    """The least distance from which windows are LIFT times as frequent in toxic texts as in ordinary ones."""
    for at in range(BINS // 4, BINS):
        p, q = (toxic >= at).mean() if len(toxic) else 0.0, (ordinary >= at).mean() if len(ordinary) else 0.0
        if p > LIFT * q:
            return at
    return BINS - 1


def fit(rows: list[tuple[str, int]], share: float) -> Model:
    """Learn from (text, label) rows; ``share`` of all labelled rows are toxic.

    Texts are in FOLDS parts; each part is judged by dictionaries trained on the others.
    """
    texts, y = [(t or "").encode() for t, _ in rows], np.array([v for _, v in rows])
    if not (y == 0).any() or not (y == 1).any():
        return Model(share)
    shingles, before = shingle_sets(*tk.buffers(pa.array(texts, pa.binary())), 3)
    copy = np.zeros(len(y), bool)
    for v in (0, 1):
        i = np.flatnonzero(y == v)
        copy[i] = _copies([shingles[before[k] : before[k + 1]] for k in i])
    texts, y = [t for t, c in zip(texts, copy) if not c], y[~copy]
    folds = max(1, min(FOLDS, (y == 0).sum(), (y == 1).sum()))
    part = np.zeros(len(y), np.int64)
    for v in (0, 1):
        part[y == v] = np.arange((y == v).sum()) % folds
    own = [windows(t) for t in texts]
    picked = list(own)  # the windows that a text gives to its class's dictionary

    def trained(v: int, out_of: int | None) -> bytes:
        return _train([w for k in np.flatnonzero((y == v) & ((part != out_of) | (folds == 1))) for w in picked[k]])

    ordinary = [trained(0, f) for f in range(folds)]
    for r in range(ROUNDS):
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(y)
        for f in range(folds):
            find = _distances(ordinary[f], trained(1, f))
            for k in np.flatnonzero(part == f):
                found[k] = find(own[k])
        if r < ROUNDS - 1:
            at = _nearer_to_toxic(*(np.concatenate([found[k] for k in np.flatnonzero(y == v)]) for v in (1, 0)))
            for k in np.flatnonzero(y == 1):
                picked[k] = [w for w, d in zip(own[k], found[k].tolist()) if d >= at]
    histograms, v = np.array([np.bincount(d, minlength=BINS) for d in found]), y.astype(float)
    ratios = window_ratios(histograms, v)
    x = np.array([features(h, ratios) for h in histograms])
    weight = np.where(v == 1, share / (v == 1).sum(), (1 - share) / (v == 0).sum()) * len(v)
    return Model(share, trained(0, None), trained(1, None), ratios, logistic(x, v, weight))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Newton steps for a weighted logistic regression with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = np.full(len(w), ridge)
        pull[0] = 0
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (weight * (p - y)) + pull * w)
        size = np.abs(step).max()
        w -= step * min(1.0, 5 / max(size, 1e-9))
        if size < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, keep: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Fit on a bounded sample of labelled rows; ``keep`` says which ids may be learnt from."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter("label IN (0, 1)")
    if keep is not None:
        rows = rows.filter(keep)
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    return fit(draw(rows, docs, per_class), toxic / n if n else 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.scorer()
        for batch in batches:
            data, offsets = tk.buffers(batch.column(1))
            s = np.array([own(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score at or above the threshold. All columns stay."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.scorer()
        for batch in batches:
            data, offsets = tk.buffers(batch.column(at))
            keep = [i for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())) if own(data[a:b].tobytes()) < threshold]
            yield batch.take(pa.array(keep, pa.int64()))

    return docs.mapInArrow(scan, docs.schema)

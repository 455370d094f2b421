"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are UTF-8 byte n-grams (2, 3, 4) of the text with A-Z lower-cased and all but letters
and non-ASCII bytes as spaces, runs of spaces aside. Each hashes to one of ``BUCKETS``
embeddings; a text is their average, and a linear softmax over it gives the languages. Both
layers are trained by stochastic gradient descent in numpy on excerpts of several lengths of a
bounded sample. As the average and the linear layer commute, prediction needs one table of
bucket x language logits. A temperature fitted on whole held-back texts calibrates the scores.

A text of a language that was not learnt, or of none, gets small logits whichever is the largest:
its energy (the log of the sum of the exponentials of all logits) is low. Texts whose energy is
below that of all but ``REJECT`` of the correctly named held-back texts are rejected.

Defined results: a text that is null or has no letter is ``und`` with score 0; a text with
letters too short for any n-gram gets the most frequent language; with nothing learnt every text
is ``und``; repeated rows get equal results; an empty table gives an empty result. Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moiety.llm import textkernel as tk
from moiety.llm.cluster import small_batches
from moiety.llm.sample import PER_CLASS, draw

BUCKETS, DIM, NGRAMS = 1 << 16, 16, (2, 3, 4)
EPOCHS, BATCH, RATE, REJECT = 3, 64, 400.0, 0.003
#: Gradient steps at least, so that a small sample is learnt too.
MIN_STEPS = 400
UND = "und"
_FOLD = tk.LOWER.copy()
_FOLD[:0x41] = 32
_FOLD[0x5B:0x61] = 32
_FOLD[0x7B:0x80] = 32


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of folded bytes, and the text it belongs to (by offsets)."""
    a = _FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out, rows = [], []
    key = a.copy()
    for n in range(2, max(NGRAMS) + 1):
        if len(a) < n:
            break
        key = (key[:-1] << np.uint32(8)) | a[n - 1 :]
        if n in NGRAMS:
            ok = row[: len(key)] == row[n - 1 :]
            ok &= ~((a[: len(key)] == 32) & (a[1 : len(key) + 1] == 32))
            h = (key[ok] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0xC2B2AE35)
            out.append((h >> np.uint32(16)).astype(np.int64))
            rows.append(row[: len(key)][ok])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(rows)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = -np.inf  # an energy

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, k = len(offsets) - 1, len(self.languages)
        out = np.zeros((n, k), np.float64)
        for i, j in tk.chunks(offsets, tk.BLOCK // 8):
            h, row = buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            count = np.maximum(1, np.bincount(row, minlength=j - i))
            for c in range(k):
                out[i:j, c] = np.bincount(row, weights=self.table[h, c], minlength=j - i) / count
        return out + self.bias

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language (index, -1 for texts without a letter), its calibrated probability, and the energy."""
        if not self.languages:
            n = len(offsets) - 1
            return np.full(n, -1), np.zeros(n), np.full(n, -np.inf)
        z = self.logits(data, offsets) * self.temperature
        top = z.max(axis=1, keepdims=True)
        p = np.exp(z - top)
        total = p.sum(axis=1)
        best, score, energy = z.argmax(axis=1), 1 / total, top[:, 0] + np.log(total)
        none = ~has_letter(data, offsets)
        best[none], score[none], energy[none] = -1, 0.0, -np.inf
        return best, score, energy

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, score, _ = self.judge(data, offsets)
        return best, score

    def rejects(self, best: np.ndarray, energy: np.ndarray) -> np.ndarray:
        return (best < 0) | (energy < self.reject_below)


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data], dtype=np.int64)))
    out = c[offsets[1:]] > c[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode(errors="replace")))
    return out


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Train on (text, language) rows."""
    rng = np.random.default_rng(seed)
    names = sorted({y for _, y in rows})
    k = len(names)
    if not k:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    code = {y: i for i, y in enumerate(names)}
    rows = [(t, y) for t, y in rows if t and has_letter(*tk.buffers(pa.array([t])))[0]]
    order = rng.permutation(len(rows))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]

    def excerpts(index: np.ndarray, copies: int) -> tuple[list[str], np.ndarray]:
        texts, y = [], []
        for i in index.tolist():
            t, lang = rows[i]
            for _ in range(copies):
                size = int(rng.choice((12, 40, 120, 400)))
                at = int(rng.integers(0, max(1, len(t) - size)))
                texts.append(t[at : at + size])
                y.append(code[lang])
        return texts, np.array(y)

    e = rng.normal(0, 0.1, (BUCKETS, DIM))
    w, b = np.zeros((DIM, k)), np.zeros(k)
    w += rng.normal(0, 0.1, w.shape)
    texts, y = excerpts(used, 3)
    data, offsets = tk.buffers(pa.array(texts, pa.string()))
    h, row = buckets(data, offsets)
    order = np.argsort(row, kind="stable")
    h, row = h[order], row[order]
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    per_epoch = max(1, -(-len(texts) // BATCH))
    epochs = max(EPOCHS, -(-MIN_STEPS // per_epoch))
    steps, done = epochs * per_epoch, 0
    for _ in range(epochs):
        mixed = rng.permutation(len(texts))
        for s in range(0, len(mixed), BATCH):
            ix = mixed[s : s + BATCH]
            n = first[ix + 1] - first[ix]
            ix, n = ix[n > 0], n[n > 0]
            if not len(ix):
                continue
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in ix])
            own = np.repeat(np.arange(len(ix)), n)
            hb = h[at]
            mean = np.zeros((len(ix), DIM))
            for d in range(DIM):
                mean[:, d] = np.bincount(own, weights=e[hb, d], minlength=len(ix)) / n
            z = mean @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(ix)), y[ix]] -= 1
            rate = RATE * (1 - done / steps) / len(ix)
            pull = (p @ w.T) / n[:, None]
            w -= rate * 0.005 * (mean.T @ p)
            b -= rate * 0.002 * p.sum(axis=0)
            for d in range(DIM):
                e[:, d] -= rate * np.bincount(hb, weights=pull[own, d], minlength=BUCKETS)
            done += 1
    model = Model(names, (e @ w).astype(np.float32), b)
    whole = [rows[i] for i in (held if len(held) else used).tolist()]
    if not whole:
        return model
    data, offsets = tk.buffers(pa.array([t for t, _ in whole], pa.string()))
    y = np.array([code[v] for _, v in whole])
    z = model.logits(data, offsets)
    best, least = 1.0, np.inf
    for temperature in np.exp(np.linspace(-2, 3, 41)):
        q = z * temperature
        q -= q.max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(y)), y]).mean())
        if loss < least:
            best, least = float(temperature), loss
    model.temperature = best
    got, _, energy = model.judge(data, offsets)
    if (got == y).any():
        model.reject_below = float(np.quantile(energy[got == y], REJECT))
    return model


def learn(docs: DataFrame, keep: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Fit on a bounded sample of the rows of ``docs`` with a language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("label"))
    if keep is not None:
        rows = rows.filter(keep)
    return fit([(t, y) for t, y in draw(rows, docs, per_class) if t is not None])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UND], dtype=object)
        for batch in batches:
            best, score, energy = m.judge(*tk.buffers(batch.column(1)))
            rejected = m.rejects(best, energy)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_named(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those rejected: no letter, or an energy under the calibrated threshold."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            best, _, energy = m.judge(*tk.buffers(batch.column(at)))
            yield batch.filter(pa.array(~m.rejects(best, energy)))

    return docs.mapInArrow(scan, docs.schema)

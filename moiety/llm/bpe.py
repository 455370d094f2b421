"""Tokenizer ids of whole texts, each distinct piece encoded by the library once per worker.

A text is cut only where the pre-tokenizers of both vocabularies are sure to end a piece and
nothing on one side depends on the other:

* before a single space, and around a single newline, that stand between two characters that
  are not white space (ASCII ones, or those whose UTF-8 lead byte is C3..DF or E4..F4: no white
  space lies there);
* after an ASCII letter before ASCII punctuation.

Encoding the pieces and joining their ids therefore gives the ids of the whole text (tests
compare the two). Each worker keeps pieces it has seen, up to ``CACHE_IDS`` ids, by a 64-bit
hash; beyond it the store is begun again.
"""

from __future__ import annotations

import os

import numpy as np

from moiety.llm import textkernel as tk

CACHE_IDS = 4_000_000
JOIN = 250
_U = np.uint64
_ASCII_TEXT = np.zeros(256, bool)  # ASCII, not white space (the separators 1C..1F are left out too)
_ASCII_TEXT[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_PUNCT = _ASCII_TEXT & ~_LETTER
_PUNCT[0x30:0x3A] = False
_NOT_PLAIN = ~_LETTER  # plain: ASCII letters and those of U+00C0..U+00FF, whose bytes are C3 80..C3 BF
_NOT_PLAIN[0xC3] = False
_NOT_PLAIN[0x80:0xC0] = False
_NOT_PLAIN[[0x97, 0xB7]] = True  # the signs for times and division
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = _LEAD[0xE4:0xF5] = True
_LEAD[0xCC:0xCE] = False  # combining marks stay with what they follow
_LEAD2 = np.zeros(256, bool)
_LEAD2[0xC3:0xE0] = True


def _byte_alphabet() -> np.ndarray:
    """The byte-level alphabet: printable bytes stand for themselves, others for U+0100 and on."""
    out = np.arange(256, dtype=np.uint16)
    other = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)]
    out[other] = 256 + np.arange(len(other))
    return out


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of each piece (0 included; texts' bounds are piece bounds)."""
    n = len(data)
    start = np.zeros(n + 1, bool)
    start[offsets] = True
    if n > 2:
        before = _ASCII_TEXT[data[:-2]]
        before[1:] |= (data[1:-2] >= 0x80) & _LEAD2[data[:-3]]
        after = _ASCII_TEXT[data[2:]] | _LEAD[data[2:]]
        both = before & after
        mid = data[1:-1]
        same = ~start[1:n-1] & ~start[2:n]  # both neighbours lie in this text
        both &= same
        line = both & (mid == 10)
        start[1:n-1] |= (both & (mid == 32)) | line
        start[2:n] |= line
    if n > 1:
        start[1:n] |= _LETTER[data[:-1]] & _PUNCT[data[1:]]
    start[n] = False
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids of Arrow string columns by a tokenizers file."""

    _kept: dict[str, "Encoder"] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # control strings in a text are ordinary text
        self.folds = "Lowercase" in str(self.model.normalizer)
        self.alphabet = _byte_alphabet()
        newline = chr(self.alphabet[10])
        self.words = Tokenizer(self.model.model)  # the same model, without the work to find words
        self.words.pre_tokenizer = Split(newline, "isolated")
        (self.mark,) = self.words.encode(newline, add_special_tokens=False).ids
        self._empty()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _empty(self) -> None:
        self.slots = np.zeros(1 << 16, np.int32)  # open addressing: the number of a kept piece, plus one
        self.keys = np.zeros(1 << 14, np.uint64)
        self.begin = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int32)
        self.size = 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _append(self, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), self.used + len(ids)), np.uint32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _plain(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of letters, and how many each has: one model word each, joined by newlines."""
        if self.folds:
            pieces = [x.lstrip() for x in pieces]
        texts = []
        for i in range(0, len(pieces), JOIN):
            raw = b"\n".join(pieces[i : i + JOIN])
            if self.folds:
                raw = raw.decode().lower().encode()
            texts.append(self.alphabet[np.frombuffer(raw + b"\n", np.uint8)].tobytes().decode("utf-16-le"))
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.words.encode_batch_fast(texts, add_special_tokens=False)])
        mark = np.flatnonzero(flat == self.mark)
        return np.delete(flat, mark), np.diff(mark, prepend=-1) - 1

    def _learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        """Add pieces of distinct hashes, none of them kept yet."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(x) for x in pieces])
        starts = np.concatenate(([0], ends[:-1]))
        wrong = np.concatenate(([0], np.cumsum(_NOT_PLAIN[data])))
        first = starts + (data[starts] == 32)
        plain = (wrong[ends] == wrong[first]) & (first < ends)
        counts, parts = np.zeros(len(pieces), np.int32), []
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        if plain.any():
            ids, n = self._plain([pieces[k] for k in np.flatnonzero(plain)])
            counts[plain] = n
            parts.append(ids)
        rest = np.flatnonzero(~plain)
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            for k, e in zip(part, self.model.encode_batch_fast([pieces[k].decode() for k in part], add_special_tokens=False)):
                parts.append(np.array(e.ids, np.uint32))
                counts[k] = len(parts[-1])
        flat = np.concatenate(parts)
        begin = np.empty(len(pieces), np.int64)
        begin[order] = self.used + np.concatenate(([0], np.cumsum(counts[order])[:-1]))
        self._append(flat)
        n, m = self.size, self.size + len(h)
        if m > len(self.keys):
            room = max(m, 2 * len(self.keys))
            self.keys, self.begin, self.count = (np.concatenate((x[:n], np.zeros(room - n, x.dtype))) for x in (self.keys, self.begin, self.count))
        self.keys[n:m], self.begin[n:m], self.count[n:m] = h, begin, counts
        self.size = m
        if 2 * m > len(self.slots):
            self.slots = np.zeros(1 << int(4 * m).bit_length(), np.int32)
            n = 0
        self._place(np.arange(n, m, dtype=np.int32))

    def _place(self, number: np.ndarray) -> None:
        mask = _U(len(self.slots) - 1)
        slot = (self.keys[number] & mask).astype(np.int64)
        while len(number):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = number[free] + 1
            left = self.slots[slot] != number + 1
            number, slot = number[left], (slot[left] + 1) & int(mask)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many come before each text."""
        n = len(offsets) - 1
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        starts = cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        h = tk.hash_spans(data, starts, ends, None)
        at = self._find(h)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            if self.used > CACHE_IDS:  # begin again: all pieces of this block are new
                self._empty()
                miss = np.arange(len(h))
            u, first = np.unique(h[miss], return_index=True)
            first = miss[first]
            raw = data.tobytes()
            self._learn(u, [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            at = self._find(h)
        counts = self.count[at].astype(np.int64)
        done = np.concatenate(([0], np.cumsum(counts)))
        where = np.arange(done[-1]) + np.repeat(self.begin[at] - done[:-1], counts)
        return self.ids[where], done[np.searchsorted(starts, offsets)]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each kept piece, -1 for others."""
        mask = len(self.slots) - 1
        slot = (h & _U(mask)).astype(np.int64)
        at = self.slots[slot] - 1
        wrong = np.flatnonzero((at >= 0) & (self.keys[at] != h))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & mask
            at[wrong] = self.slots[slot[wrong]] - 1
            wrong = wrong[(at[wrong] >= 0) & (self.keys[at[wrong]] != h[wrong])]
        return at

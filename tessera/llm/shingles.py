"""Sets of five-word shingles as sorted 64-bit hashes. Words are lower-cased runs of letters, digits and underscores."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from tessera.llm.shared import mix

_WORDS = re.compile(r"\w+").findall


class Shingler:
    """Stable hashes of the word n-grams of whole texts; a text of fewer words than n is one shingle, no words none."""

    KEEP = 64 << 20  # characters of remembered words; a word of more than LONG is not remembered
    LONG = 256

    def __init__(self, n: int = 5):
        self.n = n
        self.known: dict[str, int] = {}
        self.held = 0
        self.rolls = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def words(self, text: str) -> np.ndarray:
        words, known = _WORDS(text.lower()), self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            return np.array([self._learn(w) if (x := known.get(w)) is None else x for w in words], np.uint64)

    def _learn(self, word: str) -> int:
        x = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= self.LONG:
            if self.held > self.KEEP:
                self.known.clear()
                self.held = 0
            self.known[word] = x
            self.held += len(word) + 64
        return x

    def __call__(self, text: str) -> np.ndarray:
        w = self.words(text)
        if not len(w):
            return w
        n = min(self.n, len(w))
        out = np.full(len(w) - n + 1, len(w) if n < self.n else self.n, np.uint64)
        for k in range(n):
            out += w[k : len(w) - n + 1 + k] * self.rolls[k]
        return np.unique(mix(out))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set, as two signed longs."""
    a, b = s.sum(dtype=np.uint64), mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))

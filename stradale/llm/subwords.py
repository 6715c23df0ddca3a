"""Hashed character n-grams of words, computed once for each word that a worker meets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: New words whose n-grams are held at a time.
TOGETHER = 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)


def ngrams(words: list[bytes], low: int, high: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(word, bucket)`` of all byte n-grams of ``low`` to ``high`` bytes of each word between boundary marks."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint64)
    ends, owner = np.cumsum(sizes), np.repeat(np.arange(len(words)), sizes)
    who, where = [], []
    rolling = np.zeros(len(data), np.uint64)
    for n in range(1, high + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        rolling = rolling[:m] * _STEP + data[n - 1 : n - 1 + m] + np.uint64(1)
        if n >= low:
            inside = np.arange(m) + n <= ends[owner[:m]]
            mixed = (rolling ^ (rolling >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            who.append(owner[:m][inside])
            where.append((mixed[inside] >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(who or [owner[:0]]), np.concatenate(where or [owner[:0]])


class WordTable:
    """Rows of numbers for words, made for a batch of new words at a time; emptied when ``most`` words are held."""

    def __init__(self, make: Callable[[list[bytes]], np.ndarray], most: int = 120_000):
        self.make, self.most = make, most
        self._clear()

    def _clear(self) -> None:
        table, new = self, []

        class Index(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = k = len(self)
                table.new.append(word)
                return k

        self.index, self.new, self.rows = Index(), new, None

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > self.most:
            self._clear()
        out = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.new:
            made = np.concatenate([self.make(self.new[a : a + TOGETHER]) for a in range(0, len(self.new), TOGETHER)])
            have = len(self.index) - len(self.new)
            if self.rows is None or len(self.rows) < len(self.index):
                grown = np.zeros((max(1024, 2 * len(self.index)), *made.shape[1:]), made.dtype)
                if have:
                    grown[:have] = self.rows[:have]
                self.rows = grown
            self.rows[have : len(self.index)] = made
            self.new.clear()
        return out


def slices(batch, rows: int = 250):
    """The batch in parts, so that what is made of its words stays small."""
    return (batch.slice(a, rows) for a in range(0, batch.num_rows, rows))


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; zero for empty runs."""
    out = np.zeros((len(sizes), *values.shape[1:]), np.float64)
    full = sizes > 0
    if full.any():
        starts = np.cumsum(sizes) - sizes
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out

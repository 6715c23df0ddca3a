"""Words and word shingles, hashed in numpy over a whole batch of texts."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of a shingle.
WIDTH = 5
#: Words that a worker keeps the hashes of; the table is emptied when it is full, so its memory is bounded.
MAX_KNOWN = 150_000
#: Rows and bytes of an Arrow batch of texts: it is closed after the row that reaches either.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_known = _Hashes()


def small_batches(spark) -> None:
    """Bound the rows and bytes of an Arrow batch: texts may be very long, and the defaults of Spark need not fit in a worker."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.conf.get(size) != f"{BATCH_BYTES}b":
        spark.conf.set(size, f"{BATCH_BYTES}b")


def split(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case: what ``bytes`` methods do, which know ASCII only."""
    return text.lower().split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if len(_known) > MAX_KNOWN:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def _fold(ids: np.ndarray, width: int) -> np.ndarray:
    n = len(ids) - width + 1
    out = ids[:n].copy()
    for k in range(1, width):
        out *= _STEP
        out += ids[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def grams(ids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order and with repeats; none if there are fewer words."""
    return _fold(ids, width) if len(ids) >= width else np.zeros(0, np.uint64)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted set of hashed ``width``-word shingles; the whole sequence as one if there are fewer words; empty without words."""
    ids = hashes(split(text))
    if not len(ids):
        return np.zeros(0, np.uint64)
    return np.unique(_fold(ids, min(width, len(ids)))) if len(ids) >= width else _fold(ids, len(ids)) ^ np.uint64(len(ids))

"""Quality by votes of nearest neighbours among labelled documents, in a latent-semantic space.

Terms of a document are the shapes, endings and lengths of its words, and bins of how it repeats itself. Their weighted counts are
projected on the strongest directions of the labelled sample. Every document is compared with all labelled vectors, exactly and
in blocks; the most similar ones vote, weighted by their similarity. Weights, axes and vectors lie on a binary grid, fine enough to
matter nowhere and coarse enough that every product and sum of them is exact. So a similarity does not depend on what else is in
the block, equal vectors are equally similar, and ties are told by the order of the labelled rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stradale.llm.sampling import fold, labelled_texts
from stradale.llm.subwords import WordTable, slices
from stradale.llm.words import small_batches

#: Buckets of terms, latent dimensions, voters, power of a similarity as a weight, documents compared at a time.
BUCKETS, DIM, VOTERS, POWER, BLOCK = 1024, 48, 15, 8, 256
#: Bounds of the labelled sample: rows of each label, characters of a text.
PER_CLASS, MAX_CHARS = {0: 1200, 1: 1800}, 20_000
HELD_OUT, THRESHOLD = 2, 0.7
#: Bits after the point of weighted terms, of rows and axes, and of latent vectors: sums of 1,056 and of 48 products fit in 53 bits.
_TERM_BITS, _ROW_BITS, _LATENT_BITS = 16, 20, 22

_KINDS = bytes(120 if 97 <= b < 123 or b >= 128 else 88 if 65 <= b < 91 else 57 if 48 <= b < 58 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
#: Bins of doc-level terms: logarithms of length and of the mean use of a word, share of words used once, of lines that repeat.
_BINS, _EDGE = 8, 4 * 8
_FORM_WEIGHT = 1.5


def _grid(values: np.ndarray, bits: int) -> np.ndarray:
    return np.rint(values * float(1 << bits)) / float(1 << bits)


def _features(words: list[bytes]) -> np.ndarray:
    """Three buckets of each word: its shape, the shape with its end, its length."""
    import zlib

    out = np.empty((len(words), 3), np.int64)
    for k, w in enumerate(words):
        shape = _RUNS.sub(rb"\1", w.translate(_KINDS))[:12]
        out[k] = zlib.crc32(shape) % BUCKETS, zlib.crc32(shape[-2:] + b"/" + w[-2:]) % BUCKETS, zlib.crc32(b"%d" % min(len(w), 20)) % BUCKETS
    return out


def _forms(text: str, ids: np.ndarray) -> list[int]:
    n, lines = len(ids), [x for x in text.split("\n") if x.strip()]
    kinds = len(np.unique(ids))
    cut = lambda x: int(min(_BINS - 1, max(0, x)))
    return [cut(np.log2(n + 1) / 2), cut(_BINS * kinds / n), cut(2 * np.log2(n / kinds)), cut(_BINS * (1 - len(set(lines)) / max(1, len(lines))))]


def counts(texts: list[str | None], table: WordTable) -> np.ndarray:
    """Logarithmic term counts, a row per text; zero for texts without words."""
    words = [t.encode().split() if t else [] for t in texts]
    ids = table.ids([w for x in words for w in x])
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(texts), BUCKETS + _EDGE), np.float32)
    if len(ids):
        flat = table.rows[ids] + (np.repeat(np.arange(len(texts)), sizes) * BUCKETS)[:, None]
        out[:, :BUCKETS] = np.log1p(np.bincount(flat.ravel(), minlength=len(texts) * BUCKETS)).reshape(-1, BUCKETS)
    at = 0
    for k, n in enumerate(sizes):
        if n:
            for j, b in enumerate(_forms(texts[k], ids[at : at + n])):
                out[k, BUCKETS + j * _BINS + b] = 1
        at += n
    return out


class Model:
    """Projection and labelled latent vectors: at most ``(BUCKETS + 32) * DIM`` numbers and ``DIM`` for each labelled row."""

    def __init__(self, texts: list[str], labels: list[int], share: float):
        self.share = share
        terms = counts(texts, WordTable(_features))
        n = max(1, len(texts))
        self.idf = np.log((1 + n) / (1 + (terms > 0).sum(axis=0))).astype(np.float32) + 0.1
        self.idf[BUCKETS:] = _FORM_WEIGHT * (self.idf[BUCKETS:] + 1)
        rows = self._rows(terms)
        _, vectors = np.linalg.eigh((rows.T @ rows).astype(np.float64))
        self.axes = _grid(np.ascontiguousarray(vectors[:, ::-1][:, :DIM]), _ROW_BITS)
        self.points, self.labels = self._latent(rows), np.array(labels, np.float32)
        # each label counts as its share among all labelled rows, however many of it were sampled
        found = self.labels.mean() if len(labels) else share
        self.weight = np.where(self.labels == 1, share / max(found, 1e-6), (1 - share) / max(1 - found, 1e-6)).astype(np.float32)

    def _rows(self, terms: np.ndarray) -> np.ndarray:
        rows = _grid(terms.astype(np.float64) * self.idf, _TERM_BITS)
        return _grid(rows / np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-9)[:, None], _ROW_BITS)

    def _latent(self, rows: np.ndarray) -> np.ndarray:
        out = _grid(rows @ self.axes, _LATENT_BITS)
        return _grid(out / np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-9)[:, None], _LATENT_BITS)

    def _voters(self, near: np.ndarray) -> np.ndarray:
        """Of each row the places of the most similar labelled rows; of equally similar ones the first."""
        n, k = near.shape[1], min(VOTERS, near.shape[1])
        order = np.rint(near * float(1 << 44)).astype(np.int64) * np.int64(1 << 13) + np.arange(n - 1, -1, -1)
        return np.sort(np.argpartition(order, n - k, axis=1)[:, n - k :], axis=1)

    def score(self, texts: list[str | None], table: WordTable) -> np.ndarray:
        """Scores of texts, each the same whatever the others are; 0 for those without words."""
        out = np.full(len(texts), self.share)
        if not len(self.labels):
            return out
        for a in range(0, len(texts), BLOCK):
            part = texts[a : a + BLOCK]
            terms = counts(part, table)
            near = self._latent(self._rows(terms)) @ self.points.T
            best = self._voters(near)
            votes = np.maximum(np.take_along_axis(near, best, axis=1), 1e-6) ** POWER * self.weight[best]
            value = [math.fsum(v * y) / math.fsum(v) for v, y in zip(votes, self.labels[best])]
            out[a : a + BLOCK] = np.where(terms.any(axis=1), value, 0.0)
        return np.clip(out, 0.0, 1.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score``, a row per row of ``docs``; null texts and those without words score 0. No shuffle.

    Ties among neighbours go to the labelled row with the smaller id. Repeated rows score alike; texts are read whole, however
    long; other columns are not read. Without labelled rows all score the share of label 1 (a half if there is none).
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches):
        table = WordTable(_features)
        for batch in (part for whole in batches for part in slices(whole)):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(sent.value.score(batch.column(1).to_pylist(), table), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = Model(*labelled_texts(docs, labels, "quality", HELD_OUT, per_class=PER_CLASS, max_chars=MAX_CHARS))
    return score(docs, model).select("doc_id", (fold("doc_id", 4) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Toxicity: embeddings of word pieces averaged into a linear softmax, both trained together in numpy.

A document is the mean of the embeddings of the character n-grams of its distinct words, so a misspelling that was never seen
shares most of its vectors with the word it comes from. The mean is linear, so once trained each word needs one number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stradale.llm.sampling import fold, labelled_texts
from stradale.llm.subwords import WordTable, ngrams, segment_sums, slices
from stradale.llm.words import small_batches

#: Bits of a bucket, lengths of n-grams, numbers of an embedding, passes, documents of a step, step size, gain of the mean.
BITS, LOW, HIGH, DIM, EPOCHS, STEP_DOCS, RATE, GAIN = 17, 3, 5, 8, 12, 64, 0.3, 40.0
#: Bounds of the training sample: rows of each label, characters of a text.
PER_CLASS, MAX_CHARS = {0: 3000, 1: 2000}, 20_000
HELD_OUT, THRESHOLD = 2, 0.3


def tokens(text: str | None) -> list[bytes]:
    """The distinct words, in lower case."""
    return [w.encode() for w in dict.fromkeys(text.lower().split())] if text else []


class Model:
    """One number for each bucket (embedding times softmax weights) and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def of_words(self, words: list[bytes]) -> np.ndarray:
        who, where = ngrams(words, LOW, HIGH, BITS)
        return np.stack([np.bincount(who, self.weights[where], len(words)), np.bincount(who, minlength=len(words))], axis=1)

    def score(self, texts: list[str | None], table: WordTable) -> np.ndarray:
        words = [tokens(t) for t in texts]
        ids = table.ids([w for x in words for w in x])
        sums = segment_sums(table.rows[ids], np.fromiter(map(len, words), np.int64, len(words))) if len(ids) else np.zeros((len(words), 2))
        return 1 / (1 + np.exp(-np.clip(sums[:, 0] / np.maximum(sums[:, 1], 1) + self.bias, -40, 40)))


def train(texts: list[str], labels: list[int], share: float, seed: int = 7) -> Model:
    """Adagrad over embeddings and softmax weights; the bias is then set for the share of label 1 among all labelled rows."""
    if not texts or len(set(labels)) < 2:
        rate = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(1 << BITS), float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(seed)
    rows = []
    for text in texts:
        where = ngrams(tokens(text), LOW, HIGH, BITS)[1]
        keys, counts = np.unique(where, return_counts=True)
        rows.append((keys.astype(np.int32), (GAIN * counts / max(1, len(where))).astype(np.float32)))
    y = np.array(labels)
    embed = rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    g_embed, g_out, g_bias = (np.full(x.shape, 1e-6, np.float32) for x in (embed, out, bias))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), STEP_DOCS):
            part = order[a : a + STEP_DOCS]
            keys = np.concatenate([rows[k][0] for k in part])
            share_of = np.concatenate([rows[k][1] for k in part])
            sizes = np.array([len(rows[k][0]) for k in part])
            hidden = segment_sums(embed[keys] * share_of[:, None], sizes).astype(np.float32)
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            d_out, d_bias, d_hidden = hidden.T @ p, p.sum(axis=0), np.repeat(p @ out.T, sizes, axis=0) * share_of[:, None]
            used, back = np.unique(keys, return_inverse=True)
            d = np.stack([np.bincount(back, d_hidden[:, k], len(used)) for k in range(DIM)], axis=1).astype(np.float32)
            g_embed[used] += d * d
            embed[used] -= RATE * d / np.sqrt(g_embed[used])
            for value, grad, total in ((out, d_out, g_out), (bias, d_bias, g_bias)):
                total += grad * grad
                value -= RATE * grad / np.sqrt(total)
    odds = lambda r: np.log(r / (1 - r))
    shift = odds(min(max(share, 1e-3), 1 - 1e-3)) - odds(y.mean())
    return Model(GAIN * (embed @ (out[:, 1] - out[:, 0])), float(bias[1] - bias[0] + shift))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score``, a row per row of ``docs``; null and empty texts score as the bias. No shuffle.

    A score depends on its text only, so there are no ties to break and repeated rows score alike; texts are read whole, however
    long; other columns are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches):
        table = WordTable(sent.value.of_words)
        for batch in (part for whole in batches for part in slices(whole)):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(sent.value.score(batch.column(1).to_pylist(), table), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(*labelled_texts(docs, labels, "toxic", HELD_OUT, per_class=PER_CLASS, max_chars=MAX_CHARS))
    return score(docs, model).select("doc_id", (fold("doc_id", 4) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Rows to learn from are drawn by language, so a rare one is learned from as many rows as it has; the priors are the shares of all
rows. Every language is learned: the more there are, the fewer buckets each gets, so the matrix that is broadcast stays bounded.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from stradale.llm.sampling import fold
from stradale.llm.subwords import WordTable, ngrams, segment_sums, slices
from stradale.llm.words import small_batches
from stradale.plans.staging import discard, materialize

#: Training rows of each language, bits of a bucket at most and at least, numbers of all languages at most (as a power of two),
#: lengths of n-grams, pseudo-counts.
PER_LANG, BITS, LEAST_BITS, ALL_BITS, LOW, HIGH, SMOOTH = 1000, 16, 8, 24, 1, 4, 0.5
HELD_OUT = 0
#: Natural logarithm of the mean likelihood of an n-gram, under the likeliest language, below which a text is in none that was learned.
#: Learned from 6,000, 500 and 60 rows of sf0.1, with 2**16 buckets: random letters -11.5 to -11.8, -10.5 to -10.7, -9.6 to -9.8; 99.9 % of 2,000 other rows above -9.1.
LEAST = -9.5
#: Tasks that count the n-grams of one language, whose counts then are added.
SALTS = 8
#: Ids (with their languages) of rows to learn from that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST = 200_000


def has_letter(text: str) -> bool:
    """Whether any character is a letter (categories Lu, Ll, Lt, Lm, Lo): digits, number forms and marks are none."""
    return any(map(str.isalpha, text))


def tokens(text: str | None) -> list[bytes]:
    return [w.encode() for w in text.lower().split()] if text else []


class Model:
    """Log-probabilities of buckets, a row per language, and log-priors: at most ``2**ALL_BITS`` numbers for up to 65,536 languages."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray, bits: int = BITS):
        self.langs, self.bits = langs, bits
        self.prior = np.log(docs / docs.sum()) if langs else np.zeros(0)
        rows = counts + np.float32(SMOOTH)
        self.logs = np.log(rows / rows.sum(axis=1, keepdims=True)).astype(np.float32) if langs else np.zeros((0, 1 << bits), np.float32)

    def of_words(self, words: list[bytes]) -> np.ndarray:
        who, where = ngrams(words, LOW, HIGH, self.bits)
        return np.stack([*(np.bincount(who, row[where], len(words)) for row in self.logs), np.bincount(who, minlength=len(words))], axis=1)

    def predict(self, texts: list[str | None], table: WordTable) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language, its posterior and the log-likelihood per n-gram under the likeliest; ``und`` and 0 where there is no letter, or
        nothing was learned. Of languages that are equally likely the first by name is taken."""
        told = [t if t and has_letter(t) else None for t in texts]
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        words = [tokens(t) for t in told]
        ids = table.ids([w for x in words for w in x])
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sums = segment_sums(table.rows[ids], sizes) if len(ids) else np.zeros((len(words), len(self.langs) + 1))
        scores = sums[:, :-1] + self.prior
        best = scores.argmax(axis=1)
        sure = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if t is not None else "und" for b, t in zip(best, told)], np.where([t is not None for t in told], sure, 0.0), sums[:, :-1].max(axis=1) / np.maximum(1, sums[:, -1])


def _counter(bits: int):
    def run(batch: pa.Table) -> pa.Table:
        counts = np.zeros(1 << bits, np.int64)
        for text in batch["text"].to_pylist():
            if words := tokens(text):
                counts += np.bincount(ngrams(words, LOW, HIGH, bits)[1], minlength=1 << bits)
        return pa.table({"lang": batch["lang"].slice(0, 1), "counts": pa.array([counts.tobytes()], pa.binary())})

    return run


def _adder(parts: pa.Table) -> pa.Table:
    counts = sum(np.frombuffer(x, np.int64) for x in parts["counts"].to_pylist())
    return pa.table({"lang": parts["lang"].slice(0, 1), "counts": pa.array([counts.astype(np.float32).tobytes()], pa.binary())})


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Learn every language of ``docs``, none of the rows of the held-out fold, in the executors.

    Of each language at most ``per_lang`` rows are learned from, those whose ids have the smallest hashes (of ids that repeat, all
    their rows count): the same however the table is laid out. Null ids and languages are left out; null texts teach nothing, and
    a table without languages nothing at all. More than ``2**(ALL_BITS - LEAST_BITS)`` languages are refused: such a column names no languages.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = rows.where((fold("i", 5) != HELD_OUT) & F.col("lang").isNotNull() & F.col("i").isNotNull())
    most = 1 << (ALL_BITS - LEAST_BITS)
    shares = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()}
    if len(shares) > most:
        raise ValueError(f"more than {most} languages")
    bits = min(BITS, ALL_BITS - math.ceil(math.log2(max(1, len(shares)))))
    # of each language only ids with hashes below a bound are ranked, somewhat more than are learned from, however many rows it has
    bounds = docs.sparkSession.createDataFrame([(x, min(1.0, (1.5 * per_lang + 100) / n)) for x, n in shares.items()], f"lang {docs.schema[lang_col].dataType.simpleString()}, share double")
    turn = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("i"), "i"))
    low = known.select("lang", "i").join(F.broadcast(bounds), "lang").where(F.xxhash64("i") / F.lit(2.0**64) + 0.5 <= F.col("share"))
    ids = low.withColumn("turn", turn).where(F.col("turn") <= per_lang).select("lang", "i").distinct()
    ids = materialize(ids, "learned")
    sample = known.join(F.broadcast(ids) if len(shares) * per_lang <= MAX_BROADCAST else ids, ["lang", "i"], "left_semi")
    dealt = sample.select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(SALTS)).alias("salt"))
    shape = "lang string, counts binary"
    got = dealt.groupBy("lang", "salt").applyInArrow(_counter(bits), shape).groupBy("lang").applyInArrow(_adder, shape).collect()
    discard(ids)
    got = sorted(got, key=lambda r: r.lang)
    counts = np.array([np.frombuffer(r.counts, np.float32) for r in got]).reshape(len(got), 1 << bits)
    return Model([r.lang for r in got], counts, np.array([shares[r.lang] for r in got], float), bits)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, likelihood: bool = False) -> DataFrame:
    """The columns ``keep`` (all by default), ``lang_pred``, ``score`` and, if asked for, ``likelihood``, a row per row.

    Columns of ``keep`` with those names give way. Only the text is looked at; null texts and those without a letter are ``und``
    with a score of 0; texts are read whole, however long; repeated rows are told alike. No shuffle.
    """
    made = ["lang_pred", "score", *(["likelihood"] if likelihood else [])]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [to_arrow_type(docs.schema[c].dataType) for c in keep]
    sent_cols = keep if text_col in keep else [*keep, text_col]
    at = sent_cols.index(text_col)

    def run(batches):
        table = WordTable(sent.value.of_words, min(120_000, (1 << 21) // (len(sent.value.langs) + 1)))
        for batch in (part for whole in batches for part in slices(whole)):
            langs, scores, each = sent.value.predict(batch.column(at).to_pylist(), table)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(kind) for k, kind in enumerate(kinds)), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(each, pa.float64())], [*(f"k{k}" for k in range(len(keep))), "lang_pred", "score", "likelihood"])

    schema = ", ".join([*(f"k{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)), "lang_pred string, score double, likelihood double"])
    rows = docs.select(*(F.col(c).alias(f"k{k}") for k, c in enumerate(sent_cols))).mapInArrow(run, schema)
    return rows.select(*(F.col(f"k{k}").alias(c) for k, c in enumerate(keep)), *made)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs), keep=["doc_id"]).select("doc_id", (fold("doc_id", 5) == HELD_OUT).alias("held_out"), "lang_pred", "score")

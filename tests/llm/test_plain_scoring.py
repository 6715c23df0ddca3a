"""The fitted models applied one row at a time in plain Python, against the operators; rare languages, letters, ties and batches."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stradale.llm import language_id, quality_classifier, toxicity
from stradale.llm.sampling import labelled_texts
from stradale.llm.subwords import WordTable

SF = "/root/testdata/sf0.01"
M64 = (1 << 64) - 1


def bucket(gram: bytes, bits: int) -> int:
    """The bucket of one n-gram, with plain integers."""
    rolling = 0
    for b in gram:
        rolling = (rolling * 0x9E3779B97F4A7C15 + b + 1) & M64
    return ((rolling ^ (rolling >> 31)) * 0xD6E8FEB86659FD93 & M64) >> (64 - bits)


def grams(word: bytes, low: int, high: int, bits: int) -> list[int]:
    w = b"\x02" + word + b"\x03"
    return [bucket(w[i : i + n], bits) for n in range(low, high + 1) for i in range(len(w) - n + 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def some(docs):
    return [(r.doc_id, r.text) for r in docs.orderBy(F.xxhash64("doc_id")).limit(40).collect()]


def test_languages_one_text_at_a_time(docs, some):
    model = language_id.fit(docs)
    told = {r.doc_id: r for r in language_id.identify(docs, model, keep=["doc_id"], likelihood=True).collect()}
    for i, text in some:
        if not text or not any(c.isalpha() for c in text):
            assert told[i].lang_pred == "und" and told[i].score == 0
            continue
        keys = [b for w in text.lower().split() for b in grams(w.encode(), language_id.LOW, language_id.HIGH, model.bits)]
        sums = [math.fsum(float(row[b]) for b in keys) for row in model.logs]
        logs = [s + p for s, p in zip(sums, model.prior)]
        best = max(range(len(logs)), key=lambda k: logs[k])
        assert told[i].lang_pred == model.langs[best]
        assert math.isclose(told[i].score, 1 / math.fsum(math.exp(x - logs[best]) for x in logs), rel_tol=1e-4)
        assert math.isclose(told[i].likelihood, max(sums) / len(keys), rel_tol=1e-6)


def test_held_out_recall_of_each_language(spark, docs):
    model = language_id.fit(docs)
    held = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0).where("lang is not null and length(text) > 100")
    for r in language_id.identify(held, model).groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("x")).collect():
        assert r.x > 0.97


def test_rare_and_many_languages_are_learned(spark):
    r = random.Random(5)
    rows = [(k, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(20)), "xx") for k in range(3000)] + [(9000 + k, "zwölf qurq blirx " * 5, "yy") for k in range(8)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=50)
    assert model.langs == ["xx", "yy"] and model.predict(["qurq blirx"], WordTable(model.of_words))[0] == ["yy"]
    many = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{k}q " * 9, f"l{k % 450}") for k in range(2700)]
    model = language_id.fit(spark.createDataFrame(many, "doc_id long, text string, lang string"))
    assert len(model.langs) == 450 and model.logs.size <= 1 << language_id.ALL_BITS


def test_letters():
    model = language_id.Model(["en"], np.ones((1, 1 << 16), np.float32), np.ones(1))
    told = model.predict(["½ ² Ⅷ ١", "½", "Ⅷ", "²", "x", "ß", "日", "́", None, "", "12"], WordTable(model.of_words))[0]
    assert told == ["und", "und", "und", "und", "en", "en", "en", "und", "und", "und", "und"]


def test_toxicity_one_text_at_a_time(spark, docs, some):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(*labelled_texts(docs, labels, "toxic", 2))
    told = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, text in some:
        keys = [b for w in dict.fromkeys((text or "").lower().split()) for b in grams(w.encode(), toxicity.LOW, toxicity.HIGH, toxicity.BITS)]
        z = math.fsum(float(model.weights[b]) for b in keys) / max(1, len(keys)) + model.bias
        assert math.isclose(told[i], 1 / (1 + math.exp(-max(-40, min(40, z)))), rel_tol=1e-6)


def term_counts(text):
    """Terms of one text: shapes, shapes with ends, lengths; and the four forms."""
    q, out = quality_classifier, np.zeros(quality_classifier.BUCKETS + quality_classifier._EDGE)
    words = (text or "").encode().split()
    for w in words:
        shape = "".join("x" if 97 <= b < 123 or b >= 128 else "X" if 65 <= b < 91 else "9" if 48 <= b < 58 else chr(b) for b in w)
        shape = "".join(c for k, c in enumerate(shape) if not k or c != shape[k - 1]).encode("latin-1")[:12]
        for term in (shape, shape[-2:] + b"/" + w[-2:], b"%d" % min(len(w), 20)):
            out[zlib.crc32(term) % q.BUCKETS] += 1
    out = np.log1p(out).astype(np.float32)
    if words:
        kinds, lines = len(set(words)), [x for x in text.split("\n") if x.strip()]
        forms = (math.log2(len(words) + 1) / 2, 8 * kinds / len(words), 2 * math.log2(len(words) / kinds), 8 * (1 - len(set(lines)) / max(1, len(lines))))
        for j, x in enumerate(forms):
            out[q.BUCKETS + 8 * j + int(min(7, max(0, x)))] = 1
    return out


def test_quality_one_text_at_a_time(spark, docs, some):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.Model(*labelled_texts(docs, labels, "quality", 2))
    told = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    for i, text in some:
        terms = term_counts(text)
        if not terms.any():
            assert told[i] == 0
            continue
        row = terms * model.idf
        row = row / np.linalg.norm(row)
        at = np.array([math.fsum(row * axis) for axis in model.axes.T])
        at /= np.linalg.norm(at)
        near = [math.fsum(at * p) for p in model.points]
        best = sorted(range(len(near)), key=lambda k: (-near[k], k))[: quality_classifier.VOTERS]
        votes = [max(near[k], 1e-6) ** quality_classifier.POWER * float(model.weight[k]) for k in best]
        assert math.isclose(told[i], sum(v * float(model.labels[k]) for v, k in zip(votes, best)) / sum(votes), abs_tol=0.02)


def test_scores_do_not_depend_on_the_batch():
    """Many equal vectors: one at a time and all at once, bit for bit; of equals the first rows vote."""
    r = random.Random(7)
    texts = [" ".join(r.choice(["aa", "bb", "Cc"]) for _ in range(r.choice([5, 6]))) for _ in range(400)]
    model = quality_classifier.Model(texts[:300], [k % 2 for k in range(300)], 0.5)
    table = WordTable(quality_classifier._features)
    together = model.score(texts, table)
    assert [model.score([t], table)[0] for t in texts] == together.tolist()
    assert model.score(texts[::-1], table).tolist() == together[::-1].tolist()
    near = np.array([[0.5] * 40 + [0.75]])
    assert model._voters(near).tolist() == [[*range(14), 40]]


def test_samples_are_the_same_where_ids_repeat(spark):
    rows = [(k % 20, f"text {k}") for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(3, 0), (4, 1)], "doc_id long, quality int")
    got = {tuple(labelled_texts(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels, "quality", 2)[0]) for r, n in ((rows, 1), (rows[::-1], 3), (rows, 7))}
    assert len(got) == 1

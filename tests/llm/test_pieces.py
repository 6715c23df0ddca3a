"""Segmentation against a dynamic programme over a plain dictionary of pieces, without the trie, its codes or its parts."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stradale.llm import quality_rules, sentencepiece


@pytest.fixture(scope="module")
def model():
    return sentencepiece.load()


def pieces_of(model):
    """Pieces, scores and byte pieces as read from the file, by the public meaning of its fields."""
    table, spelled, lowest = {}, {}, 0.0
    with open(sentencepiece.MODEL, "rb") as f:
        data = f.read()
    for k, entry in enumerate(dict(sentencepiece._fields(v)) for n, v in sentencepiece._fields(data) if n == 1):
        piece, kind = entry[1].decode(), entry.get(3, 1)
        score = float(np.frombuffer(entry[2], "<f4")[0]) if 2 in entry else 0.0
        if kind in (1, 4):
            table[piece] = (k, score)
            lowest = min(lowest, score)
        elif kind == 6:
            spelled[int(piece[3:5], 16)] = k
    return table, spelled, lowest


def best_score(text, table, lowest):
    """The largest sum of scores over all segmentations of the whole text, and the ids of one that reaches it."""
    marked = "".join("\0" if c == "▁" else "▁" if c == " " else c for c in " " + text)
    longest = max(map(len, table))
    best, back = [0.0], [None]
    for j in range(1, len(marked) + 1):
        options = [(best[i] + table[marked[i:j]][1], i) for i in range(max(0, j - longest), j) if marked[i:j] in table]
        if marked[j - 1] not in table:
            options.append((best[j - 1] + lowest + sentencepiece.PENALTY, j - 1))
        value, i = max(options)
        best.append(value)
        back.append(i)
    return best[-1]


def score_of(ids, table, spelled, lowest):
    by_id, out, k = {i: s for i, s in table.values()}, 0.0, 0
    names, at = {v: b for b, v in spelled.items()}, 0
    ids = list(ids)
    while at < len(ids):
        if ids[at] in by_id:
            out += by_id[ids[at]]
            at += 1
        else:
            first = names[ids[at]]
            at += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            out += lowest + sentencepiece.PENALTY
    return out


def test_scores_are_the_largest(model):
    table, spelled, lowest = pieces_of(model)
    r = random.Random(12)
    texts = ["  a  b\n\n c ", "▁x▁▁ y", "日本語 🙂🙃", "\x00\x01é", "a" * 90 + " " * 20, "hello world, wie geht's? ça va"]
    texts += ["".join(r.choice("ab é▁\n the日nd") for _ in range(r.randint(1, 50))) for _ in range(150)]
    texts += [t[:300] for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()[:60] if t]
    known: dict = {}
    model.learn(texts, known)
    for t in texts:
        ids = np.frombuffer(model.encode(t, known), "<i4").tolist()
        assert abs(score_of(ids, table, spelled, lowest) - best_score(t, table, lowest)) < 1e-6 * max(1, len(t))
        assert model.decode(ids) == t


def test_no_column_twice(spark, model):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("token_ids", "exact", "failures", "n_words", "k0", "t")})
    coded = sentencepiece.encode(docs, model, docs.columns)
    assert coded.columns == ["doc_id", "text", "failures", "n_words", "k0", "t", "token_ids", "exact"] and coded.where("exact").count() == 2
    assert sentencepiece.decode(coded, model, ["doc_id", "text"]).columns == ["doc_id", "text"]
    book = quality_rules.ledger(docs, keep=docs.columns)
    assert len(set(book.columns)) == len(book.columns) and book.where("failures = 0").count() == 0

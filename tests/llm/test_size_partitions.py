"""Partitions by size: nothing is missed, candidates are fewer, several blocks find what one finds."""

import random

import pytest

from stradale.llm import decontaminate


def words(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n)]


def sets(text, width=5):
    w = text.lower().split()
    width = min(width, len(w))
    return width, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if width else set()


def corpus(seed):
    """Items of many sizes, and long documents that hold them whole, damaged at random, or in part."""
    r = random.Random(seed)
    items = [" ".join(words(r, r.choice([1, 2, 4, 5, 6, 9, 14, 30, 70, 150]))) for _ in range(40)]
    docs = []
    for k in range(120):
        body = words(r, r.choice([50, 400, 2000]))
        for _ in range(r.randint(0, 3)):
            item = r.choice(items).split()
            for _ in range(r.choice([0, 0, 1, 2, len(item) // 20])):
                item[r.randrange(len(item))] = "damaged"
            if r.random() < 0.3:
                item = item[: int(len(item) * r.choice([0.7, 0.8, 0.85, 0.9, 0.95])) + 1]
            body[r.randrange(len(body)) :] = [*item, *body[-20:]]
        docs.append(" ".join(body))
    return docs, items


def brute(docs, items):
    out = set()
    for k, item in enumerate(items):
        width, want = sets(item)
        for d, doc in enumerate(docs):
            w = doc.lower().split()
            common = len(want & {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
            if want and 100 * common >= 80 * len(want):
                out.add((d, k, common))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_recall_is_whole(seed):
    docs, items = corpus(seed)
    index = decontaminate.Index([x.encode() for x in items], 80, 100)
    assert set(index.search([x.encode() for x in docs])) == brute(docs, items)
    for p in index.partitions:
        assert all(p.upper // 2 < len(index.sets[k]) <= p.upper for k in p.least)
    assert len({p.upper for p in index.partitions}) > 4


def test_candidates_need_several_minima():
    """One shared shingle, whichever it is, does not make a long item a candidate."""
    r = random.Random(9)
    item = words(r, 200)
    index = decontaminate.Index([" ".join(item).encode()], 80, 100)
    doc = [w for k in range(0, 195, 40) for w in (*words(r, 30), *item[k : k + 5])]
    calls = []
    part = index.partitions[0]
    probe = part.probe
    part.probe = lambda *a: calls.append(probe(*a)) or calls[-1]
    assert list(index.search([" ".join(doc).encode()])) == [] and calls == [[]]


def test_several_blocks(spark, monkeypatch):
    docs, items = corpus(7)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id, r.n_common) for r in decontaminate.find_items(d, i).collect()} == want
    assert {r.doc_id for r in decontaminate.remove_contaminated(d, i).collect()} == set(range(len(docs))) - {x for x, _, _ in want}

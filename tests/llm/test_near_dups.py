import itertools
import random

import pytest

from stradale.llm import near_dups


def brute(rows):
    sets = []
    for _, text in rows:
        w = text.encode().lower().split() if text else []
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None)))
    return sorted(out, key=str)


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcde") for _ in range(4))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE\ttwo"), (5, "x " * 50), (6, "x " * 500), (None, "one two")]
    shared = " ".join(word() for _ in range(30))
    for g in range(12):
        base = [word() for _ in range(r.choice([6, 40, 120]))] + (shared.split() if g % 3 == 0 else [])
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows) + 10, " ".join(copy)))
    return rows


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_equal_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(near_dups, "FEW_LINKS", few)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, sid string")
    got = [tuple(r) for r in near_dups.ngram_jaccard_join(docs).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark):
    assert near_dups.ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []

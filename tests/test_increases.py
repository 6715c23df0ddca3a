import numpy as np
import pandas as pd
import pytest

from stradale.operators import paths, quantiles


def _streets(seed, tied):
    """A grid of 8 by 5 nodes with ids in no order and some edges left out, all as long as each other where ``tied``."""
    rng = np.random.default_rng(seed)
    name = rng.permutation(40) - 11
    pairs = [(a, b) for a in range(40) for b in (a + 1, a + 5) if b < 40 and (b != a + 1 or b % 5) and rng.random() < 0.85]
    length = np.ones(len(pairs)) if tied else 1 + rng.random(len(pairs))
    return name[[a for a, _ in pairs]], name[[b for _, b in pairs]], length


@pytest.mark.parametrize("tied", [False, True])
def test_one_search_of_one_side(tied, monkeypatch):
    """The increases are those of all detours; where no two ways are as long, no source is searched twice, and none that has no pair."""
    searched, table = [], paths.Graph.table
    monkeypatch.setattr(paths.Graph, "table", lambda g, ids, *cut: searched.extend(ids.tolist()) or table(g, ids, *cut))
    for seed in range(4):
        src, dst, length = _streets(seed, tied)
        for u, v in zip(src.tolist()[::9], dst.tolist()[::9]):
            g, cut = paths.Graph(src, dst, length), (1, None, u, v)
            ids = g.nodes[np.argsort(g.place)]
            rows = [(s, after[way] - before[way]) for _, rows in paths._detours(g, ids, [cut]) for s, _, before, after in rows for way in (np.isfinite(after),)]
            affected = [s for _, rows in paths._detours(g, ids, [cut]) for s, *_ in rows]
            searched.clear()
            got = list(paths._increases(g, ids, [cut]))
            assert np.allclose(np.sort(np.concatenate([np.zeros(0), *got])), np.sort(np.concatenate([np.zeros(0), *(x for _, x in rows)])), atol=1e-9)
            if not tied:
                assert len(searched) == len(set(searched[2:])) + 2  # both ends tell the sides
                assert set(affected) <= set(searched[2:]) and len(searched) - 2 < len(ids)


@pytest.mark.parametrize("tied", [False, True])
def test_increases_of_all_reroutes(spark, tied):
    src, dst, length = _streets(7, tied)
    edges = spark.createDataFrame(pd.DataFrame({"src": src, "dst": dst, "length_m": length}))
    nodes = edges.selectExpr("src AS node_id").union(edges.selectExpr("dst")).distinct()
    cuts = spark.createDataFrame([(1, None, int(src[20]), int(dst[20])), (2, int(src[9]), None, None), (3, None, 77, 78)], "scenario long, cut_node long, cut_u long, cut_v long")
    want = sorted(r.more for r in paths.reroutes(nodes, edges, cuts).where("after IS NOT NULL").selectExpr("after - before AS more").collect())
    got = paths.increases(nodes, edges, cuts, lambda _, n: [*quantiles.middle(n), n - 1])["more"]
    assert got["n"] == len(want) > 20 and got["total"] == pytest.approx(sum(want))
    assert quantiles.median(got) == pytest.approx(np.median(want)) and got["most"] == pytest.approx(want[-1]) == pytest.approx(got["at"][len(want) - 1])


def test_repeating_numbers_are_counted_once(spark):
    """One count is enough where numbers repeat; where some task finds too many, they are counted again, with the same result."""
    rng = np.random.default_rng(3)
    some = np.concatenate([np.repeat(rng.random(500) * 100, 40), -rng.random(3000)])
    ranks = lambda _, n: [0, *quantiles.middle(n), int(0.95 * (n - 1)), n - 1]

    def told(x):
        calls = []

        def count(wanted):
            calls.append(wanted)

            def run(frames):
                for f in frames:
                    counted = quantiles.Counted(wanted, repeats=True)
                    counted.add("x", f["x"].to_numpy())
                    yield counted.take()

            rows = spark.createDataFrame(pd.DataFrame({"x": rng.permutation(x)})).repartition(3)
            return rows.mapInPandas(run, quantiles.WHOLE_SCHEMA if wanted is None else quantiles.SCHEMA)

        one = quantiles.order_statistics(count, ranks)["x"]
        assert one["n"] == len(x) and one["most"] == x.max() and one["total"] == pytest.approx(x.sum())
        assert [one["at"][r] for r in ranks("x", len(x))] == np.sort(x)[ranks("x", len(x))].tolist()
        return len(calls)

    assert told(some) == 1
    assert told(np.concatenate([some, rng.random(20000)])) == 2

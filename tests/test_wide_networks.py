"""Networks searched many sources at a time, and what is told of their pairs, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stradale.operators import failures, paths, validation


def strip(n, seed=3):
    """A strip of ten nodes a row with gaps, some parallel and equal edges, and a piece of its own."""
    r = random.Random(seed)
    edges = [(k, k + 1, r.uniform(1, 2)) for k in range(n) if k % 10 != 9 and r.random() < 0.75]
    edges += [(k, k + 10, r.choice((1.0, 1.5, r.uniform(1, 2)))) for k in range(n - 10) if r.random() < 0.7]
    return [(k,) for k in range(n + 13)], [*edges, edges[3], (n + 11, n + 10, 1.0), (n + 10, n + 12, 2.0)]


def tables(spark, nodes, edges):
    return spark.createDataFrame(nodes, "node_id long"), spark.createDataFrame(edges, "src long, dst long, length_m double")


def scaled(edges):
    return edges.withColumn("length_m", F.col("length_m") * (1 + (F.col("src") % 7) * F.expr("1e-2")))


@pytest.mark.parametrize("cut", [{}, {"node": 55}, {"edge": (60, 70)}])
def test_sources_together_are_searched_as_alone(cut):
    graph = paths.Graph(*(np.array(x) for x in zip(*strip(300)[1])))
    ids = np.array([k for k in graph.nodes.tolist() if k != 55])
    for some in (ids[:40], ids[np.argsort(graph.place[graph.index(ids)])], ids[-3:]):
        for s, d in zip(some.tolist(), paths.by_source(graph.table(some, **cut))):
            assert dict(zip(graph.nodes[np.isfinite(d)].tolist(), d[np.isfinite(d)].tolist())) == graph.dijkstra(s, **cut)[0]


def test_errors_of_all_pairs_are_neither_joined_nor_gathered(spark):
    nodes, edges = tables(spark, *strip(120))
    other = scaled(edges)
    want = validation.path_errors(*(paths.distances(e, paths.all_sources(nodes)) for e in (edges, other)))
    got = validation.network_errors(nodes, edges, other)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    told = lambda df: sorted(tuple(r) for r in df.select("s", "t", *(F.round(c, 9) for c in ("length_m", "reference_m", "abs_error_m", "error_pct"))).collect())
    assert told(got) == told(want) and len(told(got)) > 5000


def test_summary_of_errors_has_exact_medians(spark):
    nodes, edges = tables(spark, *strip(90))
    other = scaled(edges)
    want = validation.error_summary(validation.network_errors(nodes, edges, other)).first().asDict()
    got = validation.network_error_summary(nodes, edges, other).first().asDict()
    assert list(got) == list(want) and got["pairs"] == want["pairs"] and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert tuple(validation.network_error_summary(nodes, edges.limit(0), other).first()) == (0, *[None] * 7)


def test_first_routes_are_those_of_all(spark):
    nodes, edges = tables(spark, *strip(120))
    cuts = spark.createDataFrame([(k, u, v) for k, (u, v, _) in enumerate(strip(120)[1][40:52], 1)], "scenario long, cut_u long, cut_v long")
    whole = failures.sample_routes(paths.reroutes(nodes, edges, cuts, paths=True), 15).collect()
    told = paths.reroutes(nodes, edges, cuts, first=15)
    tasks = 4 * spark.sparkContext.defaultParallelism
    assert failures.first_routes(nodes, edges, cuts, 15).collect() == whole and len(whole) == 15
    assert told.count() <= 15 * tasks < paths.reroutes(nodes, edges, cuts).count()


def test_totals_of_reroutes_and_their_increases(spark):
    nodes, edges = tables(spark, *strip(120))
    cuts = spark.createDataFrame([(1, 55, None, None), (2, None, 60, 70), (3, None, 500, 501)], "scenario long, cut_node long, cut_u long, cut_v long")
    routes = paths.reroutes(nodes, edges, cuts)
    rounded = lambda df: sorted(tuple(None if x is None else round(x, 5) for x in r) for r in df.collect())
    assert rounded(failures.reroute_totals(nodes, edges, cuts)) == rounded(failures.reroute_summary(routes))
    more = sorted(r.after - r.before for r in routes.where("after is not null").collect())
    got = paths.increases(nodes, edges, cuts, lambda _, n: [0, n // 3, n - 1])["more"]
    assert got["n"] == len(more) > 100 and [got["at"][k] for k in (0, len(more) // 3, len(more) - 1)] == [more[0], more[len(more) // 3], more[-1]]


def test_a_batch_may_hold_only_the_node_that_is_removed(spark):
    graph = paths.Graph(*(np.array(x) for x in zip(*strip(40)[1])))
    assert graph.table(graph.nodes[:0], 5).shape == (len(graph.nodes), 0)

"""Parts of the road library against plain versions of themselves."""

import json
import random
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from stradale.functions import scalars
from stradale.operators import failures, graph, healing, paths, raster, skeleton, validation
from stradale.plans import staging
from stradale.sources import documents, geotiff

T = (1e-5, 0.0, 2.25, 0.0, -1e-5, 48.85)


def grid(n, seed=1):
    """A square lattice with random lengths: nodes and edges as lists."""
    r = random.Random(seed)
    edges = [(k, k + 1, r.uniform(1, 2)) for k in range(n * n) if k % n != n - 1] + [(k, k + n, r.uniform(1, 2)) for k in range(n * n - n)]
    return [(k,) for k in range(n * n)], edges


def tables(spark, nodes, edges):
    return spark.createDataFrame(nodes, "node_id long"), spark.createDataFrame(edges, "src long, dst long, length_m double")


def test_forest_in_rounds_is_that_of_one_task(spark):
    r = random.Random(4)
    rows = {(min(a, b), max(a, b)) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(200)) if a // 3 != b // 3}
    table = spark.createDataFrame([(a, b, a // 3, b // 3, 1.0, float(r.randrange(5))) for a, b in sorted(rows)], "node_a long, node_b long, ca long, cb long, gap_m double, cost double")
    one, many = (sorted(tuple(x) for x in healing.bridges(table, n).collect()) for n in (10**6, 0))
    assert one == many and 0 < len(one) < 20
    assert healing.bridges(table.limit(0), 0).count() == 0


def test_lines_of_edges(spark):
    plus = ["....#...."] * 4 + ["#########"] + ["....#...."] * 4
    rows = [("AOI_3_Paris_img84", r, c) for r, line in enumerate(plus) for c, x in enumerate(line) if x == "#"]
    nodes, edges = skeleton.graph_edges(spark.createDataFrame(rows, "scene string, r int, c int"), T)
    got = edges.orderBy("edge_id").collect()
    assert [e.edge_id for e in got] == [0, 1, 2, 3] and {e.scene for e in got} == {"AOI_3_Paris_img84"}
    at = {n.node_id: [n.x, n.y] for n in nodes.collect()}
    for e in got:
        assert e.pixel_count == 2 and len(e.coordinates) == 4
        assert np.allclose([e.coordinates[0], e.coordinates[-1]], [at[e.start_node], at[e.end_node]], atol=1e-12)
        steps = np.abs(np.diff(np.array(e.coordinates), axis=0)).max(axis=1)
        assert (steps < 2.1e-5).all() and 2 < e.length_m < 6
    assert skeleton.graph_edges(spark.createDataFrame([], "scene string, r int, c int"), T)[1].count() == 0
    with pytest.raises(Exception, match="rows and columns"):
        skeleton.node_clusters(spark.createDataFrame([("a", 0, 1 << 20)], "scene string, r int, c int"))


def thinned(cells):
    """Zhang-Suen thinning, a pixel at a time."""
    cells = set(cells)
    while True:
        before = len(cells)
        for turn in (0, 1):
            drop = []
            for r, c in cells:
                p = [(r + a, c + b) in cells for a, b in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
                n, e, s, w = p[0], p[2], p[4], p[6]
                rises = sum(not p[k] and p[(k + 1) % 8] for k in range(8))
                open_side = not (n and e and s) and not (e and s and w) if turn == 0 else not (n and e and w) and not (n and s and w)
                if 2 <= sum(p) <= 6 and rises == 1 and open_side:
                    drop.append((r, c))
            cells -= set(drop)
        if len(cells) == before:
            return cells


def test_thinning_and_dilation_one_pixel_at_a_time(spark):
    r = random.Random(2)
    cells = {(a + x, b + y) for a, b in ((r.randrange(30), r.randrange(30)) for _ in range(12)) for x in range(r.randrange(2, 7)) for y in range(r.randrange(2, 7))}
    df = spark.createDataFrame([("s", a, b) for a, b in cells] * 2, "scene string, r int, c int")
    assert {(x.r, x.c) for x in raster.skeletonize(df).collect()} == thinned(cells)
    bounds = spark.createDataFrame([("s", 33, 34)], "scene string, height int, width int")
    for radius, disk in ((3, True), (5, True), (2, False)):
        want = {(a + x, b + y) for a, b in cells for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if not disk or x * x + y * y <= radius * radius}
        got = [(x.r, x.c) for x in raster.dilate(df, radius, disk).collect()]
        assert set(got) == want and len(got) == len(want)
        assert {(x.r, x.c) for x in raster.dilate(df, radius, disk, bounds).collect()} == {(a, b) for a, b in want if 0 <= a < 33 and 0 <= b < 34}


def test_reroutes_against_whole_paths(spark):
    nodes, edges = tables(spark, *grid(4))
    every = paths.distances(edges, paths.all_sources(nodes), paths=True)
    removed = spark.createDataFrame([(5,), (9,)], "node_id long")
    cuts = removed.select(F.col("node_id").alias("scenario"), F.col("node_id").alias("cut_node"))
    got = {(x.scenario, x.s, x.t): x for x in paths.reroutes(nodes, edges, cuts, paths=True).collect()}
    assert set(got) == {(x.scenario, x.s, x.t) for x in failures.affected_by_node(every, removed).collect()}
    known = {(x.s, x.t): x for x in every.collect()}
    for (k, s, t), x in got.items():
        assert x.path_before == known[s, t].path and k in x.path_before and k not in x.path_after and x.after >= x.before
    line = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, length_m double")
    ends = spark.createDataFrame([(1,), (2,), (3,)], "node_id long")
    cut = spark.createDataFrame([(7, 1, 2)], "scenario long, cut_u long, cut_v long")
    assert sorted((x.scenario, x.s, x.t, x.before, x.after) for x in paths.reroutes(ends, line, cut).collect()) == [(7, 1, 2, 1.0, None), (7, 1, 3, 2.0, None)]
    assert {(x.s, x.t) for x in failures.affected_by_edge(paths.distances(line, paths.all_sources(ends), paths=True), 2, 1).collect()} == {(1, 2), (1, 3)}
    assert [tuple(x)[:3] for x in paths.single_pair(line, 1, 9).collect()] == [(1, 9, None)]


def test_efficiency_by_source(spark):
    nodes, edges = tables(spark, *grid(4))
    assert paths.efficiency(nodes, edges, connected=True).first() == paths.path_efficiency(nodes, paths.distances(edges, paths.all_sources(nodes))).first()
    alone = nodes.unionAll(spark.createDataFrame([(99,)], "node_id long"))
    assert paths.efficiency(alone, edges).first().pairs == 240
    with pytest.raises(Exception, match="not connected"):
        paths.efficiency(alone, edges, connected=True).collect()


def test_sampled_pairs_are_different(spark):
    for n, want in ((0, 0), (1, 0), (3, 6), (30, 500)):
        got = validation.sample_pairs(spark.createDataFrame([(10 * k,) for k in range(n)], "node_id long")).collect()
        assert len(got) == len(set(got)) == want and all(x.s != x.t for x in got)


def test_weighted_graph_and_its_report(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node_id long")
    edges = spark.createDataFrame([(0, 1, 2, 5.0, False), (1, 2, 1, 3.0, True), (2, 2, 9, 1.0, False), (3, 2, 3, 0.0, False), (4, 3, 3, 2.0, False)], "edge_id long, src long, dst long, length_m double, bridge boolean")
    kept = graph.weighted_graph(nodes, edges)
    assert [(r.src, r.dst, r.length_m) for r in kept.collect()] == [(1, 2, 3.0)]
    one = graph.graph_report(graph.drop_isolated(nodes, kept), kept).first()
    assert (one.nodes, one.edges, one.bridges, one.min_degree) == (2, 1, 1, 1)
    for n, e, what in ((nodes, kept.limit(0), "edges"), (nodes.limit(0), kept, "nodes")):
        with pytest.raises(Exception, match=f"no {what}"):
            graph.graph_report(n, e).collect()


@pytest.mark.parametrize("deflate", [True, False])
def test_rasters_as_bytes(deflate):
    data = (np.arange(150 * 33 * 3) % 251).reshape(150, 33, 3)
    for kind in ("uint8", "uint16", "int32", "float32", "float64"):
        raw = geotiff.encode(data.astype(kind), T, nodata=0, deflate=deflate)
        out, transform, nodata = geotiff.decode(raw)
        assert (out == data).all() and out.dtype.kind == np.dtype(kind).kind and np.allclose(transform, T) and nodata == 0
        assert (geotiff.decode(raw, (60, 5, 20, 100))[0] == data[60:80, 5:]).all() and geotiff.decode(raw, (200, 0, 5, 5))[0].size == 0
    with pytest.raises(ValueError):
        geotiff.decode(b"no raster at all")


def test_documents(spark, tmp_path):
    nodes = spark.createDataFrame([(k, k * 1.0, -k * 1.0, "endpoint", 1) for k in range(7)], "node_id long, x double, y double, node_type string, degree int")
    for per_file in (2, 100):
        documents.write_nodes(nodes, f"{tmp_path}/n{per_file}", per_file)
        assert sorted(documents.read_nodes(spark, f"{tmp_path}/n{per_file}").collect()) == sorted(nodes.collect())
    for name, fine in (("urn:ogc:def:crs:OGC:1.3:CRS84", True), ("EPSG:3857", False)):
        doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": name}}, "features": [{"geometry": {"coordinates": [1.0, 2.0]}, "properties": {"node_id": 5}}]}
        (tmp_path / f"{fine}.json").write_text(json.dumps(doc))
        if fine:
            assert documents.read_nodes(spark, f"{tmp_path}/{fine}.json").first().x == 1.0
        else:
            with pytest.raises(Exception, match="EPSG:3857"):
                documents.read_nodes(spark, f"{tmp_path}/{fine}.json").collect()
    edges = spark.createDataFrame([(0, 1, 2.5), (1, 2, None)], "src long, dst long, length_m double")
    documents.write_graphml(nodes, edges, f"{tmp_path}/g")
    back = documents.read_graphml(spark, f"{tmp_path}/g")
    assert sorted(tuple(r) for r in back[0].collect()) == [(k, k * 1.0, -k * 1.0) for k in range(7)] and sorted(map(str, back[1].collect())) == sorted(map(str, edges.collect()))
    documents.write_report(edges.limit(1), f"{tmp_path}/r")
    assert documents.read_report(spark, f"{tmp_path}/r").first().length_m == 2.5
    with pytest.warns(UserWarning):
        assert documents.read_report(spark, f"{tmp_path}/none") is None


def test_values(spark):
    one = spark.range(1).select(scalars.whole_id(F.lit("007")), scalars.whole_id(F.lit("n1")), scalars.thousands(F.lit(1234567)), scalars.percent(F.lit(0.031913)), scalars.any_data(F.lit(0), F.lit(None).cast("int")), scalars.any_data(F.lit(0), F.lit(3)), scalars.unscaled(F.lit(1.5), F.lit(200.0)), scalars.binarized(F.lit(0)))
    assert tuple(one.first()) == ("7", "n1", "1,234,567", "3.191300%", False, True, 200.0, 0)


@pytest.mark.parametrize("master, fine", [("local[4]", True), ("spark://h:7077", False), ("local-cluster[3,2,1000]", False)])
def test_no_local_folder_off_local_mode(master, fine):
    conf = {}
    session = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=types.SimpleNamespace(master=master))
    if fine:
        assert staging.shared_dir(session).startswith("file://")
    else:
        with pytest.raises(ValueError):
            staging.shared_dir(session)


def test_masks_combined(spark):
    sets = {"a": {(0, 1), (0, 2)}, "b": {(0, 2), (1, 1)}}
    a, b = (spark.createDataFrame([(0, *x) for x in sets[k]] * 2, "scene int, r int, c int") for k in "ab")
    for how, want in (("and", sets["a"] & sets["b"]), ("or", sets["a"] | sets["b"]), ("and not", sets["a"] - sets["b"])):
        assert {(x.r, x.c) for x in raster.combined(a, b, how).collect()} == want


def test_graphs_in_arrays(spark):
    rows = [(-4, -2, 1.0), (-2, 9, 2.0), (9, -4, 4.0), (9, 7, 1.0), (7, 7, 1.0), (7, 5, None), (None, 5, 1.0)]
    edges = spark.createDataFrame(rows, "src long, dst long, length_m double")
    nodes = spark.createDataFrame([(k,) for k in (-4, -2, 9, 7, 5)], "node_id long")
    got = {(r.s, r.t): r.dist for r in paths.distances(edges, paths.all_sources(nodes)).collect()}
    assert got[-4, 9] == 3 and got[-4, 7] == 4 and got[5, 5] == 0 and (5, 7) not in got and len(got) == 17
    by_node, by_edge = (x.collect() for x in paths.betweenness(nodes, edges.where("src <> dst and length_m is not null")))
    assert {r.node_id: round(r.bc * 12) for r in by_node} == {-4: 0, -2: 4, 9: 4, 7: 0, 5: 0}
    assert {(r.src, r.dst): round(r.bc * 20) for r in by_edge} == {(-4, -2): 6, (-2, 9): 8, (-4, 9): 0, (7, 9): 6}
    assert paths.distances(edges.limit(0), paths.all_sources(nodes)).where("s = t").count() == 5
    kept, paths.KNOWN = paths.KNOWN, 2
    graph = paths.Graph(*(np.array(x) for x in zip(*[(k, k + 1, 1.0) for k in range(9)])))
    assert graph.dijkstra(0)[0][9] == 9 and len(graph.known) <= 2
    paths.KNOWN = kept

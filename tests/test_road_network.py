import math

import duckdb
import pytest
from pyspark.sql import functions as F

from stradale.functions import affine, geo, scalars
from stradale.operators import graph, metrics, paths, raster, skeleton
from stradale.operators.components import connected_components
from stradale.operators.ordinal import numbered
from stradale.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def pixels(spark, *rows):
    return spark.createDataFrame([(0, r, c) for r, line in enumerate(rows) for c, x in enumerate(line) if x == "#"], "scene int, r int, c int")


def test_geodesic_of_a_published_line(spark):
    line = [(144 + 25 / 60 + 29.5244 / 3600, -(37 + 57 / 60 + 3.7203 / 3600), 143 + 55 / 60 + 35.3839 / 3600, -(37 + 39 / 60 + 10.1561 / 3600)), (2.25, 48.85, 2.25, 48.85)]
    rows = geo.with_geodesic(spark.createDataFrame(line, "a double, b double, c double, d double"), "a", "b", "c", "d").collect()
    assert math.isclose(rows[0].dist, 54972.271, abs_tol=2e-3) and math.isclose(rows[0].azimuth, 306.8681592, abs_tol=1e-6) and rows[1].dist == 0


def test_skeleton_goldens(spark):
    plus = ["....#...."] * 4 + ["#########"] + ["....#...."] * 4
    nodes, _ = skeleton.node_clusters(pixels(spark, *plus))
    assert sorted(r.degree for r in nodes.collect()) == [1, 1, 1, 1, 4]
    assert [r.pixels for r in skeleton.corridors(pixels(spark, *plus)).collect()] == [2, 2, 2, 2]
    assert skeleton.node_clusters(pixels(spark, ".#.", "#.#", ".#."))[0].count() == 0
    assert skeleton.corridors(pixels(spark, "#####")).first().pixels == 3


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40) if k % 7] + [(50, 50)], "src long, dst long")
    got = {r.vertex: r.component for r in connected_components(edges, few=few).collect()}
    assert all(got[k] == got[k + 1] for k in range(40) if k % 7) and got[50] == 50 and got[8] == 8 and got[14] == 8
    assert connected_components(edges.limit(0), few=few).count() == 0


def test_path_of_three(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node_id long")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, length_m double")
    by_node, by_edge = paths.betweenness(nodes, edges)
    assert {r.node_id: r.bc for r in by_node.collect()} == {1: 0, 2: 1, 3: 0}
    assert all(math.isclose(r.bc, 2 / 3) for r in by_edge.collect()) and paths.cut_edges(nodes, edges).count() == 2
    slow = {(r.s, r.t): r.dist for r in paths.relaxed_distances(edges, nodes.select(F.col("node_id").alias("s"))).collect()}
    assert slow == {(r.s, r.t): r.dist for r in paths.distances(edges, paths.all_sources(nodes)).collect()}


def test_numbers_without_one_task(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 13).alias("a"), "id").repartition(7)
    got = {r.id: r.rank for r in numbered(rows, F.desc("a"), "id").collect()}
    assert [x for x, _ in sorted(got.items(), key=lambda p: p[1])] == sorted(range(1000), key=lambda k: (-(k * 7919 % 13), k)) and set(got.values()) == set(range(1, 1001))
    assert numbered(rows.limit(0), "id").count() == 0


def test_lines_and_shapes(spark):
    one = spark.range(1).select(affine.without_repeats(F.array(*map(F.lit, (1, 1, 2, 1, 1)))).alias("a")).first()
    assert one.a == [1, 2, 1]
    table = spark.createDataFrame([(None, "2.5"), ("1.5", "9")], "x string, lon string")
    assert [r[0] for r in table.select(affine.first_coordinate(table, ("x", "lon", "longitude"))).collect()] == [2.5, 1.5]
    with pytest.raises(ValueError):
        affine.first_coordinate(table, ("y", "lat"))
    a = spark.createDataFrame([(1, 5, 5), (2, 5, 5), (3, 5, 5)], "scene int, height int, width int")
    assert {r.scene for r in affine.mismatched(a, spark.createDataFrame([(1, 5, 5), (2, 5, 6)], a.schema)).collect()} == {2, 3}


def test_small_rules(spark):
    one = spark.range(1).select(geo.angular_difference(F.lit(350.0), F.lit(10.0)).alias("a"), scalars.floor_percentile(F.sequence(F.lit(1), F.lit(10)), 0.95).alias("p"), scalars.readable_size(F.lit(1536)).alias("s")).first()
    assert tuple(one) == (20.0, 9, "1.50 KB")
    empty = spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")
    assert metrics.with_scores(empty, "mask").first().iou == 1.0 and metrics.with_scores(empty).first().iou == 0.0
    dot = pixels(spark, "#")
    assert [raster.dilate(dot, r, True).count() for r in (3, 5)] == [29, 81]
    assert raster.tile_windows(spark.createDataFrame([(0, 1300, 1300)], "scene int, height int, width int")).count() == 36
    thick = raster.skeletonize(pixels(spark, "#####", "#####", "#####"))
    assert 0 < thick.count() < 5
    multi = spark.createDataFrame([(1, 2, 5.0, 1), (2, 1, 3.0, 2), (1, 1, 1.0, 3)], "src long, dst long, length_m double, seq long")
    assert graph.simple_graph(multi, "seq").first().length_m == 3.0 and graph.simple_graph(multi, "seq").count() == 1


@pytest.mark.parametrize("name", ["edge_length_summary", "simple_graph_dedup", "component_sizes", "gap_candidates", "confusion_metrics", "split_summary", "band_stats", "dilate_disk", "tile_manifest", "pixel_extent", "scene_split", "node_betweenness_rank", "edge_betweenness_rank", "reroutable_edge", "graph_edges", "healed_edges", "weighted_graph_report", "sample_routes", "od_sample", "geotiff_window", "graphml_round_trip", "mask_algebra"])
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in ("supplier", "customer", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    got = QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in got)

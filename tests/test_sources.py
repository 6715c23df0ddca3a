from pyspark.sql import functions as F

from stradale.operators import occlusion
from stradale.plans.registry import QUERIES
from stradale.sources import documents as d


def test_round_trips(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 2.0, 48.0, "endpoint", 1), (2, 2.1, 48.1, "endpoint", 1)], "node_id long, x double, y double, node_type string, degree int")
    edges = spark.createDataFrame([(0, 1, 2, 5.0, 3, False, None, [[2.0, 48.0], [2.1, 48.1]])], "edge_id long, src long, dst long, length_m double, pixel_count int, bridge boolean, bridge_method string, coordinates array<array<double>>")
    d.write_nodes(nodes, f"{tmp_path}/n"), d.write_edges(edges, f"{tmp_path}/e")
    assert sorted(d.read_nodes(spark, f"{tmp_path}/n").collect()) == sorted(nodes.collect())
    assert d.read_edges(spark, f"{tmp_path}/e").collect() == edges.collect()
    d.write_node_link(nodes, edges, f"{tmp_path}/link")
    assert d.read_report(spark, f"{tmp_path}/link").first().edges[0].target == 2
    (tmp_path / "g.graphml").write_text('<graphml><key id="d0" for="node" attr.name="x"/><key id="d1" for="edge" attr.name="weight"/><graph><node id="1"><data key="d0">2.5</data></node><node id="2"/><edge source="1" target="2"><data key="d1">7.5</data></edge></graph></graphml>')
    n, e = d.read_graphml(spark, f"{tmp_path}/g.graphml")
    assert {(r.node_id, r.x) for r in n.collect()} == {(1, 2.5), (2, None)} and tuple(e.first()) == (1, 2, 7.5)
    files = d.list_files(spark, str(tmp_path))
    assert {r.dataset for r in d.inventory(files, str(tmp_path)).collect()} >= {"n", "e"}
    assert [r.folder for r in d.missing_folders(files, ["n", "nowhere"]).collect()] == ["nowhere"]


def test_occlusion(spark):
    rows = spark.range(64).select(F.lit(1).alias("tile"), F.floor(F.col("id") / 8).alias("r"), (F.col("id") % 8).alias("c"), *(F.lit(0.5).alias(b) for b in occlusion.BANDS))
    effects = rows.select("tile").distinct().select("tile", F.lit("vehicles").alias("effect"), F.lit(1).alias("turn"))
    out = occlusion.occlude(rows, effects, 8)
    mask = {(r.r, r.c) for r in occlusion.occlusion_mask(effects, 8).collect()}
    assert {(r.r, r.c) for r in out.where("occluded").collect()} == mask and mask and out.count() == 64
    assert {(r.r, r.c) for r in occlusion.difference_mask(rows, out).collect()} <= mask
    for name in ("occlude_tiles", "single_effects"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0

"""The road-network queries over fixtures derived from the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stradale.functions import affine, scalars
from stradale.functions.geo import angular_difference, with_geodesic
from stradale.operators import failures, graph, healing, metrics, occlusion, paths, raster, skeleton, validation
from stradale.operators.components import FEW, connected_components
from stradale.operators.ordinal import numbered
from stradale.plans.staging import materialize, new_path
from stradale.sources import documents, geotiff
from stradale.sources import fixtures as fx

SIZE, STRIDE = 64, 48
#: Pixels of a hundred-thousandth of a degree, from the north-west corner.
TRANSFORM = (1e-5, 0.0, 2.25, 0.0, -1e-5, 48.85)
THRESHOLDS = [0.1, 0.25, 0.35, 0.5, 0.65, 0.8]
TOP = 10


def _net(spark, sf_dir):
    """The largest component of the supplier lattice: path analyses are of connected graphs. Written once, as they read it often."""
    nodes, edges = fx.network(spark, sf_dir, "net")
    nodes, edges = graph.largest_component(nodes, materialize(edges, "edges"))
    return materialize(nodes, "nodes"), materialize(edges, "edges")


def edge_length_summary(spark, sf_dir):
    nodes, edges = fx.network(spark, sf_dir, "net")
    return graph.length_summary(graph.valid_edges(nodes, edges))


def node_degree_types(spark, sf_dir):
    return graph.degree_types(*fx.network(spark, sf_dir, "net"))


def simple_graph_dedup(spark, sf_dir):
    fx.tables(spark, sf_dir, "lineitem")
    rows = spark.sql(fx.PAIRS).where("v IS NOT NULL").withColumnsRenamed({"u": "src", "v": "dst"})
    return graph.simple_graph(rows, "seq").select("src", "dst", F.col("seq").cast("long"))


def component_sizes(spark, sf_dir):
    return graph.component_sizes(fx.network(spark, sf_dir, "heal")[1], None)


def largest_components(spark, sf_dir):
    return graph.component_sizes(fx.network(spark, sf_dir, "heal")[1], 20)


def endpoint_bearings(spark, sf_dir):
    return healing.endpoint_bearings(*fx.network(spark, sf_dir, "heal")).select("node_id", F.round("bearing", 6).alias("bearing"))


def _gaps(spark, sf_dir):
    """Nodes, edges, components and gap candidates of the customer lattice, each made once."""
    nodes, edges = fx.network(spark, sf_dir, "heal")
    edges = materialize(edges, "edges")
    components = materialize(connected_components(edges, few=FEW), "components")
    return nodes, edges, components, healing.gap_candidates(nodes, edges, components=components)


def gap_candidates(spark, sf_dir):
    return _gaps(spark, sf_dir)[3].select("node_a", "node_b", *(F.round(c, 6).alias(c) for c in ("gap_m", "angle_a", "angle_b")), F.round("cost", 9).alias("cost"))


def healing_bridges(spark, sf_dir):
    return healing.bridges(_gaps(spark, sf_dir)[3]).select("node_a", "node_b", F.round("gap_m", 6).alias("gap_m"))


def healing_report(spark, sf_dir):
    _, edges, components, gaps = _gaps(spark, sf_dir)
    return healing.healing_report(edges, healing.bridges(gaps), components)


def remaining_components(spark, sf_dir):
    _, _, components, gaps = _gaps(spark, sf_dir)
    return healing.remaining_components(healing.healed_components(components, materialize(healing.bridges(gaps), "bridges")))


def _healed(spark, sf_dir):
    nodes, edges, _, gaps = _gaps(spark, sf_dir)
    own = numbered(edges, "src", "dst").select(F.col("rank").cast("long").alias("edge_id"), "src", "dst", "length_m")
    return nodes, healing.healed_edges(own, healing.bridges(gaps))


def healed_edges(spark, sf_dir):
    rows = _healed(spark, sf_dir)[1]
    return rows.select("edge_id", "src", "dst", F.round("length_m", 6).alias("length_m"), "bridge", "bridge_method", *(F.round(c, 6).alias(c) for c in ("gap_m", "angle_a", "angle_b", "mean_angle", "cost")))


def weighted_graph_report(spark, sf_dir):
    """The healed network as a weighted graph: nodes without edges go first, then edges that do not count."""
    nodes, edges = _healed(spark, sf_dir)
    edges = materialize(edges, "healed")
    nodes = graph.drop_isolated(nodes, edges)
    return graph.graph_report(nodes, graph.weighted_graph(nodes, edges))


def all_pairs_shortest(spark, sf_dir):
    nodes, edges = _net(spark, sf_dir)
    return paths.distances(edges, paths.all_sources(nodes)).select("s", "t", F.round("dist", 6).alias("dist"))


def avg_path_efficiency(spark, sf_dir):
    nodes, edges = _net(spark, sf_dir)
    return paths.efficiency(nodes, edges, connected=True)


def node_betweenness_rank(spark, sf_dir):
    nodes, edges = _net(spark, sf_dir)
    by_node = paths.ranked(paths.betweenness(nodes, edges)[0], "node_id", top=TOP)
    placed = nodes.where("x IS NOT NULL AND y IS NOT NULL").select("node_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))
    return by_node.join(graph.degrees(nodes, edges), "node_id").join(placed, "node_id").select("rank", "node_id", "x", "y", "bc", "degree", "gatekeeper")


def edge_betweenness_rank(spark, sf_dir):
    return paths.ranked(paths.betweenness(*_net(spark, sf_dir))[1], "src", "dst", top=TOP).select("rank", "src", "dst", "bc")


def _central(by_node):
    return by_node.agg(F.count("*").alias("nodes"), F.round(F.max("bc"), 9).alias("max_bc"), F.round(F.avg("bc"), 9).alias("mean_bc"))


def centrality_summary(spark, sf_dir):
    return _central(paths.betweenness(*_net(spark, sf_dir))[0])


def bridge_edges(spark, sf_dir):
    return paths.cut_edges(*_net(spark, sf_dir)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def _gatekeepers(by_node):
    return paths.ranked(by_node, "node_id", top=TOP).where("gatekeeper").select("node_id")


def node_failure_scenarios(spark, sf_dir):
    nodes, edges = _net(spark, sf_dir)
    return failures.node_failures(nodes, edges, _gatekeepers(paths.betweenness(nodes, edges)[0]))


def _node_cuts(gatekeepers):
    return gatekeepers.select(F.col("node_id").alias("scenario"), F.col("node_id").alias("cut_node"))


def node_rerouting(spark, sf_dir):
    nodes, edges = _net(spark, sf_dir)
    return failures.reroute_totals(nodes, edges, _node_cuts(_gatekeepers(paths.betweenness(nodes, edges)[0])))


def _critical(by_edge):
    return failures.number_edges(paths.ranked(by_edge, "src", "dst", top=TOP).where("gatekeeper"))


def edge_failure_rerouting(spark, sf_dir):
    nodes, edges = _net(spark, sf_dir)
    return failures.reroute_totals(nodes, edges, _critical(paths.betweenness(nodes, edges)[1]))


def sample_routes(spark, sf_dir):
    """The first ten rerouted pairs of the critical edges, with the nodes on their paths."""
    nodes, edges = _net(spark, sf_dir)
    rows = failures.first_routes(nodes, edges, _critical(paths.betweenness(nodes, edges)[1]))
    return rows.select("scenario", "s", "t", *(F.round(c, 6).alias(c) for c in ("before", "after", "increase_m")), F.element_at("path_after", 1).alias("first"), F.element_at("path_after", -1).alias("last"), F.size("path_before").cast("long").alias("nodes_before"))


def reroutable_edge(spark, sf_dir):
    nodes, edges = _net(spark, sf_dir)
    return failures.first_reroutable_edge(nodes, edges, paths.betweenness(nodes, edges)[1])


def confusion_metrics(spark, sf_dir):
    rows = fx.mask(spark, sf_dir)
    counts = rows.agg(*metrics.confusion(F.col("p") >= 0.5, F.col("truth") == 1))
    forms = [metrics.with_scores(counts, f).withColumn("form", F.lit(f)) for f in ("zero", "epsilon", "mask")]
    return forms[0].unionByName(forms[1]).unionByName(forms[2])


def threshold_sweep(spark, sf_dir):
    return metrics.threshold_sweep(fx.mask(spark, sf_dir), THRESHOLDS)


def probability_stats(spark, sf_dir):
    return metrics.probability_stats(fx.mask(spark, sf_dir))


def prediction_difference(spark, sf_dir):
    rows = fx.mask(spark, sf_dir)
    return metrics.prediction_difference(rows, rows.withColumn("p", F.col("p") * F.col("p")), ["scene", "r", "c"])


def occlusion_recall(spark, sf_dir):
    return metrics.occlusion_recall(fx.mask(spark, sf_dir))


def _bounds(rows):
    return rows.groupBy("scene").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))


def relaxed_metrics(spark, sf_dir):
    rows = materialize(fx.mask(spark, sf_dir).select("scene", "r", "c", "p", "truth"), "mask")
    pred, truth, bounds = rows.where("p >= 0.5"), rows.where("truth = 1"), _bounds(rows)
    return metrics.relaxed(pred, truth, 3, bounds).unionByName(metrics.relaxed(pred, truth, 5, bounds))


def dilate_square(spark, sf_dir):
    skel = fx.skeleton(spark, sf_dir)
    return raster.dilate(skel, 5, False, _bounds(skel)).groupBy("scene").agg(F.count("*").alias("pixels"), F.sum("r").alias("sum_r"), F.sum("c").alias("sum_c"))


def dilate_disk(spark, sf_dir):
    skel = fx.skeleton(spark, sf_dir)
    return raster.dilate(skel, 3, True, _bounds(skel)).groupBy("scene").agg(F.count("*").alias("pixels"), F.sum("r").alias("sum_r"), F.sum("c").alias("sum_c"))


def tile_windows(spark, sf_dir):
    return raster.tile_windows(_bounds(fx.mask(spark, sf_dir)), SIZE, STRIDE)


def stitch_mosaic(spark, sf_dir):
    rows = fx.mask(spark, sf_dir)
    tiles = raster.cut_tiles(rows, raster.tile_windows(_bounds(rows), SIZE, STRIDE), SIZE, STRIDE)
    tiles = tiles.withColumn("p", F.col("p") + F.expr("((tile*13)%7-3)*1e-3"))
    out = raster.mask_nodata(raster.stitch(tiles, rows.select("scene", "r", "c")), rows.where("(r + c) % 5 <> 0"))
    return out.groupBy("scene", "n").agg(F.count("*").alias("pixels"), F.round(F.sum("p"), 6).alias("sum_p"))


def tile_manifest(spark, sf_dir):
    rows = fx.mask(spark, sf_dir)
    return raster.tile_manifest(raster.cut_tiles(rows, raster.tile_windows(_bounds(rows), SIZE, STRIDE), SIZE, STRIDE))


def pixel_extent(spark, sf_dir):
    """Bounds of each scene, and the extremes and means of its skeleton's pixel centres."""
    skel = fx.skeleton(spark, sf_dir)
    x, y = affine.pixel_centre(F.col("r"), F.col("c"), TRANSFORM)
    own = skel.select("scene", x.alias("x"), y.alias("y")).groupBy("scene").agg(F.min("x").alias("min_x"), F.max("y").alias("max_y"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    out = affine.raster_bounds(_bounds(skel), TRANSFORM).join(own, "scene")
    return out.select("scene", *(F.round(c, 8).alias(c) for c in out.columns[1:]))


def _manifest(spark, sf_dir):
    fx.tables(spark, sf_dir, "part")
    return spark.sql(fx.MANIFEST)


def scene_split(spark, sf_dir):
    return raster.split_scenes(_manifest(spark, sf_dir))


def split_summary(spark, sf_dir):
    rows = _manifest(spark, sf_dir)
    return raster.split_summary(rows.join(raster.split_scenes(rows), "scene"))


def class_balance(spark, sf_dir):
    return raster.class_balance(_manifest(spark, sf_dir))


def positive_sampling_share(spark, sf_dir):
    return raster.weighted_share(_manifest(spark, sf_dir))


def positive_sampling(spark, sf_dir):
    """As many weighted draws as there are tiles: how many of them have roads, and how many different ones were drawn."""
    out = raster.weighted_draw(_manifest(spark, sf_dir), ["scene", "tile"])
    return out.agg(F.count("*").alias("draws"), F.count_if(F.col("road_pixels") > 0).alias("with_road"), F.count_distinct("scene", "tile").alias("different"))


def image_mask_manifest(spark, sf_dir):
    """Tiles of the parts table, an image and a mask each, joined by split, scene and tile."""
    rows = _manifest(spark, sf_dir)
    rows = rows.join(raster.split_scenes(rows), "scene").withColumns({"height": F.lit(256), "width": F.lit(256), "channels": F.lit(3)})
    at = lambda kind: F.format_string(f"%s/{kind}/%s/%s", "split", F.col("scene").cast("string"), scalars.tile_name(F.col("scene").cast("string"), F.col("tile")))
    return raster.paired_manifest(rows.withColumn("path", at("images")), rows.withColumn("path", at("masks")))


def _bands(spark, sf_dir):
    fx.tables(spark, sf_dir, "part")
    return spark.sql(fx.BAND)


def band_stats(spark, sf_dir):
    return raster.band_stats(_bands(spark, sf_dir))


def normalize_pixels(spark, sf_dir):
    rows = _bands(spark, sf_dir)
    out = raster.normalize(rows, raster.band_stats(rows))
    return raster.minmax_by_tile(out, "g").select("tile", "pixel", *(f"{b}_{k}" for b in "rgb" for k in "zu"), "g_m")


def skeleton_degree(spark, sf_dir):
    return raster.pixel_degrees(fx.skeleton(spark, sf_dir)).groupBy("scene", "degree").agg(F.count("*").alias("pixels"))


def node_clusters(spark, sf_dir):
    nodes = skeleton.node_clusters(fx.skeleton(spark, sf_dir))[0]
    return nodes.select("scene", "node_id", "pixels", F.round("row", 6).alias("row"), F.round("col", 6).alias("col"), "degree", "node_type")


def corridor_edges(spark, sf_dir):
    return skeleton.corridors(fx.skeleton(spark, sf_dir)).groupBy("scene", "start_node", "end_node").agg(F.count("*").alias("edges"), F.sum("pixels").alias("pixels"))


def graph_edges(spark, sf_dir):
    """The edges of the skeletons, whose scenes have names, with their lengths and the points of their lines."""
    named = fx.skeleton(spark, sf_dir).withColumn("scene", F.concat(F.lit("scene_"), F.col("scene").cast("string")))
    edges = skeleton.graph_edges(named, TRANSFORM)[1]
    return edges.select("scene", "edge_id", "start_node", "end_node", "pixel_count", F.round("length_m", 6).alias("length_m"), F.size("coordinates").cast("long").alias("points"))


def skeletonize(spark, sf_dir):
    return raster.skeletonize(fx.mask(spark, sf_dir).where("truth = 1"))


def nearest_snap(spark, sf_dir):
    nodes = fx.network(spark, sf_dir, "net")[0]
    points = fx.network(spark, sf_dir, "heal")[0].selectExpr("node_id AS point_id", "x AS px", "y AS py")
    return validation.nearest(points, nodes).select("point_id", "node_id", F.round("dist", 6).alias("dist"))


def _two_networks(spark, sf_dir):
    nodes, edges = _net(spark, sf_dir)
    return nodes, edges, edges.withColumn("length_m", F.col("length_m") * (1 + (F.col("src") % 7) * F.expr("1e-2")))


def od_path_error(spark, sf_dir):
    rows = validation.network_errors(*_two_networks(spark, sf_dir))
    return rows.select("s", "t", *(F.round(c, 6).alias(c) for c in ("length_m", "reference_m", "abs_error_m", "error_pct")))


def path_error_summary(spark, sf_dir):
    return validation.network_error_summary(*_two_networks(spark, sf_dir))


def od_sample(spark, sf_dir):
    return validation.sample_pairs(_net(spark, sf_dir)[0])


def highway_histogram(spark, sf_dir):
    fx.tables(spark, sf_dir, "orders")
    return validation.tag_histogram(spark.sql(fx.for_spark(fx.TAGS)), "highway")


def results_summary(spark, sf_dir):
    """Nine reports as one nested document, its figures as columns; parts that are missing are null."""
    nodes, edges = _net(spark, sf_dir)
    by_node, by_edge = paths.betweenness(nodes, edges)
    gates = materialize(_gatekeepers(by_node), "gatekeepers")
    failed = failures.node_failures(nodes, edges, gates).agg(F.count("*").alias("scenarios"), F.round(F.avg("resilience_index"), 6).alias("mean_resilience"))
    detours = lambda cuts: failures.reroute_totals(nodes, edges, cuts).agg(F.sum("affected").alias("affected"), F.sum("reroutable").alias("reroutable"))
    reports = {
        "network": edge_length_summary(spark, sf_dir), "baseline": paths.efficiency(nodes, edges, connected=True), "tiles": class_balance(spark, sf_dir), "healing": healing_report(spark, sf_dir), "centrality": _central(by_node),
        "node_failures": failed, "node_detours": detours(_node_cuts(gates)), "edge_detours": detours(_critical(by_edge)), "validation": path_error_summary(spark, sf_dir),
    }
    # a row each, told one after the other: in one plan the driver would hold the broadcasts of all nine at once
    kinds = T.StructType([T.StructField(name, report.schema) for name, report in reports.items()])
    one = spark.createDataFrame([tuple(report.first() for report in reports.values())], kinds)
    told = ("network.edges", "network.total_length_m", "baseline.n", "baseline.avg_path_m", "baseline.efficiency_all", "tiles.road_fraction", "healing.components_before", "healing.components_after", "healing.bridges", "centrality.max_bc", "node_failures.scenarios", "node_failures.mean_resilience")
    return one.select(*told, F.col("node_detours.affected").alias("node_affected"), F.col("node_detours.reroutable").alias("node_reroutable"), F.col("edge_detours.affected").alias("edge_affected"), F.col("edge_detours.reroutable").alias("edge_reroutable"), "validation.mean_abs_m", "validation.max_pct")


def mask_algebra(spark, sf_dir):
    """Predicted and true masks combined: pixels by scene of both, of any, and of the predicted that are not true."""
    rows = materialize(fx.mask(spark, sf_dir).select("scene", "r", "c", "p", "truth"), "mask")
    pred, truth = rows.where("p >= 0.5"), rows.where("truth = 1")
    count = lambda how: raster.combined(pred, truth, how).groupBy("scene").agg(F.count("*").alias("pixels"), F.sum("c").alias("sum_c")).withColumn("how", F.lit(how))
    return count("and").unionByName(count("or")).unionByName(count("and not"))


def scalar_functions(spark, sf_dir):
    """Names, angles, ratios and times, row by row."""
    fx.tables(spark, sf_dir, "supplier")
    s = spark.table("supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    a, b = F.col("k") * 7919 % 360, F.col("k") * 104729 % 360
    return s.select(
        "k", scalars.tile_name(F.concat(F.lit("AOI_"), F.col("k").cast("string")), F.col("s_nationkey")).alias("tile_name"), scalars.scene_of(F.concat(F.lit("RGB-PanSharpen_AOI_"), F.col("k").cast("string"))).alias("scene_id"),
        angular_difference(a.cast("double"), b.cast("double")).alias("angle"), F.pmod(a + 180, F.lit(360)).alias("reverse"), F.round(scalars.ratio(a, b, -1.0), 9).alias("ratio"), F.round(scalars.epsilon_ratio(a, b), 6).alias("eps"),
        F.round(scalars.percent_change(b.cast("double"), a.cast("double")), 6).alias("change"), F.round(scalars.travel_seconds(a.cast("double")), 6).alias("seconds"), F.round(scalars.sigmoid(F.col("s_nationkey") - 12), 9).alias("sigmoid"), scalars.node_type(F.col("s_nationkey") % 5).alias("node_type"), scalars.whole_id(F.when(F.col("k") % 3 == 0, F.lit("x7")).otherwise(F.lit("007"))).alias("maybe_id"), scalars.binarized(F.col("s_nationkey") - 12).alias("binary"), F.round(scalars.unscaled(scalars.scaled(F.col("s_nationkey") - 3.0, F.lit(20.0)), F.lit(20.0)), 6).alias("unscaled"), scalars.any_data(F.col("s_nationkey") % 2, F.when(F.col("k") % 5 > 0, F.col("k") % 3)).alias("valid"),
    )


def geodesic_pairs(spark, sf_dir):
    nodes = fx.network(spark, sf_dir, "net")[0]
    far = nodes.selectExpr("node_id - 13 AS node_id", "x AS x2", "y AS y2")
    out = with_geodesic(nodes.join(far, "node_id"), "x", "y", "x2", "y2")
    return out.select("node_id", F.round("dist", 6).alias("dist"), F.round("azimuth", 6).alias("azimuth"))


#: Sides of the tiles of the parts table.
SIDE = 16


def _painted(spark, sf_dir):
    """Tiles of ``SIDE`` by ``SIDE`` parts, a part a pixel; two of three have roads."""
    fx.tables(spark, sf_dir, "part")
    return spark.sql(f"SELECT p_partkey DIV {SIDE * SIDE} AS tile, (p_partkey DIV {SIDE}) % {SIDE} AS r, p_partkey % {SIDE} AS c, (p_partkey DIV {SIDE * SIDE}) % 3 < 2 AS has_road, p_size / 50D AS red, p_retailprice / 2000D AS green, (p_partkey % 10) / 10D AS blue FROM part")


def occlude_tiles(spark, sf_dir):
    """Tiles with roads, half of them occluded: pixels, occluded ones, those that differ, and brightness, by tile."""
    rows = _painted(spark, sf_dir)
    out = occlusion.occlude(rows, occlusion.chosen_effects(occlusion.gated(rows.select("tile", "has_road").distinct(), 0.5)), SIDE)
    differ = occlusion.difference_mask(rows, out).groupBy("tile").agg(F.count("*").alias("changed"))
    told = out.groupBy("tile").agg(F.count("*").alias("pixels"), F.count_if("occluded").alias("occluded"), F.round(F.avg("red"), 6).alias("mean_red"))
    return told.join(differ, "tile", "left").withColumn("changed", F.coalesce("changed", F.lit(0)))


def single_effects(spark, sf_dir):
    """Mean of the red band under each effect alone, and the pixels that its mask hides in the same tiles."""
    rows, out = _painted(spark, sf_dir), []
    for effect in occlusion.EFFECTS:
        alone = rows.select("tile").distinct().withColumns({"effect": F.lit(effect), "turn": F.lit(1)})
        red = occlusion.single_effect(rows, effect, SIDE).agg(F.round(F.avg("red"), 6).alias("mean_red"))
        out.append(occlusion.occlusion_mask(alone, SIDE).agg(F.lit(effect).alias("effect"), F.count("*").alias("hidden")).join(F.broadcast(red)))
    return reduce(DataFrame.unionByName, out)


def _tiles(spark, sf_dir):
    rows = fx.mask(spark, sf_dir)
    return raster.cut_tiles(rows, raster.tile_windows(_bounds(rows), SIZE, STRIDE), SIZE, STRIDE)


def positive_tile_stats(spark, sf_dir):
    """Statistics of the probabilities in tiles that hold a road."""
    return metrics.probability_stats(raster.positive_tiles(_tiles(spark, sf_dir)))


def formatted_balance(spark, sf_dir):
    one = class_balance(spark, sf_dir)
    return one.select(scalars.thousands(F.col("road")).alias("road"), scalars.thousands(F.col("background")).alias("background"), scalars.percent(F.col("road_fraction")).alias("road_percent"))


def single_pair(spark, sf_dir):
    """From the smallest node of the network to the largest, and to one that is not in it."""
    nodes, edges = _net(spark, sf_dir)
    ends = nodes.agg(F.min("node_id").alias("a"), F.max("node_id").alias("b")).first()
    if ends.a is None:
        return paths.single_pair(edges, -1, -2).select("s", "t", "dist").limit(0)
    both = paths.single_pair(edges, ends.a, ends.b).unionAll(paths.single_pair(edges, ends.a, -1))
    return both.select("s", "t", F.round("dist", 6).alias("dist"), F.element_at("path", 1).alias("first"), F.element_at("path", -1).alias("last"))


def directed_to_undirected(spark, sf_dir):
    """Of parallel edges, in either direction, the shortest; of equal ones the first."""
    fx.tables(spark, sf_dir, "lineitem")
    rows = spark.sql(fx.PAIRS).where("v IS NOT NULL").selectExpr("u AS src", "v AS dst", "seq", "CAST(seq % 997 AS DOUBLE) AS length_m")
    return graph.simple_graph(rows, "seq", keep="shortest", length="length_m").select("src", "dst", F.col("seq").cast("long"), "length_m")


def geojson_round_trip(spark, sf_dir):
    """Nodes and edges of the network, written as GeoJSON and read back: ids, places, degrees, lengths and ends of lines."""
    nodes, edges = fx.network(spark, sf_dir, "net")
    typed = nodes.join(graph.degrees(nodes, edges), "node_id").withColumn("node_type", scalars.node_type(F.col("degree")))
    place = lambda c: nodes.select(F.col("node_id").alias(c), F.array("x", "y").alias(f"{c}_at"))
    drawn = numbered(edges, "src", "dst", name="edge_id").join(place("src"), "src").join(place("dst"), "dst")
    drawn = drawn.select("edge_id", "src", "dst", "length_m", F.lit(0).alias("pixel_count"), F.lit(False).alias("bridge"), F.lit(None).cast("string").alias("bridge_method"), F.array("src_at", "dst_at").alias("coordinates"))
    at, on = new_path(spark, "nodes"), new_path(spark, "edges")
    documents.write_nodes(typed, at)
    documents.write_edges(drawn, on)
    points = documents.read_nodes(spark, at).select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), "x", "y", F.col("degree").cast("double").alias("value"))
    lines = documents.read_edges(spark, on).select(F.lit("edge"), "edge_id", F.col("coordinates")[0][0], F.col("coordinates")[1][1], F.round("length_m", 6))
    return points.unionAll(lines)


def graphml_round_trip(spark, sf_dir):
    """Edges of the network with the places of their ends, written as GraphML and read back."""
    at = new_path(spark, "graphml")
    documents.write_graphml(*fx.network(spark, sf_dir, "net"), at)
    nodes, edges = documents.read_graphml(spark, at)
    ends = nodes.select(F.col("node_id").alias("src"), "x", "y")
    return edges.join(ends, "src").select("src", "dst", F.round("length_m", 6).alias("length_m"), "x", "y")


def manifest_round_trip(spark, sf_dir):
    """The training rows of a manifest that is written as CSV and read back."""
    rows = _manifest(spark, sf_dir)
    rows = rows.join(raster.split_scenes(rows), "scene")
    name = F.format_string("scene_%d_tile_%03d.tif", "scene", "tile")
    full = rows.select("split", F.concat(F.lit("scene_"), F.col("scene").cast("string")).alias("scene_id"), name.alias("tile"), F.concat(F.lit("images/"), name).alias("image_path"), F.concat(F.lit("masks/"), name).alias("mask_path"), F.lit(3).alias("channels"), F.lit(256).alias("height"), F.lit(256).alias("width"), F.col("road_pixels").cast("long"), (F.col("road_pixels") / F.col("pixels")).alias("road_fraction"), (F.col("road_pixels") > 0).alias("has_road"))
    at = new_path(spark, "manifest")
    documents.write_manifest(full, at)
    return documents.read_manifest(spark, at, "train").select("scene_id", "tile", "image_path", "channels", "road_pixels", F.round("road_fraction", 9).alias("road_fraction"), "has_road")


def geotiff_window(spark, sf_dir):
    """Masks written as GeoTIFF files, a raster per scene, and a window of their second band read back, summed by scene."""
    at = new_path(spark, "tiffs")
    files = geotiff.write(fx.mask(spark, sf_dir).select("scene", "r", "c", F.col("p").cast("double").alias("p"), "truth"), at, TRANSFORM, ("p", "truth"))
    files.agg(F.count("*")).collect()  # writes them
    rows = geotiff.read(spark, at, bands=[2], window=(10, 20, 40, 50))
    scene = F.regexp_extract("path", "([0-9]+)[.]tif$", 1).cast("long")
    return rows.groupBy(scene.alias("scene")).agg(F.count("*").alias("pixels"), F.sum("b2").cast("long").alias("road"), F.min("r").alias("top"), F.max("c").alias("right"))


def rasterized_lines(spark, sf_dir):
    """Pixels that lines between parts of a plane touch, by scene."""
    fx.tables(spark, sf_dir, "supplier")
    lines = spark.sql(fx.SEGMENTS)
    return raster.rasterize(lines).groupBy("scene").agg(F.count("*").alias("pixels"), F.sum("r").alias("sum_r"), F.sum("c").alias("sum_c"))

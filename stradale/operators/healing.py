"""Bridging gaps between road fragments: candidates near and in line, then a minimum spanning forest of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stradale.functions.geo import angular_difference, reverse_bearing, with_geodesic
from stradale.operators.components import FEW, connected_components
from stradale.operators.graph import degrees
from stradale.operators.ordinal import numbered
from stradale.plans.staging import discard, materialize

MAX_GAP_M, MAX_ANGLE = 100.0, 45.0
#: Candidates that one task may hold; beyond it forests are found by rounds of cheapest links.
MAX_KRUSKAL = 2_000_000


def endpoint_bearings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with one edge, and the bearing in which their road would go on: ``node_id, x, y, bearing``."""
    ends = degrees(nodes, edges).where("degree = 1").select("node_id")
    both = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other")).unionAll(edges.select(F.col("dst"), F.col("src")))
    far = nodes.select(F.col("node_id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    rows = both.join(ends, "node_id", "left_semi").join(nodes.select("node_id", "x", "y"), "node_id").join(far, "other")
    return with_geodesic(rows, "x", "y", "ox", "oy").select("node_id", "x", "y", reverse_bearing(F.col("azimuth")).alias("bearing"))


def gap_candidates(nodes: DataFrame, edges: DataFrame, max_gap: float = MAX_GAP_M, max_angle: float = MAX_ANGLE, components: DataFrame | None = None) -> DataFrame:
    """Pairs of ends of different components, near each other and each in line with the gap, with their cost.

    Ends meet in cells of a grid: each is sent to its own cell and the eight around it, so no pair further apart is made. Columns of
    the grid are as wide as the gap at the latitude of their row's edge farthest from the equator. ``components(vertex, component)``
    are found if not given.
    """
    comp = (components if components is not None else connected_components(edges, few=FEW)).select(F.col("vertex").alias("node_id"), "component")
    tall = max_gap / 110_000.0
    row = F.floor(F.col("y") / tall)
    # a step north or south changes the width, so each end looks for cells of the row that it visits
    width = lambda r: max_gap / (111_000.0 * F.greatest(F.cos(F.radians(F.least(F.greatest(F.abs(r), F.abs(r + 1)) * tall, F.lit(89.9)))), F.lit(1e-3)))
    ends = endpoint_bearings(nodes, edges).join(comp, "node_id").withColumn("cy", row).withColumn("cx", F.floor(F.col("x") / width(F.col("cy"))))
    left = ends.selectExpr("node_id AS node_a", "x AS xa", "y AS ya", "bearing AS ba", "component AS ca", "cx", "cy")
    right = ends.selectExpr("node_id AS node_b", "x AS xb", "y AS yb", "bearing AS bb", "component AS cb", "cy AS own")
    right = right.select("*", F.explode(F.sequence(F.col("own") - 1, F.col("own") + 1)).alias("cy")).withColumn("at", F.floor(F.col("xb") / width(F.col("cy"))))
    right = right.select("node_b", "xb", "yb", "bb", "cb", "cy", F.explode(F.sequence(F.col("at") - 1, F.col("at") + 1)).alias("cx"))
    pairs = left.join(right, ["cx", "cy"]).where("node_a < node_b AND ca <> cb")
    near = with_geodesic(pairs, "xa", "ya", "xb", "yb", "gap_m", "az").where(F.col("gap_m") <= max_gap)
    back = with_geodesic(near, "xb", "yb", "xa", "ya", "gap_back", "az_back")
    told = back.withColumns({"angle_a": angular_difference(F.col("ba"), F.col("az")), "angle_b": angular_difference(F.col("bb"), F.col("az_back"))})
    told = told.where((F.col("angle_a") <= max_angle) & (F.col("angle_b") <= max_angle))
    mean = (F.col("angle_a") + F.col("angle_b")) / 2
    return told.select("node_a", "node_b", "ca", "cb", "gap_m", "angle_a", "angle_b", (F.col("gap_m") / max_gap + mean / max_angle).alias("cost"))


def _kruskal(rows: pd.DataFrame) -> pd.DataFrame:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    rows, keep = rows.sort_values(["cost", "node_a", "node_b"]), []
    for a, b in zip(rows.ca, rows.cb):
        p, q = find(a), find(b)
        keep.append(p != q)
        parent[max(p, q)] = min(p, q)
    return rows[keep]


def bridges(candidates: DataFrame, one_task: int = MAX_KRUSKAL) -> DataFrame:
    """The candidates that join two components not joined by cheaper ones. Ties go to the smaller nodes.

    Candidates fall into groups of components that they connect; each group is a task. Where a group has more than ``one_task``
    candidates, the forest is found in rounds: every component takes its cheapest candidate, and what these join is one component.
    The order of candidates is total, so both ways give the same forest.
    """
    candidates = materialize(candidates, "candidates")
    groups = connected_components(candidates, "ca", "cb", few=FEW).select(F.col("vertex").alias("ca"), F.col("component").alias("grp"))
    rows = candidates.join(groups, "ca")
    if rows.groupBy("grp").count().where(F.col("count") > one_task).isEmpty():
        return rows.groupBy("grp").applyInPandas(_kruskal, rows.schema).select(*candidates.columns)
    left = materialize(candidates.select("node_a", "node_b", "cost", F.col("ca").alias("p"), F.col("cb").alias("q")), "left")
    picked = None
    while not left.isEmpty():
        ends = left.select(F.col("p").alias("c"), "cost", "node_a", "node_b", "p", "q").unionAll(left.select("q", "cost", "node_a", "node_b", "p", "q"))
        least = ends.groupBy("c").agg(F.min(F.struct("cost", "node_a", "node_b", "p", "q")).alias("b")).select("b.*").distinct()
        least = materialize(least, "least")
        picked = least.select("node_a", "node_b") if picked is None else picked.unionAll(least.select("node_a", "node_b"))
        joined = connected_components(least, "p", "q", few=FEW)
        now = left
        for c in ("p", "q"):  # every component that is left has taken a candidate, so all are joined with another
            now = now.join(joined.select(F.col("vertex").alias(c), F.col("component").alias("into")), c).withColumn(c, F.col("into")).drop("into")
        further = materialize(now.where("p <> q").select("node_a", "node_b", "cost", "p", "q"), "left")
        discard(left)
        left = further
    return candidates.join(picked, ["node_a", "node_b"], "left_semi").select(*candidates.columns)


def heal(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with the bridges added: ``src, dst, length_m, bridge``."""
    return edges.select("src", "dst", "length_m", F.lit(False).alias("bridge")).unionAll(chosen.select("node_a", "node_b", "gap_m", F.lit(True)))


def healed_edges(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """``edges(edge_id, src, dst, length_m)`` and the bridges, whose ids go on from the largest, cheapest first: ``edge_id, src, dst,
    length_m, bridge, bridge_method, gap_m, angle_a, angle_b, mean_angle, cost``; what only bridges have is null elsewhere."""
    own = edges.select("edge_id", "src", "dst", "length_m", F.lit(False).alias("bridge"))
    last = edges.agg(F.coalesce(F.max("edge_id"), F.lit(-1)).alias("_last"))
    mean = (F.col("angle_a") + F.col("angle_b")) / 2
    new = numbered(chosen, "cost", "node_a", "node_b").crossJoin(F.broadcast(last)).select(
        (F.col("_last") + F.col("rank")).cast("long").alias("edge_id"), F.col("node_a").alias("src"), F.col("node_b").alias("dst"), F.col("gap_m").alias("length_m"), F.lit(True).alias("bridge"),
        F.lit("mst_dsu").alias("bridge_method"), "gap_m", "angle_a", "angle_b", mean.alias("mean_angle"), "cost",
    )
    return own.unionByName(new, allowMissingColumns=True)


def healed_components(components: DataFrame, chosen: DataFrame) -> DataFrame:
    """``component, size`` after the bridges, from ``components(vertex, component)`` before them: only these are joined, not the edges again."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    joined = connected_components(chosen, "ca", "cb", few=FEW).select(F.col("vertex").alias("component"), F.col("component").alias("into"))
    return sizes.join(joined, "component", "left").groupBy(F.coalesce("into", "component").alias("component")).agg(F.sum("n").alias("size"))


def remaining_components(healed: DataFrame) -> DataFrame:
    """Those of ``component, size`` that are smaller than the largest."""
    return healed.crossJoin(F.broadcast(healed.agg(F.max("size").alias("_most")))).where("size < _most").drop("_most")


def healing_report(edges: DataFrame, chosen: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Components and lengths before and after, and how much the largest component grew in percent."""
    components = components if components is not None else materialize(connected_components(edges, few=FEW), "components")
    chosen = materialize(chosen, "bridges")
    healed = materialize(healed_components(components, chosen), "healed")
    before = components.groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components_before"), F.max("n").alias("largest_before"))
    after = healed.agg(F.count("*").alias("components_after"), F.max("size").alias("largest_after"))
    rest = remaining_components(healed).agg(F.count("*").alias("remaining_components"))
    added = chosen.agg(F.count("*").alias("bridges"), F.round(F.coalesce(F.sum("gap_m"), F.lit(0.0)), 6).alias("bridge_length_m"))
    own = edges.agg(F.count("*").alias("edges"), F.round(F.sum("length_m"), 6).alias("length_m"))
    one = before.crossJoin(after).crossJoin(added).crossJoin(own).crossJoin(rest)
    grown = F.when(F.col("largest_before") > 0, (F.col("largest_after") - F.col("largest_before")) / F.col("largest_before") * 100).otherwise(0.0)
    return one.withColumn("connectivity_gain_pct", F.round(grown, 9))

"""Simple graphs from edge lists: deduplication, degrees, summaries, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stradale.functions.scalars import node_type
from stradale.operators.components import FEW, connected_components


def simple_graph(edges: DataFrame, seq: str, keep: str = "last", length: str | None = None) -> DataFrame:
    """One row per undirected pair, ``src < dst``, without self-loops; of parallel edges the last by ``seq``, or the shortest."""
    order = [F.col(length), F.col(seq)] if keep == "shortest" else [F.desc(seq)]
    pairs = edges.where("src <> dst").withColumns({"_u": F.least("src", "dst"), "_v": F.greatest("src", "dst")})
    ranked = pairs.withColumn("_k", F.row_number().over(W.partitionBy("_u", "_v").orderBy(*order)))
    return ranked.where("_k = 1").drop("_k", "src", "dst").withColumnsRenamed({"_u": "src", "_v": "dst"})


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, degree`` for all nodes, 0 for isolated ones."""
    ends = edges.select(F.col("src").alias("node_id")).unionAll(edges.select(F.col("dst").alias("node_id")))
    return nodes.select("node_id").join(ends.groupBy("node_id").agg(F.count("*").alias("degree")), "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def drop_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node_id")).unionAll(edges.select(F.col("dst").alias("node_id")))
    return nodes.join(ends, "node_id", "left_semi")


def valid_edges(nodes: DataFrame, edges: DataFrame, length: str = "length_m") -> DataFrame:
    """Edges with both ends known and a positive length."""
    ids = nodes.select("node_id")
    kept = edges.where(F.col(length) > 0).join(ids, F.col("src") == ids.node_id, "left_semi")
    return kept.join(ids, F.col("dst") == ids.node_id, "left_semi")


def weighted_graph(nodes: DataFrame, edges: DataFrame, seq: str = "edge_id") -> DataFrame:
    """The simple graph of the edges that count: both ends known, a positive length, no loops; of parallel edges the last by ``seq``."""
    return simple_graph(valid_edges(nodes, edges), seq)


def graph_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, bridges, lengths and degrees of a weighted graph in one row; a graph without nodes or edges is an error."""
    degree = degrees(nodes, edges).agg(F.count("*").alias("nodes"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 9).alias("avg_degree"))
    own = length_summary(edges).crossJoin(edges.agg(F.count_if(F.col("bridge")).alias("bridges")))
    fault = lambda c, what: F.when(F.col(c) > 0, F.col(c)).otherwise(F.raise_error(F.lit(f"the weighted graph has no {what}")).cast("long"))
    return degree.crossJoin(own).withColumns({"nodes": fault("nodes", "nodes"), "edges": fault("edges", "edges")})


def length_summary(edges: DataFrame, length: str = "length_m") -> DataFrame:
    x = F.col(length)
    return edges.agg(F.count("*").alias("edges"), F.round(F.sum(x), 6).alias("total_length_m"), F.round(F.min(x), 6).alias("min_length_m"), F.round(F.max(x), 6).alias("max_length_m"), F.round(F.avg(x), 6).alias("avg_length_m"))


def degree_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).groupBy(node_type(F.col("degree")).alias("node_type")).agg(F.count("*").alias("nodes"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 9).alias("avg_degree"))


def component_sizes(edges: DataFrame, most: int | None = 20) -> DataFrame:
    """Components of the nodes that have edges, largest first; a report of the first ``most``."""
    found = connected_components(edges, few=FEW).groupBy("component").agg(F.count("*").alias("size"))
    return found.orderBy(F.desc("size"), "component").limit(most) if most else found


def largest_component(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the largest component; of equal ones that with the smallest node."""
    found = connected_components(edges, few=FEW)
    top = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = found.join(F.broadcast(top), "component", "left_semi").select(F.col("vertex").alias("node_id"))
    kept = edges.join(inside, edges.src == inside.node_id, "left_semi")
    return nodes.join(inside, "node_id", "left_semi"), kept

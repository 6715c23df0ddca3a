"""From skeleton pixels to nodes and edges: clusters of node pixels, corridors between them, and their lines and lengths.

Pixels get a number each, so that scenes may have ids of any kind. Pairs of touching pixels are found once and written; degrees,
clusters, corridors and what they touch are all read from them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stradale.functions.affine import pixel_centre
from stradale.functions.geo import _inverse
from stradale.functions.scalars import node_type
from stradale.operators.components import FEW, connected_components
from stradale.operators.ordinal import numbered
from stradale.plans.staging import discard, materialize

#: Rows and columns of a scene at most, and one more: pixels are numbered row by row. Beyond it the query fails.
STRIDE = 1 << 20
_INNER, _NODE = 1, 2


@dataclass
class Parts:
    """Tables by pixel number ``id``: ``pixels(id, scene, r, c, kind, label)``, ``member(id, scene, node_id)`` and ``cross(scene,
    node_id, id, id2, label)``, the pairs of a node's pixel and a corridor's."""

    pixels: DataFrame
    member: DataFrame
    cross: DataFrame


def _merged(table: DataFrame) -> DataFrame:
    """A table of pixels, nodes or corridors, to be merged: by the size of its compressed file it might be broadcast."""
    return table.hint("merge")


def _parts(pixels: DataFrame) -> Parts:
    scenes = numbered(pixels.select("scene").distinct(), "scene", name="_s")
    inside = (F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < STRIDE - 1) & (F.col("c") < STRIDE - 1)
    number = F.when(inside, F.col("_s") * (STRIDE * STRIDE) + F.col("r") * STRIDE + F.col("c")).otherwise(F.raise_error(F.lit(f"rows and columns go from 0 to {STRIDE - 2}")))
    every = pixels.select("scene", F.col("r").cast("long"), F.col("c").cast("long")).distinct().join(scenes, "scene").select(number.cast("long").alias("id"), "scene", "r", "c")
    every = materialize(every, "pixels")
    around = F.array(*(F.lit(dr * STRIDE + dc).cast("long") for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc))
    near = every.select("id", F.explode(around).alias("step")).select("id", (F.col("id") + F.col("step")).alias("id2"))
    near = materialize(near.join(_merged(every.select(F.col("id").alias("id2"))), "id2").select("id", "id2"), "touching")
    degree = near.groupBy("id").agg(F.count("*").alias("degree"))
    kinds = every.join(_merged(degree), "id", "left").withColumn("kind", F.when(F.col("degree") == 2, _INNER).when(F.col("degree").isNotNull(), _NODE).otherwise(0)).drop("degree")
    # a pixel without neighbours is neither
    kinds = materialize(kinds.where("kind > 0"), "kinds")
    kind = kinds.select("id", "kind")
    alike = near.where("id < id2").join(_merged(kind), "id").join(_merged(kind.select(F.col("id").alias("id2"), F.col("kind").alias("kind2"))), "id2").where("kind = kind2")
    links = alike.select("id", "id2").unionAll(kind.select("id", F.col("id").alias("id2")))
    label = connected_components(links, "id", "id2", few=FEW).select(F.col("vertex").alias("id"), F.col("component").alias("label"))
    labelled = materialize(kinds.join(_merged(label), "id"), "labelled")
    discard(every), discard(kinds)
    clusters = labelled.where(F.col("kind") == _NODE)
    ids = clusters.select("scene", "label").distinct().withColumn("node_id", F.row_number().over(W.partitionBy("scene").orderBy("label")).cast("long"))
    member = materialize(clusters.join(_merged(ids), ["scene", "label"]).select("id", "scene", "node_id"), "member")
    inner = labelled.where(F.col("kind") == _INNER).select(F.col("id").alias("id2"), "label")
    cross = materialize(near.join(_merged(member), "id").join(_merged(inner), "id2").select("scene", "node_id", "id", "id2", "label"), "cross")
    discard(near)
    return Parts(labelled, member, cross)


def _nodes(parts: Parts) -> DataFrame:
    at = parts.member.join(_merged(parts.pixels.select("id", "r", "c")), "id")
    nodes = at.groupBy("scene", "node_id").agg(F.count("*").alias("pixels"), F.avg("r").alias("row"), F.avg("c").alias("col"))
    outside = parts.cross.groupBy("scene", "node_id").agg(F.count_distinct("id2").alias("degree"))
    nodes = nodes.join(_merged(outside), ["scene", "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    return nodes.withColumn("node_type", node_type(F.col("degree")))


def node_clusters(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(scene, node_id, pixels, row, col, degree, node_type)`` and the member pixels ``(scene, r, c, node_id)``.

    Node pixels are those with neither no, nor two neighbours; touching ones are one node. Its degree counts the distinct set
    pixels outside that touch it.
    """
    parts = _parts(pixels)
    return _nodes(parts), parts.member.join(_merged(parts.pixels.select("id", "r", "c")), "id").select("scene", "r", "c", "node_id")


def _corridors(parts: Parts) -> DataFrame:
    ends = parts.cross.groupBy("scene", "label").agg(F.min("node_id").alias("start_node"), F.max("node_id").alias("end_node"), F.min(F.struct("node_id", "id2"))["id2"].alias("first")).where("start_node <> end_node")
    size = parts.pixels.where(F.col("kind") == _INNER).groupBy("label").agg(F.count("*").alias("pixels"), F.collect_list("id").alias("ids"))
    return ends.join(_merged(size), "label")


def corridors(pixels: DataFrame) -> DataFrame:
    """``scene, start_node, end_node, pixels, first_pixel``: runs of pixels with two neighbours between two different nodes.

    A run is a connected component of such pixels; one that is a closed ring, or comes back to its own node, is none.
    """
    return _corridors(_parts(pixels)).select("scene", "start_node", "end_node", "pixels", (F.col("label") % (STRIDE * STRIDE)).alias("first_pixel"))


def _walk(ids, first: int) -> list[int]:
    """The pixels of a corridor in order, from ``first`` on: each next one touches the one before."""
    left, out = set(ids), [first]
    left.discard(first)
    steps = [dr * STRIDE + dc for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
    while (further := next((out[-1] + s for s in steps if out[-1] + s in left), None)) is not None:
        left.discard(further)
        out.append(further)
    return out


def graph_edges(pixels: DataFrame, transform: tuple[float, float, float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(scene, node_id, x, y, node_type, degree)`` and edges ``(scene, edge_id, start_node, end_node, pixel_count, length_m,
    coordinates)`` of a skeleton; scenes have ids of any kind.

    The line of an edge goes from the centre of its start node over the centres of its pixels, in order, to that of its end node,
    without points that repeat the one before; its length is the sum of the geodesics between them. Edges without length are left
    out. Edges are numbered by scene from 0.
    """
    ax, bx, cx, ay, by, cy = transform

    def line(ids: pd.Series, first: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.DataFrame:
        lines, lengths = [], []
        for k in range(len(ids)):
            at = np.array(_walk(ids.iloc[k].tolist(), int(first.iloc[k])), np.int64) % (STRIDE * STRIDE)
            r, c = at // STRIDE + 0.5, at % STRIDE + 0.5
            p = np.concatenate([[[x1.iloc[k], y1.iloc[k]]], np.stack([ax * c + bx * r + cx, ay * c + by * r + cy], axis=1), [[x2.iloc[k], y2.iloc[k]]]])
            p = p[np.concatenate([[True], (np.diff(p, axis=0) != 0).any(axis=1)])]
            lines.append(p.tolist())
            lengths.append(float(_inverse(p[:-1, 0], p[:-1, 1], p[1:, 0], p[1:, 1])[0].sum()))
        return pd.DataFrame({"coordinates": lines, "length_m": lengths})

    parts = _parts(pixels)
    x, y = pixel_centre(F.col("row"), F.col("col"), transform)
    nodes = _nodes(parts).select("scene", "node_id", x.alias("x"), y.alias("y"), "node_type", "degree")
    end = lambda k: nodes.select("scene", F.col("node_id").alias(("start_node", "end_node")[k - 1]), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    rows = _corridors(parts).join(_merged(end(1)), ["scene", "start_node"]).join(_merged(end(2)), ["scene", "end_node"])
    drawn = rows.withColumn("g", F.pandas_udf(line, "coordinates array<array<double>>, length_m double")("ids", "first", "x1", "y1", "x2", "y2"))
    drawn = materialize(drawn.select("scene", "start_node", "end_node", F.col("pixels").alias("pixel_count"), "g.length_m", "g.coordinates", "label"), "lines").where("length_m > 0")
    order = F.row_number().over(W.partitionBy("scene").orderBy("start_node", "end_node", "label")) - 1
    return nodes, drawn.withColumn("edge_id", order.cast("long")).select("scene", "edge_id", "start_node", "end_node", "pixel_count", "length_m", "coordinates")

"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stradale.plans.staging import discard, materialize


#: Edges that one task may hold.
FEW = 500_000


def _toward_smaller(edges: DataFrame) -> DataFrame:
    """Point every pair at the smallest vertex that one of its ends touches (both star steps of the alternating scheme)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    large = large.where("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    hung = large.join(low, "u")
    small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return small.distinct()


def _one_task(pairs: DataFrame) -> DataFrame:
    """Disjoint sets over edges that are known to be few."""

    def run(frames):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for frame in frames:
            for u, v in zip(frame.u.tolist(), frame.v.tolist()):
                p, q = find(u), find(v)
                parent[max(p, q)] = min(p, q)
        rows = [(x, find(x)) for x in list(parent)]
        yield pd.DataFrame(rows, columns=["vertex", "component"]).astype("int64")

    return pairs.repartition(1).mapInPandas(run, "vertex long, component long")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, few: int = 0) -> DataFrame:
    """``(vertex, component)`` for every vertex of ``edges``; the component is its smallest vertex.

    Alternates large-star and small-star steps until the edges form stars, in a number of rounds that grows with the
    logarithm of the longest path. At most ``few`` edges, which are counted first, are left to one task instead. Each step is an aggregation with map-side partial minima and a join that adaptive
    execution can split at a hot vertex; no neighbour list is gathered and nothing is collected. Each round is written to the
    shared folder. Self-loops name isolated vertices; null ends are ignored; no edges give no rows.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    if few and pairs.count() <= few:
        return _one_task(pairs)
    loops = pairs.where("u = v").select(F.col("u").alias("vertex")).distinct()
    now = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    mark = None
    for _ in range(max_rounds):
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign[0] == 0 or sign == mark:
            break
        mark = sign
        after = materialize(_toward_smaller(now), "edges")
        discard(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    found = found.unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
    alone = loops.join(found, "vertex", "left_anti").select("vertex", F.col("vertex").alias("component"))
    return found.unionByName(alone)

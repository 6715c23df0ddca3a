"""What-if analyses: removed nodes and edges, what stays reachable, and how far the detours are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stradale.functions.scalars import path_uses_edge, percent_change, ratio, travel_seconds
from stradale.operators import quantiles
from stradale.operators.paths import cut_edges, increases, reroute_sums, reroutes, survival, with_paths
from stradale.plans.staging import materialize

#: Edges that are tried at once for a detour.
TRIED = 10


def node_failures(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
    """One row per node of ``removed(node_id)``, a short list: pairs that survive, mean paths before and after over them, resilience, efficiency.

    The efficiency before is the mean over reachable pairs; after, over all pairs, unreachable ones counting 0. Lengths are summed
    by source in the tasks: a row per scenario and source leaves them, not a row per pair.
    """
    cuts = removed.select(F.col("node_id").alias("scenario"), F.col("node_id").alias("cut_node"))
    sums = materialize(survival(nodes, edges, cuts), "survival")
    linked = sums.where("scenario is not null and near > 0")
    both = sums.where("scenario is not null").groupBy("scenario").agg(F.sum("pairs").alias("reachable_pairs"), (F.sum("before") / F.sum("pairs")).alias("b"), (F.sum("after") / F.sum("pairs")).alias("a"), F.sum("inverse").alias("x"))
    comps = linked.groupBy("scenario").agg(F.count_distinct("low").alias("linked"), F.max("near").alias("most"), F.count("*").alias("sources"))
    whole = sums.where("scenario is null").agg(F.count("*").alias("n"), (F.sum("inverse") / F.sum("pairs")).alias("e"))
    rows = cuts.select("scenario").join(both, "scenario", "left").join(comps, "scenario", "left").crossJoin(F.broadcast(whole))
    possible = (F.col("n") - 1) * (F.col("n") - 2) / 2
    reach = F.coalesce("reachable_pairs", F.lit(0).cast("long"))
    eff = F.coalesce("x", F.lit(0.0)) / possible
    return rows.select(
        F.col("scenario").alias("node_id"), possible.cast("long").alias("possible_pairs"), reach.alias("reachable_pairs"), (possible.cast("long") - reach).alias("unreachable_pairs"),
        F.round(ratio(reach, possible), 9).alias("reachable_fraction"), F.round("b", 6).alias("mean_before_m"), F.round("a", 6).alias("mean_after_m"), F.round(F.when(F.col("a") > 0, F.col("b") / F.col("a")), 9).alias("resilience_index"),
        F.round(eff, 9).alias("efficiency_after"), F.round((eff - F.col("e")) / F.col("e") * 100, 6).alias("efficiency_change_pct"),
        (F.coalesce("linked", F.lit(0)) + F.col("n") - 1 - F.coalesce("sources", F.lit(0))).cast("long").alias("components"), (F.coalesce("most", F.lit(0)) + 1).cast("long").alias("largest_component"),
    )


def affected_by_node(paths: DataFrame, removed: DataFrame) -> DataFrame:
    """Of given paths ``s, t, dist, path``, those that go through a node of the short list ``removed(node_id)`` without ending there."""
    through = paths.where("s < t").select("s", "t", F.col("dist").alias("before"), F.explode(F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0)))).alias("scenario"))
    return through.join(removed.select(F.col("node_id").alias("scenario")), "scenario")


def affected_by_edge(paths: DataFrame, u: int, v: int) -> DataFrame:
    """Of given paths ``s, t, dist, path``, those that use the edge between ``u`` and ``v``."""
    return paths.where((F.col("s") < F.col("t")) & path_uses_edge(F.col("path"), F.lit(u), F.lit(v))).select("s", "t", F.col("dist").alias("before"))


def sample_routes(routes: DataFrame, most: int = 10) -> DataFrame:
    """The first ``most`` pairs of ``reroutes(..., paths=True)`` that have a way around, by scenario, source and target."""
    ok = routes.where("after IS NOT NULL").withColumn("increase_m", F.col("after") - F.col("before"))
    return ok.orderBy("scenario", "s", "t").limit(most)


def first_routes(nodes: DataFrame, edges: DataFrame, cuts: DataFrame, most: int = 10) -> DataFrame:
    """:func:`sample_routes` of the whole ``reroutes(..., paths=True)``: every task tells its own first pairs, and only those that are
    first of all get paths."""
    cuts = materialize(cuts, "cuts")
    first = materialize(sample_routes(reroutes(nodes, edges, cuts, first=most), most).drop("increase_m"), "first")
    return sample_routes(with_paths(first, edges, cuts), most)


def reroute_totals(nodes: DataFrame, edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """As :func:`reroute_summary` of all reroutes, from sums by source."""
    total = lambda c: F.sum(c) / F.sum("reroutable")
    out = reroute_sums(nodes, edges, cuts).groupBy("scenario").agg(F.sum("affected").alias("affected"), F.sum("reroutable").alias("reroutable"), total("before").alias("b"), total("after").alias("a"), F.round(total("more"), 6).alias("mean_increase_m"), F.round(F.max("most"), 6).alias("max_increase_m"), F.round(F.max("most_pct"), 6).alias("max_increase_pct"))
    return _told(out)


def reroute_summary(routes: DataFrame) -> DataFrame:
    """Per scenario: affected and reroutable pairs, mean lengths, and increases over the reroutable ones (nulls if there are none)."""
    ok = F.col("after").isNotNull()
    more = F.when(ok, F.col("after") - F.col("before"))
    out = routes.groupBy("scenario").agg(
        F.count("*").alias("affected"), F.count_if(ok).alias("reroutable"), F.avg(F.when(ok, F.col("before"))).alias("b"), F.avg("after").alias("a"),
        F.round(F.avg(more), 6).alias("mean_increase_m"), F.round(F.max(more), 6).alias("max_increase_m"), F.round(F.max(percent_change(F.col("before"), F.col("after"))), 6).alias("max_increase_pct"),
    )
    return _told(out)


def _told(out: DataFrame) -> DataFrame:
    return out.select("scenario", "affected", "reroutable", (F.col("affected") - F.col("reroutable")).alias("unreachable"), F.round(ratio(F.col("reroutable"), F.col("affected")), 9).alias("reroutable_fraction"), F.round("b", 6).alias("mean_before_m"), F.round("a", 6).alias("mean_after_m"), "mean_increase_m", F.round(percent_change(F.col("b"), F.col("a"), None), 6).alias("mean_increase_pct"), "max_increase_m", "max_increase_pct")


def number_edges(ranked: DataFrame) -> DataFrame:
    return ranked.select(F.col("rank").alias("scenario"), F.col("src").alias("cut_u"), F.col("dst").alias("cut_v"))


def first_reroutable_edge(nodes: DataFrame, edges: DataFrame, bc: DataFrame) -> DataFrame:
    """The edge with the largest betweenness that is no cut edge and has pairs to reroute, with the increases of their paths.

    Whether an edge has pairs is first asked of the ends of the edges tried, of other sources only where that leaves it open; the
    increases of the one edge are counted in the tasks.
    """
    open_edges = bc.join(cut_edges(nodes, edges), ["src", "dst"], "left_anti")
    order = F.desc(F.round("bc", 9)), F.desc("src"), F.desc("dst")
    open_edges = materialize(open_edges, "open")
    row = None
    for at in range(0, open_edges.count(), TRIED):
        some = open_edges.orderBy(*order).offset(at).limit(TRIED)
        cuts = some.withColumn("scenario", F.row_number().over(W.orderBy(*order)).cast("long")).select("scenario", F.col("src").alias("cut_u"), F.col("dst").alias("cut_v"), "bc")
        cuts = materialize(cuts, "cuts")
        first = lambda sources, tried: reroutes(sources, edges, tried.drop("bc"), first=1).where("after IS NOT NULL").agg(F.min("scenario")).first()[0]
        ends = cuts.select(F.explode(F.array("cut_u", "cut_v")).alias("node_id"))
        found = first(nodes.join(ends, "node_id", "left_semi"), cuts)
        before = cuts if found is None else cuts.where(F.col("scenario") < found)
        found = (first(nodes, before) if found != 1 else None) or found
        if found is not None:
            edge = cuts.where(F.col("scenario") == found)
            u, v, bc_of = edge.select("cut_u", "cut_v", "bc").first()
            high = lambda n: int(0.95 * (n - 1))
            more = increases(nodes, edges, edge.drop("bc"), lambda _, n: [*quantiles.middle(n), high(n)])["more"]
            row = (u, v, bc_of, more["n"], more["total"] / more["n"], quantiles.median(more), more["at"][high(more["n"])], more["most"])
            break
    one = edges.sparkSession.createDataFrame([row] if row else [], "src long, dst long, bc double, rerouted long, mean double, median double, p95 double, max double")
    told = {f"{k}_increase_m": F.round(k, 6) for k in ("mean", "median", "p95", "max")} | {"mean_increase_s": F.round(travel_seconds(F.col("mean")), 6)}
    return one.select("src", "dst", F.round("bc", 9).alias("bc"), "rerouted", *(v.alias(k) for k, v in told.items()))

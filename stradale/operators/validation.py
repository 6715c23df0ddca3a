"""Comparison with a second network: snapping, sampled pairs, errors of path lengths, tags."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stradale.functions.geo import _inverse, with_geodesic
from stradale.operators import quantiles
from stradale.operators.ordinal import numbered
from stradale.operators.paths import _dealt, _sent, by_source
from stradale.plans.staging import materialize


#: Nodes of a block and points of a group that meet in one task; nodes of a leaf; distances that are held at once.
BLOCK, GROUP, LEAF, AT_ONCE = 100_000, 20_000, 64, 1 << 20


def nearest(points: DataFrame, nodes: DataFrame, cell_x: float = 2e-3, cell_y: float = 1e-3) -> DataFrame:
    """``point_id, node_id, dist`` of the nearest node to each point, by distance then id; a row for every point.

    Points look in their own and the eight cells around, which settles all those with a node nearer than a cell; the rest are
    held against blocks of all nodes, however far. A point is null if it has no coordinates or there are no nodes.
    """
    cell = lambda c, size: F.floor(F.col(c) / size)
    known = lambda x, y: F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    sites = nodes.where(known("x", "y")).select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny"), cell("x", cell_x).alias("cx"), cell("y", cell_y).alias("cy"))
    points = points.select("point_id", F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"))
    none = lambda df: df.select("point_id", F.lit(None).cast(nodes.schema["node_id"].dataType).alias("node_id"), F.lit(None).cast("double").alias("dist"))
    if sites.isEmpty():
        return none(points)
    safe = min(cell_x * 60_000.0, cell_y * 110_000.0)  # metres of a cell at least, up to latitude 57
    near = points.where((F.abs("py") < 56.5) & (F.abs("px") < 179.5)).select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dx"))
    near = near.select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dy"))
    near = near.withColumns({"cx": F.floor(F.col("px") / cell_x) + F.col("dx"), "cy": F.floor(F.col("py") / cell_y) + F.col("dy")})
    found = materialize(_best(with_geodesic(near.join(sites, ["cx", "cy"]), "px", "py", "nx", "ny")).where(F.col("dist") <= safe), "near")
    left = materialize(points.join(found, "point_id", "left_anti"), "left")
    far = left.where(known("px", "py"))
    return found.unionAll(_best(_in_blocks(far, sites))).unionAll(none(left.where(~known("px", "py"))))


def _best(seen: DataFrame) -> DataFrame:
    return seen.groupBy("point_id").agg(F.min(F.struct("dist", "node_id")).alias("b")).select("point_id", "b.node_id", "b.dist")


def _in_blocks(points: DataFrame, sites: DataFrame) -> DataFrame:
    """``point_id, node_id, dist`` of the nearest node of each block of nodes to each point."""
    n_blocks, n_groups = (max(1, -(-df.count() // size)) for df, size in ((sites, BLOCK), (points, GROUP)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    dealt = points.select("point_id", "px", "py", place("point_id", n_groups).alias("g"), each(n_blocks).alias("b")).groupBy("g", "b")
    blocks = sites.select("node_id", "nx", "ny", place("node_id", n_blocks).alias("b"), each(n_groups).alias("g")).groupBy("g", "b")
    shape = f"point_id {points.schema['point_id'].dataType.simpleString()}, node_id {sites.schema['node_id'].dataType.simpleString()}, dist double"
    return dealt.cogroup(blocks).applyInPandas(_closest, shape)


def _straight(lon, lat) -> np.ndarray:
    """Places in space, metres, on the ellipsoid: the straight line between two is never longer than the geodesic."""
    a, f = 6378137.0, 1 / 298.257223563
    x, y = np.radians(np.asarray(lon, float)), np.radians(np.asarray(lat, float))
    n = a / np.sqrt(1 - f * (2 - f) * np.sin(y) ** 2)
    return np.stack([n * np.cos(y) * np.cos(x), n * np.cos(y) * np.sin(x), n * (1 - f) ** 2 * np.sin(y)], axis=1)


def _halves(at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    axis = int(np.ptp(at[ids], axis=0).argmax())
    order = ids[np.argpartition(at[ids, axis], len(ids) // 2)]
    return order[: len(order) // 2], order[len(order) // 2 :]


def _closest(points: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """The nearest node to each point: boxes of nodes that are too far for a box of points are passed over, the rest compared.

    All nodes no further in a straight line than the geodesic to one of them are compared by geodesics, so none is missed.
    """
    if points.empty or nodes.empty:
        return pd.DataFrame({"point_id": points["point_id"].iloc[:0], "node_id": nodes["node_id"].iloc[:0], "dist": np.zeros(0)})
    p, q = _straight(points["px"], points["py"]), _straight(nodes["nx"], nodes["ny"])
    px, py, nx, ny = (df[c].to_numpy(float) for df, c in ((points, "px"), (points, "py"), (nodes, "nx"), (nodes, "ny")))
    leaves, todo, out = [], [np.arange(len(q))], []
    while todo:
        ids = todo.pop()
        if len(ids) > LEAF:
            todo += _halves(q, ids)
        else:
            leaves.append(ids)
    low, high = (np.array([f(q[ids], axis=0) for ids in leaves]) for f in (np.min, np.max))
    sizes = np.array([len(ids) for ids in leaves])
    todo = [np.arange(len(p))]
    while todo:
        ids = todo.pop()
        a, b = p[ids].min(axis=0), p[ids].max(axis=0)
        least = np.sqrt((np.maximum(0, np.maximum(low - b, a - high)) ** 2).sum(axis=1))
        most = np.sqrt((np.maximum(high - a, b - low) ** 2).sum(axis=1)).min()
        near = np.flatnonzero(least <= most + 1e-3)
        if len(ids) > 1 and len(ids) * sizes[near].sum() > AT_ONCE:
            todo += _halves(p, ids)
            continue
        straight = lambda who: np.sqrt(((p[ids][:, None, :] - q[who][None, :, :]) ** 2).sum(axis=2))
        who = np.concatenate([leaves[k] for k in near])
        first = who[straight(who).argmin(axis=1)]
        bound = np.nan_to_num(_inverse(px[ids], py[ids], nx[first], ny[first])[0], nan=np.inf) + 1e-3
        if len(ids) > 1 and len(ids) * sizes[least <= bound.max()].sum() > 4 * AT_ONCE:
            todo += _halves(p, ids)
            continue
        who = np.concatenate([leaves[k] for k in np.flatnonzero(least <= bound.max())])
        i, j = np.nonzero(straight(who) <= bound[:, None])
        i, j = ids[i], who[j]
        seen = pd.DataFrame({"i": i, "node_id": nodes["node_id"].to_numpy()[j], "dist": _inverse(px[i], py[i], nx[j], ny[j])[0]})
        out.append(seen.sort_values(["i", "dist", "node_id"]).drop_duplicates("i"))
    best = pd.concat(out)
    return pd.DataFrame({"point_id": points["point_id"].to_numpy()[best["i"]], "node_id": best["node_id"].to_numpy(), "dist": best["dist"].to_numpy()})


#: Primes, of which one at least divides no number of pairs below their product.
STRIDES = (1_000_003, 1_000_033, 1_000_037, 1_000_039)


def path_errors(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """``s, t, length_m, reference_m, abs_error_m, error_pct`` of pairs with both paths; empty references are left out."""
    both = ours.hint("merge").where("s < t").select("s", "t", F.col("dist").alias("length_m")).join(theirs.select("s", "t", F.col("dist").alias("reference_m")), ["s", "t"]).where("reference_m > 0")
    error = F.abs(F.col("length_m") - F.col("reference_m"))
    return both.withColumns({"abs_error_m": error, "error_pct": error / F.col("reference_m") * 100})


def error_summary(errors: DataFrame) -> DataFrame:
    r = lambda f, c, name: F.round(f(c), 6).alias(name)
    return errors.agg(F.count("*").alias("pairs"), r(F.avg, "abs_error_m", "mean_abs_m"), r(F.median, "abs_error_m", "median_abs_m"), r(F.avg, "error_pct", "mean_pct"), r(F.median, "error_pct", "median_pct"), r(F.max, "error_pct", "max_pct"), r(F.avg, "length_m", "mean_length_m"), r(F.avg, "reference_m", "mean_reference_m"))


def _both_ways(nodes: DataFrame, edges: DataFrame, other: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over an iterator of ``s, t, length_m, reference_m``: a source, and arrays of the targets ``> s`` that both networks reach
    by paths with a length in the second. Both networks are sent; a task searches some sources in both, so no pairs are joined."""
    ours, theirs = _sent(edges), _sent(other)

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        a, b = ours.value, theirs.value
        ids, at, there = np.intersect1d(a.nodes, b.nodes, return_indices=True)
        for some in a.sources(frames, 3)[0]:
            some = some[np.isin(some, ids)]
            if len(some):
                for s, x, y in zip(some.tolist(), by_source(a.table(some)), by_source(b.table(some))):
                    k = int(np.searchsorted(ids, s, "right"))
                    x, y = x[at[k:]], y[there[k:]]
                    good = np.isfinite(x) & np.isfinite(y) & (y > 0)
                    yield s, ids[k:][good], x[good], y[good]

    return _dealt(nodes.select(F.col("node_id").alias("s")), ours).mapInPandas(lambda frames: run(pairs(frames)), schema)


def network_errors(nodes: DataFrame, edges: DataFrame, other: DataFrame) -> DataFrame:
    """As :func:`path_errors` of the distances between all nodes of two networks; a row per pair leaves the task that searched its source."""

    def run(pairs: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        for s, t, x, y in pairs:
            if len(t):
                yield pd.DataFrame({"s": s, "t": t, "length_m": x, "reference_m": y, "abs_error_m": np.abs(x - y), "error_pct": np.abs(x - y) / y * 100})

    return _both_ways(nodes, edges, other, run, "s long, t long, length_m double, reference_m double, abs_error_m double, error_pct double")


def network_error_summary(nodes: DataFrame, edges: DataFrame, other: DataFrame) -> DataFrame:
    """As :func:`error_summary` of :func:`network_errors`: sums, maxima and counts leave the tasks, and the medians are exact."""
    spark, plain = nodes.sparkSession, ("length_m", "reference_m")

    def count(wanted: dict | None) -> DataFrame:
        def run(pairs: Iterator[tuple]) -> Iterator[pd.DataFrame]:
            counted, n, sums = quantiles.Counted(wanted), 0, np.zeros(2)
            for _, _, x, y in pairs:
                error = np.abs(x - y)
                counted.add("abs_error_m", error)
                counted.add("error_pct", error / y * 100)
                n, sums = n + len(x), sums + (x.sum(), y.sum())
                if counted.full:
                    yield counted.take()
            yield counted.take()
            if wanted is None and n:
                yield pd.DataFrame({"name": plain, "key": 0, "n": n, "total": sums, "most": 0.0})

        return _both_ways(nodes, edges, other, run, quantiles.SCHEMA)

    found = quantiles.order_statistics(count, lambda name, n: [] if name in plain else quantiles.middle(n))
    mean = lambda name: found[name]["total"] / found[name]["n"]
    schema = "pairs long, " + ", ".join(f"{c} double" for c in ("mean_abs_m", "median_abs_m", "mean_pct", "median_pct", "max_pct", "mean_length_m", "mean_reference_m"))
    row = (0, *[None] * 7)
    if found:
        row = (found["length_m"]["n"], mean("abs_error_m"), quantiles.median(found["abs_error_m"]), mean("error_pct"), quantiles.median(found["error_pct"]), found["error_pct"]["most"], mean("length_m"), mean("reference_m"))
    one = spark.createDataFrame([row], schema)
    return one.select("pairs", *(F.round(c, 6).alias(c) for c in one.columns[1:]))


def tag_histogram(rows: DataFrame, column: str) -> DataFrame:
    """Counts of the values of a multi-valued attribute, nulls left out."""
    return rows.select(F.explode(column).alias("tag")).where("tag IS NOT NULL").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def sample_pairs(nodes: DataFrame, most: int = 500, seed: int = 42) -> DataFrame:
    """``s, t``: ``most`` different ordered pairs of different nodes, or all there are.

    The pairs are counted through in a fixed stride that shares no factor with their number, so none comes twice before all have
    come. Only the drawn places are joined with the nodes.
    """
    placed = materialize(numbered(nodes.select("node_id").distinct(), "node_id", name="k"), "placed")
    n = placed.count()
    pairs = n * (n - 1)
    stride = next(p for p in STRIDES if pairs % p) if pairs else 1
    drawn = nodes.sparkSession.range(min(most, pairs)).select(((F.col("id") * stride + seed * 7919) % max(1, pairs)).alias("p"))
    first, other = F.floor(F.col("p") / max(1, n - 1)), F.col("p") % max(1, n - 1)
    drawn = drawn.select((first + 1).alias("i"), (other + 1 + F.when(other >= first, 1).otherwise(0)).alias("j"))
    one, two = placed.select(F.col("k").alias("i"), F.col("node_id").alias("s")), placed.select(F.col("k").alias("j"), F.col("node_id").alias("t"))
    return drawn.join(one, "i").join(two, "j").select("s", "t")

"""Shortest paths and betweenness. The graph is sent to the tasks, which each work on some sources of some scenarios."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stradale.operators import quantiles
from stradale.operators.components import FEW, connected_components
from stradale.operators.ordinal import numbered
from stradale.plans.staging import materialize

#: Edges that are broadcast at most.
MAX_EDGES = 5_000_000
#: Nodes whose neighbours a worker keeps as lists.
KNOWN = 200_000
#: Scenarios (four numbers each) that go to every task at most.
MAX_CUTS = 10_000
#: Distances (8 bytes each) that a task holds at once, and sources that are searched together at most.
HELD, WIDE = 1 << 24, 256


class Graph:
    """Neighbours by node, in the order of their ids, so that ties are broken alike everywhere: arrays of 32 bytes an edge and 16 a node."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, length: np.ndarray):
        u, v, w = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([length, length])
        order = np.lexsort((w, v, u))
        self.to, self.length = v[order], w[order]
        self.nodes, start = np.unique(u[order], return_index=True)
        self.start = np.append(start, len(u))
        self.known: dict[int, list[tuple[int, float]]] = {}
        self.steps: dict[int, list[tuple[int, float]]] = {}
        self.sided: dict[tuple[int, int], tuple | None] = {}
        self.rank: list[int] | None = None
        self.positive = bool((np.isfinite(self.length) & (self.length > 0)).all())
        self.place = self._places()

    def _places(self) -> np.ndarray:
        """Places of the nodes in breadth-first order, so that sources with places next to each other are near."""
        head = np.searchsorted(self.nodes, self.to)
        place, at = np.full(len(self.nodes), -1), 0
        for root in range(len(self.nodes)):
            queue = [root] if place[root] < 0 else []
            for u in queue:
                if place[u] < 0:
                    place[u], at = at, at + 1
                    queue += [v for v in head[self.start[u] : self.start[u + 1]].tolist() if place[v] < 0]
        return place

    #: Arcs by the index of the node they leave and the one they reach; made in the tasks, not sent.
    @cached_property
    def tail(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.nodes)), np.diff(self.start))

    @cached_property
    def head(self) -> np.ndarray:
        return np.searchsorted(self.nodes, self.to)

    def index(self, ids: np.ndarray) -> np.ndarray:
        """Indices of nodes; -1 for those without edges."""
        if not len(self.nodes):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.nodes, ids), len(self.nodes) - 1)
        return np.where(self.nodes[at] == ids, at, -1)

    def sources(self, frames: Iterator[pd.DataFrame], tables: int = 1) -> tuple[list[np.ndarray], list[int]]:
        """Of the column ``s`` those with edges, near ones together, as few as :meth:`table` may hold ``tables`` times, and those without."""
        ids = np.concatenate([np.zeros(0, np.int64), *(f["s"].to_numpy(np.int64) for f in frames)])
        at = self.index(ids)
        known = ids[at >= 0][np.argsort(self.place[at[at >= 0]], kind="stable")]
        wide = max(1, min(WIDE, 1 + int((2 * len(self.nodes)) ** 0.5), HELD // (tables * max(1, len(self.nodes)))))
        return [known[k : k + wide] for k in range(0, len(known), wide)], ids[at < 0].tolist()

    def table(self, sources: np.ndarray, node: int | None = None, edge: tuple[int, int] | None = None) -> np.ndarray:
        """Distances to every node (rows) from every one of ``sources`` (columns, nodes with edges), infinite where there is no way.

        Each source is searched alone until it has met the others, then all together: of the nodes whose row has changed the one
        nearest to the sources goes on to its neighbours, until no row changes, so the distances are those of single searches.
        Where the sources are near each other, few nodes come twice. How near is told by a search from the middle one, which is
        kept while it lies in the middle (an order from elsewhere would be right, but slow).
        """
        out = np.full((len(self.nodes), len(sources)), np.inf)
        if not len(sources):
            return out
        if not self.positive:
            for k, s in enumerate(sources.tolist()):
                dist = self.dijkstra(s, node, edge)[0]
                out[np.searchsorted(self.nodes, list(dist)), k] = list(dist.values())
            return out
        at = np.searchsorted(self.nodes, sources)
        middle = len(sources) // 2
        if self.rank is None or self.ordered != (node, edge) or self.rank[at[middle]] > len(sources) // 2:
            self._order_from(int(sources[middle]), node, edge)
        gone = -1 if node is None else int(self.index(np.array([node]))[0])
        cut = set() if edge is None else {tuple(self.index(np.array(x)).tolist()) for x in (edge, edge[::-1])}
        rank, ranked, met = self.rank, self.ranked, set()
        for k, s in enumerate(at.tolist()):
            dist = self._until(s, set(at.tolist()), gone, cut)
            out[list(dist), k] = list(dist.values())
            met.update(dist)
        waiting, waits = sorted(rank[k] for k in met), bytearray(len(self.nodes))
        for k in waiting:
            waits[k] = 1
        x, less = np.empty(len(sources)), np.empty(len(sources), bool)
        while waiting:
            k = heapq.heappop(waiting)
            waits[k] = 0
            u = ranked[k]
            row = out[u]
            for v, w in self._steps(u):
                if v == gone or (u, v) in cut:
                    continue
                old = out[v]
                np.add(row, w, out=x)
                np.less(x, old, out=less)
                if less.any():
                    np.minimum(x, old, out=old)
                    k = rank[v]
                    if not waits[k]:
                        waits[k] = 1
                        heapq.heappush(waiting, k)
        return out

    def _steps(self, u: int) -> list[tuple[int, float]]:
        if u not in self.steps:
            if len(self.steps) >= KNOWN:
                self.steps.clear()
            a, b = self.start[u : u + 2]
            self.steps[u] = list(zip(self.head[a:b].tolist(), self.length[a:b].tolist()))
        return self.steps[u]

    def _until(self, source: int, others: set[int], gone: int, cut: set) -> dict[int, float]:
        """Distances by index, in a search that ends with the last of ``others``."""
        dist, heap, done = {source: 0.0}, [(0.0, source)], set()
        while heap and others:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            others.discard(u)
            for v, w in self._steps(u):
                if v != gone and (u, v) not in cut and d + w < dist.get(v, np.inf):
                    dist[v] = d + w
                    heapq.heappush(heap, (d + w, v))
        return dist

    def _order_from(self, source: int, node: int | None, edge: tuple[int, int] | None) -> None:
        """Ranks of the nodes by their distance from a source; those it does not reach come last."""
        self.ordered = node, edge
        dist, far = self.dijkstra(source, node, edge)[0], np.full(len(self.nodes), np.inf)
        far[np.searchsorted(self.nodes, list(dist))] = list(dist.values())
        ranked = np.argsort(far, kind="stable")
        rank = np.empty(len(ranked), np.int64)
        rank[ranked] = np.arange(len(ranked))
        self.ranked, self.rank = ranked.tolist(), rank.tolist()

    def tight(self, d: np.ndarray) -> np.ndarray:
        """Arcs of the shortest paths that ``d``, the distances from one source, stand for."""
        x = d[self.tail] + self.length
        return np.flatnonzero((x <= d[self.head] + 1e-12) & np.isfinite(x))

    def sides(self, u: int, v: int) -> tuple | None:
        """``sides, w, slack`` of the edge between two nodes: the indices, in order, of the nodes whose shortest paths may enter it at ``u``
        and at ``v``, each with their distances to that end; its length; and by how much, at most, two ways of one length differ by rounding.
        None where there is no such edge, or it is so short that rounding hides it."""
        if (u, v) not in self.sided:
            if len(self.sided) * len(self.nodes) >= HELD // 4:
                self.sided.clear()
            a, b = self.index(np.array([u, v])).tolist()
            arcs = np.flatnonzero((self.tail == a) & (self.head == b)) if self.positive and min(a, b) >= 0 else []
            self.sided[u, v] = None
            if len(arcs):
                d, w = self.table(np.array([u, v])).T, float(self.length[arcs].min())
                there = np.isfinite(d).all(axis=0)
                slack = 4 * len(self.nodes) * np.finfo(float).eps * (float(d[:, there].max()) + w)
                entered = [np.flatnonzero(there & (x + w <= y + slack)) for x, y in (d, d[::-1])]
                if w > 2 * slack:
                    self.sided[u, v] = [(k, x[k]) for k, x in zip(entered, d)], w, slack
        return self.sided[u, v]

    def parents(self, d: np.ndarray, root: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes before each one, the smallest of several (where there is none: the number of nodes, which follows itself), and the tight arcs."""
        arcs, out = self.tight(d), np.full(len(d) + 1, len(d))
        out[self.head[arcs[::-1]]] = self.tail[arcs[::-1]]
        out[root] = len(d)
        return out, arcs

    def near(self, u: int) -> list[tuple[int, float]]:
        if u not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            k = int(np.searchsorted(self.nodes, u))
            a, b = self.start[k : k + 2] if k < len(self.nodes) and self.nodes[k] == u else (0, 0)
            self.known[u] = list(zip(self.to[a:b].tolist(), self.length[a:b].tolist()))
        return self.known[u]

    def dijkstra(self, source: int, node: int | None = None, edge: tuple[int, int] | None = None):
        """Distances, predecessors, settled order and numbers of shortest paths, without a node or an edge."""
        dist, prev, order, ways = {source: 0.0}, {source: []}, [], {source: 1.0}
        heap, done = [(0.0, source)], set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            order.append(u)
            for v, w in self.near(u):
                if v == node or edge and {u, v} == set(edge):
                    continue
                x = d + w
                if v not in dist or x < dist[v] - 1e-12:
                    dist[v], prev[v], ways[v] = x, [u], ways[u]
                    heapq.heappush(heap, (x, v))
                elif v not in done and abs(x - dist[v]) <= 1e-12:
                    prev[v].append(u)
                    ways[v] += ways[u]
        return dist, prev, order, ways


def _sent(edges: DataFrame):
    """The graph, sent to every task, once for each table that is written: at most 32 bytes for each of ``MAX_EDGES`` edges. Edges without
    an end or a length are left out."""
    if "sent" in vars(edges):
        return edges.sent
    if edges.count() > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges; use relaxed_distances")
    rows = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("length_m").cast("double")).dropna().toArrow()
    graph = edges.sparkSession.sparkContext.broadcast(Graph(*(c.to_numpy() for c in rows.columns)))
    if "staged_path" in vars(edges):  # its rows stay as they are
        edges.sent = graph
    return graph


def _spread(sources: DataFrame) -> DataFrame:
    n = max(1, sources.sparkSession.sparkContext.defaultParallelism)
    return sources.repartition(n)


def _dealt(sources: DataFrame, graph) -> DataFrame:
    """Sources ``s`` in four tasks a core, those that are near in the graph together."""

    def place(s: pd.Series) -> pd.Series:
        ids = s.to_numpy(np.int64)
        at = graph.value.index(ids)
        return pd.Series(np.where(at >= 0, graph.value.place[at] if len(graph.value.place) else 0, len(graph.value.place) + ids % 4096))

    n = 4 * max(1, sources.sparkSession.sparkContext.defaultParallelism)
    return sources.withColumn("_at", F.pandas_udf(place, "long")("s")).repartitionByRange(n, "_at").drop("_at")


def by_source(table: np.ndarray) -> Iterator[np.ndarray]:
    """The columns of a table of distances, as arrays."""
    for k in range(0, table.shape[1], 16):
        yield from np.ascontiguousarray(table[:, k : k + 16].T)


def _below(parent: np.ndarray, load: np.ndarray) -> np.ndarray:
    """``load`` of every node summed with those of all nodes after it in the tree, by steps of doubled length."""
    n = len(parent) - 1
    load = np.append(load, 0.0)
    while (parent < n).any():
        load = load + np.bincount(parent, load, n + 1)
        load[n] = 0.0
        parent = parent[parent]
    return load[:n]


def _tree_loads(g: Graph, ids: np.ndarray, by_node: np.ndarray, by_arc: np.ndarray) -> list[int]:
    """Adds the loads of nodes and arcs in the trees of shortest paths from near sources; gives back those that have ties, and so no tree.

    The load of an arc is the number of nodes behind it. Far from the sources their trees agree: those parts are summed once, and
    only what is left of each tree by itself.
    """
    n, left, arcs = len(g.nodes), [], []
    for s, d in zip(ids.tolist(), by_source(g.table(ids))):
        tight = g.tight(d)
        if not g.positive or len(tight) != np.isfinite(d).sum() - 1:
            left.append(s)
            continue
        arcs.append(np.full(n, -1, np.int32))
        arcs[-1][g.head[tight]] = tight
    if not arcs:
        return left
    roots = g.index(ids[~np.isin(ids, left)])
    by = np.stack(arcs)
    own = (by != by[0]).any(axis=0)
    own[roots] = True
    edge = np.flatnonzero(own)
    while len(edge):  # all nodes before one that differs
        used = np.unique(by[:, edge])
        edge = np.unique(g.tail[used[used >= 0]])
        edge = edge[~own[edge]]
        own[edge] = True
    parent = np.append(np.where(by[0] >= 0, g.tail[by[0]], n), n)
    parent[:n][own] = n
    alike = np.flatnonzero(~own & (by[0] >= 0))
    load = np.zeros(n)
    load[alike] = 1.0
    load = _below(parent, load)
    load[own] = 0.0
    top = alike[own[g.tail[by[0][alike]]]]
    hung = np.bincount(g.tail[by[0][top]], load[top], n)
    by_node[alike] += len(by) * (load[alike] - 1)
    by_arc[by[0][alike]] += len(by) * load[alike]
    some = np.flatnonzero(own)
    place = np.full(n, len(some))
    place[some] = np.arange(len(some))
    for row, root in zip(by[:, some], roots):
        there = row >= 0
        load = hung[some] + there
        load[place[root]] = hung[root] + 1.0
        load = _below(np.append(np.where(there, place[g.tail[row]], len(some)), len(some)), load)
        by_arc[row[there]] += load[there]
        by_node[some[there]] += load[there] - 1
    return left


def _down(parent: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Bits of every node and of all nodes before it in the tree."""
    n = len(parent) - 1
    flags = np.append(flags, 0)
    while (parent < n).any():
        flags = flags | flags[parent]
        parent = parent[parent]
    return flags[:n]


def _path(prev: dict, target: int) -> list[int]:
    out = [target]
    while prev[out[-1]]:
        out.append(min(prev[out[-1]]))
    return out[::-1]


def distances(edges: DataFrame, sources: DataFrame, paths: bool = False) -> DataFrame:
    """``scenario, s, t, dist[, path]`` to all reachable nodes, the source included.

    ``sources`` has ``scenario, s`` and ``cut_node, cut_u, cut_v``: what the scenario removes (nulls: nothing).
    """
    graph = _sent(edges)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                edge = None if pd.isna(r.cut_u) else (int(r.cut_u), int(r.cut_v))
                if not pd.isna(r.cut_node) and int(r.cut_node) == r.s:
                    continue
                dist, prev, _, _ = graph.value.dijkstra(int(r.s), None if pd.isna(r.cut_node) else int(r.cut_node), edge)
                out = pd.DataFrame({"scenario": r.scenario, "s": r.s, "t": list(dist), "dist": list(dist.values())})
                if paths:
                    out["path"] = [_path(prev, t) for t in dist]
                yield out

    schema = "scenario long, s long, t long, dist double" + (", path array<long>" if paths else "")
    return _spread(sources.select("scenario", "s", "cut_node", "cut_u", "cut_v")).mapInPandas(run, schema)


def cut_list(cuts: DataFrame) -> list[tuple]:
    """``(scenario, cut_node, cut_u, cut_v)`` of a table of scenarios, which has to be short: it goes to every task."""
    rows = cuts.select("scenario", *(F.col(c) if c in cuts.columns else F.lit(None).cast("long").alias(c) for c in ("cut_node", "cut_u", "cut_v"))).limit(MAX_CUTS + 1).collect()
    if len(rows) > MAX_CUTS:
        raise ValueError(f"more than {MAX_CUTS} scenarios; run them in parts")
    return sorted((tuple(r) for r in rows), key=lambda r: r[0])


def _detours(g: Graph, ids: np.ndarray, listed: list[tuple]) -> Iterator[tuple]:
    """``(scenario, node, edge), [(s, targets, before, after), ...]`` of the sources of a batch that a scenario affects, scenario by
    scenario: the targets ``> s``, as indices, whose path by smallest predecessors uses what is removed."""
    base, found = g.table(ids), {}
    for s, d in zip(ids.tolist(), by_source(base)):
        root = int(np.searchsorted(g.nodes, s))
        if g.positive:
            parent = g.parents(d, root)[0]
        else:
            parent = np.full(len(d) + 1, len(d))
            for t, by in g.dijkstra(s)[1].items():
                parent[np.searchsorted(g.nodes, t)] = np.searchsorted(g.nodes, min(by)) if by else len(d)
        for start in range(0, len(listed), 60):
            some, flags = listed[start : start + 60], np.zeros(len(d), np.int64)
            for k, (_, node, u, v) in enumerate(some):
                if node is not None:
                    x = int(g.index(np.array([node]))[0])
                    if x >= 0 and x != root:
                        flags[parent[:-1] == x] |= 1 << k
                else:
                    a, b = g.index(np.array([u, v])).tolist()
                    for p, t in ((a, b), (b, a)):
                        if min(a, b) >= 0 and parent[t] == p:
                            flags[t] |= 1 << k
            if flags.any():
                flags = _down(parent, flags)
                for k in range(len(some)):
                    touched = np.flatnonzero(flags >> k & 1)
                    touched = touched[g.nodes[touched] > s]
                    if len(touched):
                        found.setdefault(start + k, []).append((s, touched, d[touched]))
    for k in sorted(found):
        scenario, node, u, v = listed[k]
        edge = None if node is not None else (u, v)
        after = by_source(g.table(np.array([s for s, _, _ in found[k]]), node, edge))
        yield (scenario, node, edge), [(s, t, was, now[t]) for (s, t, was), now in zip(found[k], after)]


def reroutes(nodes: DataFrame, edges: DataFrame, cuts: DataFrame, paths: bool = False, first: int | None = None) -> DataFrame:
    """``scenario, s, t, before, after[, path_before, path_after]`` of the pairs ``s < t`` whose path uses what a scenario removes
    (a node inside it, or an edge); ``after`` is null where there is no way around.

    Each source is searched once as it is and once for each scenario that meets its tree of paths; pairs that are not affected
    never leave the task. ``first``: of the pairs with a way around, at least the ``first`` ones by scenario, source and target.
    """
    graph, listed = _sent(edges), cut_list(cuts)
    names = ["scenario", "s", "t", "before", "after", *(["path_before", "path_after"] if paths else [])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = graph.value
        for ids in g.sources(frames, 2)[0]:
            left = first
            for (scenario, node, edge), rows in _detours(g, ids, listed):
                for s, t, before, after in sorted(rows, key=lambda r: r[0]):
                    if first is not None:
                        way = np.flatnonzero(np.isfinite(after))[:left]
                        t, before, after, left = t[way], before[way], after[way], left - len(way)
                    out = pd.DataFrame({"scenario": scenario, "s": s, "t": g.nodes[t], "before": before, "after": np.where(np.isfinite(after), after, np.nan)})
                    if paths and len(t):
                        prev, back = g.dijkstra(s)[1], g.dijkstra(s, node, edge)[1]
                        out["path_before"] = [_path(prev, x) for x in out["t"]]
                        out["path_after"] = [_path(back, x) if x in back else None for x in out["t"]]
                    if len(t):
                        yield out[names]
                    if left == 0:
                        break
                if left == 0:
                    break

    schema = "scenario long, s long, t long, before double, after double" + (", path_before array<long>, path_after array<long>" if paths else "")
    out = _dealt(nodes.select(F.col("node_id").alias("s")), graph).mapInPandas(run, schema)
    return out.withColumn("after", F.when(~F.isnan("after"), F.col("after")))


def with_paths(rows: DataFrame, edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """A few rows of :func:`reroutes` with ``path_before, path_after``."""
    graph, listed = _sent(edges), {r[0]: r[1:] for r in cut_list(cuts)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for scenario, s, t in zip(frame["scenario"].tolist(), frame["s"].tolist(), frame["t"].tolist()):
                node, u, v = listed[scenario]
                back = graph.value.dijkstra(s, node, None if node is not None else (u, v))[1]
                out.append((_path(graph.value.dijkstra(s)[1], t), _path(back, t) if t in back else None))
            yield frame.assign(path_before=[x for x, _ in out], path_after=[x for _, x in out])

    return rows.mapInPandas(run, "scenario long, s long, t long, before double, after double, path_before array<long>, path_after array<long>")


def reroute_sums(nodes: DataFrame, edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """:func:`reroutes` summed by scenario and source: ``scenario, affected, reroutable, before, after, more, most, most_pct``; lengths are
    of the pairs with a way around, ``more`` the increases."""
    graph, listed = _sent(edges), cut_list(cuts)
    names = ["scenario", "affected", "reroutable", "before", "after", "more", "most", "most_pct"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = graph.value
        for ids in g.sources(frames, 2)[0]:
            out = []
            for (scenario, _, _), rows in _detours(g, ids, listed):
                for _, t, before, after in rows:
                    way = np.isfinite(after)
                    x, y = before[way], after[way]
                    most = ((y - x).max(), np.where(x > 0, (y - x) / np.where(x > 0, x, 1) * 100, 0.0).max()) if len(x) else (np.nan, np.nan)
                    out.append((scenario, len(t), len(x), x.sum(), y.sum(), (y - x).sum(), *most))
            yield pd.DataFrame(out, columns=names).astype({k: "int64" if k in names[:3] else "float64" for k in names})

    out = _dealt(nodes.select(F.col("node_id").alias("s")), graph).mapInPandas(run, "scenario long, affected long, reroutable long, before double, after double, more double, most double, most_pct double")
    return out.withColumns({c: F.when(F.col("reroutable") > 0, F.col(c)) for c in names[3:]})


def _crossing(g: Graph, ids: np.ndarray, sides: list) -> Iterator[tuple]:
    """Of each side of an edge (:meth:`Graph.sides`) the sources, as indices, with targets ``> s`` on the other side; and both sides."""
    at = g.index(ids)
    for (own, near), (other, far) in (sides, sides[::-1]):
        some = own[: np.searchsorted(own, other[-1])] if len(other) else own[:0]
        yield at[np.isin(at, some)], (own, near), (other, far)


def _increases(g: Graph, ids: np.ndarray, listed: list[tuple]) -> Iterator[np.ndarray]:
    """``after - before`` of the pairs with a way around that :func:`_detours` tells of a batch.

    A path over an edge is as long as the distances of its ends tell, so one search without the edge tells whether a pair needs it, and
    only sources on one side of it are searched. Sources of which some pair has two ways of one length are left to :func:`_detours`.
    """
    plain = []
    for cut in listed:
        known = g.sides(*cut[2:]) if cut[1] is None else None
        if known is None:
            plain.append(cut)
            continue
        (sides, w, slack), alike = known, []
        for at, (own, near), (other, far) in _crossing(g, ids, sides):
            start = near[np.searchsorted(own, at)] + w
            for k, x, now in zip(at.tolist(), start.tolist(), by_source(g.table(g.nodes[at], None, cut[2:]))):
                ahead = int(np.searchsorted(other, k))
                more = now[other[ahead:]] - (x + far[ahead:])
                longer = more > slack
                if (more[~longer] >= -slack).any():
                    alike.append(k)
                else:
                    yield more[longer & (more < np.inf)]
        yield from _plain_increases(g, g.nodes[alike], [cut])
    yield from _plain_increases(g, ids, plain)


def _plain_increases(g: Graph, ids: np.ndarray, listed: list[tuple]) -> Iterator[np.ndarray]:
    for some in np.array_split(ids, 2) if listed else ():  # two tables are held
        for _, rows in _detours(g, some, listed) if len(some) else ():
            for _, _, before, after in rows:
                way = np.isfinite(after)
                yield after[way] - before[way]


def increases(nodes: DataFrame, edges: DataFrame, cuts: DataFrame, ranks) -> dict[str, dict]:
    """:func:`quantiles.order_statistics` of the increases, ``after - before``, of all pairs with a way around."""
    graph, listed = _sent(edges), cut_list(cuts)

    def meeting(frame: pd.DataFrame) -> pd.DataFrame:
        """Sources that a scenario may affect, so that batches are full."""
        g, ids = graph.value, frame["s"].to_numpy(np.int64)
        meets = np.zeros(len(ids), bool)
        for _, node, u, v in listed:
            known = g.sides(u, v) if node is None else None
            for at, _, _ in _crossing(g, ids, known[0]) if known else ():
                meets |= np.isin(ids, g.nodes[at])
            meets |= known is None
        return frame[meets]

    def count(wanted: dict | None) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counted = quantiles.Counted(wanted, repeats=True)
            for ids in graph.value.sources(map(meeting, frames))[0]:
                for more in _increases(graph.value, ids, listed):
                    counted.add("more", more)
                    if counted.full:
                        yield counted.take()
            yield counted.take()

        return _dealt(nodes.select(F.col("node_id").alias("s")), graph).mapInPandas(run, quantiles.WHOLE_SCHEMA if wanted is None else quantiles.SCHEMA)

    return quantiles.order_statistics(count, ranks)


def survival(nodes: DataFrame, edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """A row per scenario and source: ``scenario, s, near, low, pairs, before, after, inverse``, and for scenario null the whole graph.

    ``near`` counts the nodes reached and ``low`` is the smallest; the others are sums over the pairs ``s < t`` that are left:
    their number, lengths before and after, and inverse lengths.
    """
    graph, listed = _sent(edges), cut_list(cuts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = graph.value
        batches, alone = g.sources(frames, 2)
        out = [(k, s, 0, s, 0, 0.0, 0.0, 0.0) for s in alone for k, node, _, _ in [(None,) * 4, *listed] if node != s or k is None]
        for ids in batches:
            base = g.table(ids)
            for scenario, node, u, v in [(None, None, None, None), *listed]:
                kept = np.flatnonzero(ids != node) if node is not None else np.arange(len(ids))
                left = base if scenario is None else g.table(ids[kept], node, None if u is None else (u, v))
                for s, was, now in zip(ids[kept].tolist(), by_source(base[:, kept]), by_source(left)):
                    there = np.flatnonzero(np.isfinite(now))
                    ahead = there[g.nodes[there] > s]
                    out.append((scenario, s, len(there) - 1, g.nodes[there[0]], len(ahead), was[ahead].sum(), now[ahead].sum(), (1 / now[ahead]).sum()))
        yield pd.DataFrame(out, columns=["scenario", "s", "near", "low", "pairs", "before", "after", "inverse"]).astype({"scenario": "Int64", "s": "int64", "near": "int64", "low": "int64", "pairs": "int64", "before": "float64", "after": "float64", "inverse": "float64"})

    return _dealt(nodes.select(F.col("node_id").alias("s")), graph).mapInPandas(run, "scenario long, s long, near long, low long, pairs long, before double, after double, inverse double")


def efficiency(nodes: DataFrame, edges: DataFrame, connected: bool = False) -> DataFrame:
    """As :func:`path_efficiency` over all pairs, summed in the tasks by source. ``connected`` makes pairs without a path an error."""
    graph = _sent(edges)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches, alone = graph.value.sources(frames)
        out = [(0, 0.0, 0.0) for _ in alone]
        for ids in batches:
            for d in by_source(graph.value.table(ids)):
                far = d[np.isfinite(d) & (d > 0)]
                out.append((len(far), far.sum(), (1 / far).sum()))
        yield pd.DataFrame(out, columns=["pairs", "dist", "inverse"]).astype({"pairs": "int64", "dist": "float64", "inverse": "float64"})

    sums = _dealt(nodes.select(F.col("node_id").alias("s")), graph).mapInPandas(run, "pairs long, dist double, inverse double")
    one = sums.agg(F.count("*").alias("n"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.sum("dist").alias("a"), F.sum("inverse").alias("x"))
    all_pairs = F.col("n") * (F.col("n") - 1)
    pairs = F.when(F.lit(not connected) | (F.col("pairs") == all_pairs), F.col("pairs")).otherwise(F.raise_error(F.lit("the graph is not connected")).cast("long"))
    per_pair = lambda c: F.when(F.col("pairs") > 0, F.col(c) / F.col("pairs"))
    return one.select("n", pairs.alias("pairs"), F.round(per_pair("a"), 6).alias("avg_path_m"), F.round(per_pair("x"), 9).alias("efficiency_reachable"), F.round(F.when(all_pairs > 0, F.coalesce("x", F.lit(0.0)) / all_pairs), 9).alias("efficiency_all"))


def single_pair(edges: DataFrame, source: int, target: int) -> DataFrame:
    """``s, t, dist, path`` of one pair, a row always: both null where there is no way."""
    spark = edges.sparkSession
    rows = distances(edges, all_sources(spark.createDataFrame([(source,)], "node_id long")), paths=True).where(F.col("t") == target)
    one = spark.createDataFrame([(source, target)], "s long, t long")
    return one.join(rows.select("s", "t", "dist", "path"), ["s", "t"], "left")


def all_sources(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.lit(0).cast("long").alias("scenario"), F.col("node_id").alias("s"), *(F.lit(None).cast("long").alias(c) for c in ("cut_node", "cut_u", "cut_v")))


def relaxed_distances(edges: DataFrame, sources: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``s, t, dist`` by rounds of joins, for graphs too large to send; as many rounds as the longest path has edges."""
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "length_m").unionAll(edges.select("dst", "src", "length_m"))
    known = materialize(sources.select(F.col("s"), F.col("s").alias("t"), F.lit(0.0).alias("dist")), "dist")
    sign = None
    for _ in range(max_rounds):
        step = known.join(both, known.t == both.u).select("s", F.col("v").alias("t"), (F.col("dist") + F.col("length_m")).alias("dist"))
        known = materialize(known.unionAll(step).groupBy("s", "t").agg(F.min("dist").alias("dist")), "dist")
        now = known.agg(F.count("*"), F.sum("dist")).first()
        if now == sign:
            return known
        sign = now
    raise RuntimeError("distances did not settle")


def path_efficiency(nodes: DataFrame, dist: DataFrame) -> DataFrame:
    """Mean path length, efficiency over reachable pairs, and over all pairs."""
    n = nodes.agg(F.count("*").alias("n"))
    pairs = dist.where("s <> t AND dist > 0").agg(F.count("*").alias("pairs"), F.avg("dist").alias("a"), F.avg(1 / F.col("dist")).alias("e"), F.sum(1 / F.col("dist")).alias("x"))
    out = pairs.crossJoin(n)
    return out.select("n", "pairs", F.round("a", 6).alias("avg_path_m"), F.round("e", 9).alias("efficiency_reachable"), F.round(F.col("x") / (F.col("n") * (F.col("n") - 1)), 9).alias("efficiency_all"))


def betweenness(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalized ``(node_id, bc)`` for all nodes and ``(src, dst, bc)`` for all edges, endpoints excluded."""
    graph = _sent(edges)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = graph.value
        by_node, by_arc = np.zeros(len(g.nodes)), np.zeros(len(g.to))
        total: dict[tuple[int, int | None], float] = {}
        for ids in g.sources(frames)[0]:
            for s in _tree_loads(g, ids, by_node, by_arc):
                _, prev, order, ways = g.dijkstra(s)
                load = dict.fromkeys(order, 0.0)
                for v in reversed(order):
                    for u in prev[v]:
                        share = ways[u] / ways[v] * (1 + load[v])
                        load[u] += share
                        total[min(u, v), max(u, v)] = total.get((min(u, v), max(u, v)), 0.0) + share
                    if v != s:
                        total[v, None] = total.get((v, None), 0.0) + load[v]
        yield pd.DataFrame([(*k, x) for k, x in total.items()], columns=["u", "v", "x"]).astype({"u": "int64", "v": "Int64", "x": "float64"})
        some = np.flatnonzero(by_node)
        yield pd.DataFrame({"u": g.nodes[some], "v": pd.array([None] * len(some), "Int64"), "x": by_node[some]})
        some = np.flatnonzero(by_arc)
        u, v = g.nodes[g.tail[some]], g.to[some]
        yield pd.DataFrame({"u": np.minimum(u, v), "v": pd.array(np.maximum(u, v), "Int64"), "x": by_arc[some]})

    n = F.broadcast(nodes.agg(F.count("*").cast("double").alias("n")))
    parts = materialize(_dealt(nodes.select(F.col("node_id").alias("s")), graph).mapInPandas(run, "u long, v long, x double").groupBy("u", "v").agg(F.sum("x").alias("x")), "loads")
    scale = F.when(F.col("n") > 2, 1 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(1.0)
    by_node = nodes.select("node_id").join(parts.where("v is null").select(F.col("u").alias("node_id"), "x"), "node_id", "left").crossJoin(n).select("node_id", (F.coalesce("x", F.lit(0.0)) * scale).alias("bc"))
    by_edge = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).join(parts.where("v is not null").withColumnsRenamed({"u": "src", "v": "dst"}), ["src", "dst"], "left").crossJoin(n)
    return by_node, by_edge.select("src", "dst", (F.coalesce("x", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1))).alias("bc"))


def ranked(bc: DataFrame, *ties: str, top: int = 10) -> DataFrame:
    """Rank by betweenness with a flag for the first ``top``. Order uses nine decimals, so that engines agree on ties."""
    rows = bc.withColumn("bc", F.round("bc", 9))
    return numbered(rows, F.desc("bc"), *ties).withColumn("gatekeeper", F.col("rank") <= top)


def cut_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst`` of the edges whose removal disconnects their ends: low-links per component, a component per task.

    More than ``MAX_EDGES`` edges, which are counted first, are refused rather than gathered.
    """
    if edges.count() > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges")
    comp = connected_components(edges, few=FEW)
    rows = edges.join(comp, edges.src == comp.vertex).select("component", "src", "dst")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[tuple[int, int]]] = {}
        for k, (u, v) in enumerate(zip(frame.src, frame.dst)):
            near.setdefault(u, []).append((v, k))
            near.setdefault(v, []).append((u, k))
        root, clock, seen, low, found = int(frame.src.min()), 0, {}, {}, []
        seen[root] = low[root] = 0
        stack = [(root, -1, iter(near[root]))]
        while stack:
            u, by, rest = stack[-1]
            for v, k in rest:
                if k == by:
                    continue
                if v in seen:
                    low[u] = min(low[u], seen[v])
                    continue
                clock += 1
                seen[v] = low[v] = clock
                stack.append((v, k, iter(near[v])))
                break
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[u])
                    if low[u] > seen[stack[-1][0]]:
                        found.append(by)
        return frame.iloc[sorted(found)][["src", "dst"]]

    return rows.groupBy("component").applyInPandas(run, "src long, dst long")

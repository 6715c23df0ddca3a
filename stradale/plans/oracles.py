"""DuckDB SQL for the queries, written apart from the operators."""

from __future__ import annotations

from stradale.functions.geo import geodesic_sql
from stradale.sources.fixtures import BAND, MANIFEST, MASK_CTE, PAIRS, SEGMENTS, SKELETON_CTE, TAGS, for_duck, network_sql

_REACH = """adj0 AS (SELECT src AS u, dst AS v, w FROM e0 UNION ALL SELECT dst, src, w FROM e0),
reach(a, b) AS (SELECT u, u FROM adj0 UNION SELECT r.a, j.v FROM reach r JOIN adj0 j ON r.b=j.u),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)"""
_NET = f"""WITH RECURSIVE {network_sql('net', 'n0', 'e0')}, {_REACH}, big AS (SELECT c FROM comp GROUP BY c ORDER BY count(*) DESC, c LIMIT 1),
n AS (SELECT n0.* FROM n0 JOIN comp ON a=node_id WHERE c=(SELECT c FROM big)), e AS (SELECT e0.* FROM e0 JOIN comp ON a=src WHERE c=(SELECT c FROM big)),
adj AS (SELECT src AS u, dst AS v, w FROM e UNION ALL SELECT dst, src, w FROM e)"""


def _dist(name: str, adj: str = "adj", nodes: str = "n") -> str:
    return f"""{name}(s, t, dist) USING KEY (s, t) AS (SELECT node_id, node_id, 0e0 FROM {nodes} UNION
 SELECT d.s, j.v, min(d.dist+j.w) FROM {name} d JOIN {adj} j ON d.t=j.u LEFT JOIN recurring.{name} AS o ON o.s=d.s AND o.t=j.v WHERE o.dist IS NULL OR d.dist+j.w<o.dist-1e-12 GROUP BY 1,2)"""


_D = f"{_NET}, {_dist('d')}"
_BCN = """cnt AS (SELECT count(*) AS n FROM n), bcn AS (SELECT n.node_id, coalesce(q.x,0)/((cnt.n-1)*(cnt.n-2)) AS bc FROM n CROSS JOIN cnt LEFT JOIN (
 SELECT a.t AS v, count(*) AS x FROM d a JOIN d b ON a.t=b.s JOIN d ab ON ab.s=a.s AND ab.t=b.t WHERE a.s<>a.t AND b.s<>b.t AND ab.s<>ab.t AND abs(a.dist+b.dist-ab.dist)<1e-6 GROUP BY 1) q ON q.v=n.node_id),
rankn AS (SELECT *, row_number() OVER (ORDER BY round(bc,9) DESC, node_id) AS rank FROM bcn)"""
_BCE = """bce AS (SELECT least(e.src,e.dst) AS src, greatest(e.src,e.dst) AS dst, sum(CASE WHEN abs(a.dist+e.w+b.dist-ab.dist)<1e-6 THEN 1 ELSE 0 END)/((SELECT count(*) FROM n)*((SELECT count(*) FROM n)-1)) AS bc
 FROM (SELECT u AS src, v AS dst, w FROM adj) e JOIN d a ON a.t=e.src JOIN d b ON b.s=e.dst JOIN d ab ON ab.s=a.s AND ab.t=b.t WHERE ab.s<>ab.t GROUP BY 1,2),
ranke AS (SELECT *, row_number() OVER (ORDER BY round(bc,9) DESC, src, dst) AS rank FROM bce)"""


def _cut(keep: str) -> str:
    """Distances within each scenario ``k`` of ``cuts``."""
    return f"""pd(k, s, t, dist) USING KEY (k, s, t) AS (SELECT cuts.k, node_id, node_id, 0e0 FROM n CROSS JOIN cuts WHERE node_id<>coalesce(cuts.x,-1) UNION
 SELECT d.k, d.s, j.v, min(d.dist+j.w) FROM pd d JOIN cuts ON cuts.k=d.k JOIN adj j ON d.t=j.u LEFT JOIN recurring.pd AS o ON o.k=d.k AND o.s=d.s AND o.t=j.v WHERE {keep} AND (o.dist IS NULL OR d.dist+j.w<o.dist-1e-12) GROUP BY 1,2,3)"""


_SUMMARY = """SELECT k AS scenario, count(*) AS affected, count(after) AS reroutable, count(*)-count(after) AS unreachable, round(count(after)/count(*),9) AS reroutable_fraction,
 round(avg(before) FILTER (after IS NOT NULL),6) AS mean_before_m, round(avg(after),6) AS mean_after_m, round(avg(after-before),6) AS mean_increase_m,
 round((avg(after)-avg(before) FILTER (after IS NOT NULL))/avg(before) FILTER (after IS NOT NULL)*100,6) AS mean_increase_pct, round(max(after-before),6) AS max_increase_m, round(max((after-before)/before*100),6) AS max_increase_pct
FROM routes GROUP BY k"""
_HEAL = f"WITH RECURSIVE {network_sql('heal', 'n0', 'e0')}, {_REACH}"
_ENDS = f"""deg AS (SELECT u, count(*) AS deg, min(v) AS o FROM adj0 GROUP BY u), ep AS (SELECT a.node_id, a.x, a.y, b.x AS ox, b.y AS oy FROM deg JOIN n0 a ON a.node_id=u JOIN n0 b ON b.node_id=o WHERE deg=1),
ends AS (SELECT node_id, x, y, (azimuth+180)-360*floor((azimuth+180)/360) AS bearing FROM ({geodesic_sql('ep', 'x', 'y', 'ox', 'oy')}))"""
_ANGLE = "abs(({a}-{b}+180)-360*floor(({a}-{b}+180)/360)-180)"
_CAND = f"""pr AS (SELECT p.node_id AS node_a, q.node_id AS node_b, p.x AS xa, p.y AS ya, q.x AS xb, q.y AS yb, p.bearing AS ba, q.bearing AS bq, cp.c AS ka, cq.c AS kb FROM ends p JOIN ends q ON p.node_id<q.node_id AND abs(p.x-q.x)<3e-3 AND abs(p.y-q.y)<2e-3
 JOIN comp cp ON cp.a=p.node_id JOIN comp cq ON cq.a=q.node_id WHERE cp.c<>cq.c),
g1 AS (SELECT node_a, node_b, xa, ya, xb, yb, ba, bq, ka, kb, dist AS gap_m, azimuth AS az1 FROM ({geodesic_sql('pr', 'xa', 'ya', 'xb', 'yb')})),
g2 AS (SELECT node_a, node_b, ka, kb, gap_m, {_ANGLE.format(a='ba', b='az1')} AS angle_a, {_ANGLE.format(a='bq', b='azimuth')} AS angle_b FROM ({geodesic_sql('g1', 'xb', 'yb', 'xa', 'ya')})),
cand AS (SELECT *, gap_m/100+(angle_a+angle_b)/2/45 AS cost FROM g2 WHERE gap_m<=100 AND angle_a<=45 AND angle_b<=45)"""
_BRIDGE = """rk AS (SELECT *, row_number() OVER (ORDER BY cost, node_a, node_b) AS k FROM cand),
rr(k, c) AS (SELECT k, ka FROM rk UNION SELECT r.k, CASE WHEN q.ka=r.c THEN q.kb ELSE q.ka END FROM rr r JOIN rk q ON q.k<r.k AND (q.ka=r.c OR q.kb=r.c)),
br AS (SELECT * FROM rk WHERE NOT EXISTS (SELECT 1 FROM rr WHERE rr.k=rk.k AND rr.c=rk.kb))"""
_AFTER = """cl AS (SELECT ka AS u, kb AS v FROM br UNION ALL SELECT kb, ka FROM br), cr(a, b) AS (SELECT DISTINCT c, c FROM comp UNION SELECT cr.a, cl.v FROM cr JOIN cl ON cl.u=cr.b),
after AS (SELECT min(b) AS g, comp.a FROM cr JOIN comp ON comp.c=cr.a GROUP BY comp.a)"""
_GAPS = f"{_HEAL}, {_ENDS}, {_CAND}"
_SCORES = {
    "zero": "round(CASE WHEN {d}>0 THEN {n}/{d} ELSE 0 END,9)",
    "epsilon": "round({n}/({d}+1e-8),9)",
    "mask": "round(CASE WHEN {d}>0 THEN {n}/{d} ELSE {e} END,9)",
}


def _scores(form: str) -> str:
    parts = {"iou": ("tp", "(tp+fp+fn)", 1), "dice": ("(2*tp)", "(2*tp+fp+fn)", 1), "precision": ("tp", "(tp+fp)", 0), "recall": ("tp", "(tp+fn)", 0)}
    return ", ".join(f"{_SCORES[form].format(n=n, d=d, e=e)} AS {k}" for k, (n, d, e) in parts.items())


_COUNTS = "count(*) FILTER (WHERE p>={t} AND truth=1) AS tp, count(*) FILTER (WHERE p>={t} AND truth=0) AS fp, count(*) FILTER (WHERE p<{t} AND truth=1) AS fn, count(*) FILTER (WHERE p<{t} AND truth=0) AS tn"
_BOUNDS = "bounds AS (SELECT scene, max(r)+1 AS height, max(c)+1 AS width FROM {src} GROUP BY scene)"


def _dilated(src: str, radius: int, disk: bool) -> str:
    return f"""SELECT DISTINCT a.scene, a.r+x.d AS r, a.c+y.d AS c FROM ({src}) a CROSS JOIN (SELECT unnest(range(-{radius},{radius}+1)) AS d) x CROSS JOIN (SELECT unnest(range(-{radius},{radius}+1)) AS d) y JOIN bounds b ON b.scene=a.scene
 WHERE a.r+x.d BETWEEN 0 AND height-1 AND a.c+y.d BETWEEN 0 AND width-1 {f'AND x.d*x.d+y.d*y.d<={radius * radius}' if disk else ''}"""


def _relaxed(r: int) -> str:
    return f"""(SELECT CAST({r} AS BIGINT) AS radius, (SELECT count(*) FROM wp{r} JOIN wt{r} USING (scene,r,c)) AS "both", (SELECT count(*) FROM (SELECT * FROM wp{r} UNION SELECT * FROM wt{r})) AS "any",
 round((SELECT count(*) FROM wp{r} JOIN wt{r} USING (scene,r,c))/(SELECT count(*) FROM (SELECT * FROM wp{r} UNION SELECT * FROM wt{r})),9) AS relaxed_iou,
 round((SELECT count(*) FROM tr JOIN wp{r} USING (scene,r,c))/(SELECT count(*) FROM tr),9) AS completeness, round((SELECT count(*) FROM pd JOIN wt{r} USING (scene,r,c))/(SELECT count(*) FROM pd),9) AS relaxed_precision)"""


_NEAR = "SELECT a.scene, a.r, a.c, b.r AS r2, b.c AS c2 FROM skel a JOIN (SELECT b.scene, b.r, b.c, b.r+x.d AS rr, b.c+y.d AS cc FROM skel b CROSS JOIN (SELECT unnest([-1,0,1]) AS d) x CROSS JOIN (SELECT unnest([-1,0,1]) AS d) y WHERE x.d<>0 OR y.d<>0) b ON b.scene=a.scene AND b.rr=a.r AND b.cc=a.c"
_DEG = f"{SKELETON_CTE}, near AS ({_NEAR}), dg AS (SELECT s.scene, s.r, s.c, count(near.r2) AS degree FROM skel s LEFT JOIN near ON near.scene=s.scene AND near.r=s.r AND near.c=s.c GROUP BY 1,2,3)"
_CLUSTER = f"""{_DEG}, np AS (SELECT scene, r, c FROM dg WHERE degree NOT IN (0,2)),
cl(scene, r, c, r2, c2) AS (SELECT scene, r, c, r, c FROM np UNION SELECT k.scene, k.r, k.c, near.r2, near.c2 FROM cl k JOIN near ON near.scene=k.scene AND near.r=k.r2 AND near.c=k.c2 JOIN np ON np.scene=near.scene AND np.r=near.r2 AND np.c=near.c2),
lab AS (SELECT scene, r, c, min(r2*1000000+c2) AS l FROM cl GROUP BY 1,2,3), mem AS (SELECT scene, r, c, dense_rank() OVER (PARTITION BY scene ORDER BY l) AS node_id FROM lab),
outside AS (SELECT mem.scene, node_id, count(DISTINCT near.r2*1000000+near.c2) AS degree FROM mem JOIN near ON near.scene=mem.scene AND near.r=mem.r AND near.c=mem.c WHERE NOT EXISTS (SELECT 1 FROM np WHERE np.scene=mem.scene AND np.r=near.r2 AND np.c=near.c2) GROUP BY 1,2)"""
_INNER = """inn AS (SELECT scene, r, c FROM dg WHERE degree=2),
co(scene, r, c, r2, c2) AS (SELECT scene, r, c, r, c FROM inn UNION SELECT k.scene, k.r, k.c, near.r2, near.c2 FROM co k JOIN near ON near.scene=k.scene AND near.r=k.r2 AND near.c=k.c2 JOIN inn ON inn.scene=near.scene AND inn.r=near.r2 AND inn.c=near.c2),
run AS (SELECT scene, r, c, min(r2*1000000+c2) AS l FROM co GROUP BY 1,2,3),
touch AS (SELECT run.scene, l, min(node_id) AS a, max(node_id) AS b FROM run JOIN near ON near.scene=run.scene AND near.r=run.r AND near.c=run.c JOIN mem ON mem.scene=run.scene AND mem.r=near.r2 AND mem.c=near.c2 GROUP BY 1,2 HAVING min(node_id)<>max(node_id))"""
_ERR = f"""{_NET}, {_dist('d')}, adj2 AS (SELECT src AS u, dst AS v, w*(1+(src%7)*1e-2) AS w FROM e UNION ALL SELECT dst, src, w*(1+(src%7)*1e-2) FROM e), {_dist('d2', 'adj2')},
er AS (SELECT d.s, d.t, d.dist AS length_m, d2.dist AS reference_m, abs(d.dist-d2.dist) AS abs_error_m, abs(d.dist-d2.dist)/d2.dist*100 AS error_pct FROM d JOIN d2 ON d.s=d2.s AND d.t=d2.t WHERE d.s<d.t)"""
_MAN = f"man AS ({for_duck(MANIFEST)})"
_SPLIT = "sp AS (SELECT scene, CASE WHEN i<round_even(n*0.7,0) THEN 'train' WHEN i<round_even(n*0.9,0) THEN 'val' ELSE 'test' END AS split FROM (SELECT scene, row_number() OVER (ORDER BY scene)-1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT scene FROM man)))"
_BANDS = f"px AS ({for_duck(BAND)})"
_STATS = "st AS (" + " UNION ALL ".join(f"SELECT '{b}' AS band, count({b}) AS n, round(avg({b}),6) AS mean, round(stddev_pop({b}),6) AS std, min({b}) AS min, max({b}) AS max FROM px" for b in "rgb") + ")"
_EFF = "round(avg(dist),6) AS avg_path_m, round(avg(1/dist),9) AS efficiency_reachable, round(sum(1/dist)/((SELECT count(*) FROM n)*((SELECT count(*) FROM n)-1)),9) AS efficiency_all FROM d WHERE s<>t"
_LENGTHS = "count(*) AS edges, round(sum(w),6) AS total_length_m, round(min(w),6) AS min_length_m, round(max(w),6) AS max_length_m, round(avg(w),6) AS avg_length_m"
_MOSAIC = f"""{MASK_CTE}, {_BOUNDS.format(src='mask')}, win AS (SELECT scene, row_number() OVER (PARTITION BY scene ORDER BY row0, col0)-1 AS tile, row0, col0 FROM
 (SELECT scene, row0, unnest(range(0, width-63, 48)) AS col0 FROM (SELECT scene, width, unnest(range(0, height-63, 48)) AS row0 FROM bounds)))"""
_FIRST = f"""{_D}, {_BCE}, bp(a, b, z) AS (SELECT src, dst, src FROM bce UNION SELECT bp.a, bp.b, j.v FROM bp JOIN adj j ON j.u=bp.z WHERE NOT (least(j.u,j.v)=bp.a AND greatest(j.u,j.v)=bp.b)),
alt AS (SELECT src, dst, bc, row_number() OVER (ORDER BY round(bc,9) DESC, src DESC, dst DESC) AS k, CAST(NULL AS BIGINT) AS x FROM bce b WHERE EXISTS (
  SELECT 1 FROM bp WHERE bp.a=b.src AND bp.b=b.dst AND bp.z=b.dst)),
cuts AS (SELECT * FROM alt WHERE bc>0 ORDER BY k LIMIT 1)"""

ORACLES = {
    "edge_length_summary": f"WITH {network_sql('net')} SELECT {_LENGTHS} FROM e",
    "node_degree_types": f"""WITH {network_sql('net')}, dg AS (SELECT node_id, (SELECT count(*) FROM e WHERE src=node_id OR dst=node_id) AS degree FROM n)
SELECT CASE WHEN degree<=1 THEN 'endpoint' WHEN degree>=3 THEN 'intersection' ELSE 'junction' END AS node_type, count(*) AS nodes, min(degree) AS min_degree, max(degree) AS max_degree, round(avg(degree),9) AS avg_degree FROM dg GROUP BY 1""",
    "simple_graph_dedup": f"SELECT least(u,v) AS src, greatest(u,v) AS dst, max(seq) AS seq FROM ({PAIRS}) WHERE v IS NOT NULL AND u<>v GROUP BY 1,2",
    "component_sizes": f"{_HEAL} SELECT c AS component, count(*) AS size FROM comp GROUP BY c",
    "largest_components": f"{_HEAL} SELECT c AS component, count(*) AS size FROM comp GROUP BY c ORDER BY 2 DESC, 1 LIMIT 20",
    "endpoint_bearings": f"{_HEAL}, {_ENDS} SELECT node_id, round(bearing,6) AS bearing FROM ends",
    "gap_candidates": f"{_GAPS} SELECT node_a, node_b, round(gap_m,6) AS gap_m, round(angle_a,6) AS angle_a, round(angle_b,6) AS angle_b, round(cost,9) AS cost FROM cand",
    "healing_bridges": f"{_GAPS}, {_BRIDGE} SELECT node_a, node_b, round(gap_m,6) AS gap_m FROM br",
    "remaining_components": f"""{_GAPS}, {_BRIDGE}, {_AFTER}, z AS (SELECT g, count(*) AS n FROM after GROUP BY g) SELECT g AS component, n AS size FROM z WHERE n<(SELECT max(n) FROM z)""",
    "healed_edges": f"""{_GAPS}, {_BRIDGE} SELECT row_number() OVER (ORDER BY src, dst) AS edge_id, src, dst, round(w,6) AS length_m, false AS bridge, NULL AS bridge_method, NULL AS gap_m, NULL AS angle_a, NULL AS angle_b, NULL AS mean_angle, NULL AS cost FROM e0
 UNION ALL SELECT (SELECT count(*) FROM e0)+row_number() OVER (ORDER BY cost, node_a, node_b), node_a, node_b, round(gap_m,6), true, 'mst_dsu', round(gap_m,6), round(angle_a,6), round(angle_b,6), round((angle_a+angle_b)/2,6), round(cost,6) FROM br""",
    "weighted_graph_report": f"""{_GAPS}, {_BRIDGE}, h AS (SELECT src, dst, w, 0 AS b FROM e0 UNION ALL SELECT node_a, node_b, gap_m, 1 FROM br), dg AS (SELECT u, count(*) AS d FROM (SELECT src AS u FROM h UNION ALL SELECT dst FROM h) GROUP BY u)
SELECT (SELECT count(*) FROM dg) AS nodes, (SELECT min(d) FROM dg) AS min_degree, (SELECT max(d) FROM dg) AS max_degree, (SELECT round(avg(d),9) FROM dg) AS avg_degree, {_LENGTHS}, CAST(sum(b) AS BIGINT) AS bridges FROM h""",
    "sample_routes": f"""{_D}, {_BCE}, cuts AS (SELECT rank AS k, src, dst, CAST(NULL AS BIGINT) AS x FROM ranke WHERE rank<=10), {_cut('NOT (least(j.u,j.v)=cuts.src AND greatest(j.u,j.v)=cuts.dst)')},
routes AS (SELECT cuts.k, ab.s, ab.t, ab.dist AS before, pd.dist AS after FROM cuts JOIN adj ON least(u,v)=src AND greatest(u,v)=dst JOIN d a ON a.t=adj.u JOIN d b ON b.s=adj.v JOIN d ab ON ab.s=a.s AND ab.t=b.t JOIN pd ON pd.k=cuts.k AND pd.s=ab.s AND pd.t=ab.t
 WHERE ab.s<ab.t AND abs(a.dist+adj.w+b.dist-ab.dist)<1e-6 ORDER BY 1,2,3 LIMIT 10)
SELECT k AS scenario, s, t, round(before,6) AS before, round(after,6) AS after, round(after-before,6) AS increase_m, s AS first, t AS last, (SELECT count(*) FROM d a JOIN d b ON a.t=b.s WHERE a.s=routes.s AND b.t=routes.t AND abs(a.dist+b.dist-routes.before)<1e-6) AS nodes_before FROM routes""",
    "healing_report": f"""{_GAPS}, {_BRIDGE}, {_AFTER}
SELECT (SELECT count(DISTINCT c) FROM comp) AS components_before, (SELECT max(n) FROM (SELECT count(*) AS n FROM comp GROUP BY c)) AS largest_before, (SELECT count(DISTINCT g) FROM after) AS components_after, (SELECT max(n) FROM (SELECT count(*) AS n FROM after GROUP BY g)) AS largest_after,
 (SELECT count(*) FROM br) AS bridges, (SELECT round(sum(gap_m),6) FROM br) AS bridge_length_m, (SELECT count(*) FROM e0) AS edges, (SELECT round(sum(w),6) FROM e0) AS length_m,
 round(((SELECT max(n) FROM (SELECT count(*) AS n FROM after GROUP BY g))-(SELECT max(n) FROM (SELECT count(*) AS n FROM comp GROUP BY c)))/(SELECT max(n) FROM (SELECT count(*) AS n FROM comp GROUP BY c))*100,9) AS connectivity_gain_pct,
 (SELECT count(*) FROM (SELECT count(*) AS n FROM after GROUP BY g) WHERE n<(SELECT max(n) FROM (SELECT count(*) AS n FROM after GROUP BY g))) AS remaining_components""",
    "all_pairs_shortest": f"{_D} SELECT s, t, round(dist,6) AS dist FROM d",
    "avg_path_efficiency": f"{_D} SELECT (SELECT count(*) FROM n) AS n, count(*) AS pairs, {_EFF}",
    "node_betweenness_rank": f"{_D}, {_BCN} SELECT rank, node_id, round(x,9) AS x, round(y,9) AS y, round(bc,9) AS bc, (SELECT count(*) FROM adj WHERE u=node_id) AS degree, rank<=10 AS gatekeeper FROM rankn JOIN n USING (node_id)",
    "edge_betweenness_rank": f"{_D}, {_BCE} SELECT rank, src, dst, round(bc,9) AS bc FROM ranke",
    "centrality_summary": f"{_D}, {_BCN} SELECT count(*) AS nodes, round(max(bc),9) AS max_bc, round(avg(bc),9) AS mean_bc FROM bcn",
    "bridge_edges": f"""{_NET}, bp(a, b, z) AS (SELECT src, dst, src FROM e UNION SELECT bp.a, bp.b, j.v FROM bp JOIN adj j ON j.u=bp.z WHERE NOT (least(j.u,j.v)=least(bp.a,bp.b) AND greatest(j.u,j.v)=greatest(bp.a,bp.b)))
SELECT least(src,dst) AS src, greatest(src,dst) AS dst FROM e WHERE NOT EXISTS (SELECT 1 FROM bp WHERE bp.a=src AND bp.b=dst AND bp.z=dst)""",
    "node_failure_scenarios": f"""{_D}, {_BCN}, cuts AS (SELECT node_id AS k, node_id AS x FROM rankn WHERE rank<=10), {_cut('j.v<>cuts.x')},
m AS (SELECT count(*) AS n FROM n), e0x AS (SELECT avg(1/dist) AS e FROM d WHERE s<t), pp AS (SELECT pd.k, count(*) AS c, avg(d.dist) AS b, avg(pd.dist) AS a, sum(1/pd.dist) AS x FROM pd JOIN d ON d.s=pd.s AND d.t=pd.t WHERE pd.s<pd.t GROUP BY pd.k),
cc AS (SELECT k, count(DISTINCT lo) AS comps, max(z) AS big FROM (SELECT k, s, min(t) AS lo, count(*) AS z FROM pd GROUP BY k, s) GROUP BY k)
SELECT cuts.k AS node_id, CAST((n-1)*(n-2)/2 AS BIGINT) AS possible_pairs, coalesce(c,0) AS reachable_pairs, CAST((n-1)*(n-2)/2 AS BIGINT)-coalesce(c,0) AS unreachable_pairs, round(coalesce(c,0)/((n-1)*(n-2)/2),9) AS reachable_fraction,
 round(b,6) AS mean_before_m, round(a,6) AS mean_after_m, round(b/a,9) AS resilience_index, round(coalesce(pp.x,0)/((n-1)*(n-2)/2),9) AS efficiency_after, round((coalesce(pp.x,0)/((n-1)*(n-2)/2)-e)/e*100,6) AS efficiency_change_pct, comps AS components, big AS largest_component
FROM cuts CROSS JOIN m CROSS JOIN e0x LEFT JOIN pp ON pp.k=cuts.k LEFT JOIN cc ON cc.k=cuts.k""",
    "node_rerouting": f"""{_D}, {_BCN}, cuts AS (SELECT node_id AS k, node_id AS x FROM rankn WHERE rank<=10), {_cut('j.v<>cuts.x')},
routes AS (SELECT cuts.k, ab.s, ab.t, ab.dist AS before, pd.dist AS after FROM cuts JOIN d a ON a.t=cuts.x JOIN d b ON b.s=cuts.x JOIN d ab ON ab.s=a.s AND ab.t=b.t LEFT JOIN pd ON pd.k=cuts.k AND pd.s=ab.s AND pd.t=ab.t
 WHERE ab.s<ab.t AND a.s<>cuts.x AND b.t<>cuts.x AND abs(a.dist+b.dist-ab.dist)<1e-6) {_SUMMARY}""",
    "edge_failure_rerouting": f"""{_D}, {_BCE}, cuts AS (SELECT rank AS k, src, dst, CAST(NULL AS BIGINT) AS x FROM ranke WHERE rank<=10), {_cut('NOT (least(j.u,j.v)=cuts.src AND greatest(j.u,j.v)=cuts.dst)')},
routes AS (SELECT cuts.k, ab.s, ab.t, ab.dist AS before, pd.dist AS after FROM cuts JOIN adj ON least(u,v)=src AND greatest(u,v)=dst JOIN d a ON a.t=adj.u JOIN d b ON b.s=adj.v JOIN d ab ON ab.s=a.s AND ab.t=b.t LEFT JOIN pd ON pd.k=cuts.k AND pd.s=ab.s AND pd.t=ab.t
 WHERE ab.s<ab.t AND abs(a.dist+adj.w+b.dist-ab.dist)<1e-6) {_SUMMARY}""",
    "reroutable_edge": f"""{_FIRST}, {_cut('NOT (least(j.u,j.v)=cuts.src AND greatest(j.u,j.v)=cuts.dst)')},
routes AS (SELECT cuts.k, pd.dist-ab.dist AS more FROM cuts JOIN adj ON least(u,v)=src AND greatest(u,v)=dst JOIN d a ON a.t=adj.u JOIN d b ON b.s=adj.v JOIN d ab ON ab.s=a.s AND ab.t=b.t JOIN pd ON pd.k=cuts.k AND pd.s=ab.s AND pd.t=ab.t
 WHERE ab.s<ab.t AND abs(a.dist+adj.w+b.dist-ab.dist)<1e-6)
SELECT src, dst, round(bc,9) AS bc, rerouted, mean_increase_m, median_increase_m, p95_increase_m, max_increase_m, round(mean/(30*1000/3600),6) AS mean_increase_s FROM cuts JOIN (SELECT k, count(*) AS rerouted, avg(more) AS mean, round(avg(more),6) AS mean_increase_m, round(median(more),6) AS median_increase_m,
 round(list_sort(list(more))[CAST(floor(0.95*(count(*)-1)) AS BIGINT)+1],6) AS p95_increase_m, round(max(more),6) AS max_increase_m FROM routes GROUP BY k) q ON q.k=cuts.k WHERE cuts.k=(SELECT min(k) FROM routes)""",
    "confusion_metrics": f"WITH {MASK_CTE}, c AS (SELECT {_COUNTS.format(t='5e-1')} FROM mask) " + " UNION ALL ".join(f"SELECT *, {_scores(f)}, '{f}' AS form FROM c" for f in _SCORES),
    "threshold_sweep": f"WITH {MASK_CTE}, c AS (SELECT threshold, {_COUNTS.format(t='threshold')}, round(avg(CASE WHEN p>=threshold THEN 1e0 ELSE 0e0 END),9) AS predicted_share FROM mask CROSS JOIN (SELECT unnest([1e-1,25e-2,35e-2,5e-1,65e-2,8e-1]) AS threshold) GROUP BY threshold) SELECT *, {_scores('zero')} FROM c",
    "probability_stats": f"WITH {MASK_CTE} SELECT round(min(p),9) AS min_p, round(max(p),9) AS max_p, round(avg(p),9) AS mean_p, round(stddev_samp(p),9) AS std_p FROM mask",
    "prediction_difference": f"WITH {MASK_CTE} SELECT round(max(abs(p-p*p)),9) AS max_abs, round(avg(abs(p-p*p)),9) AS mean_abs FROM mask",
    "occlusion_recall": f"WITH {MASK_CTE}, c AS (SELECT count(*) FILTER (WHERE truth=1 AND occ) AS occluded_truth, count(*) FILTER (WHERE truth=1 AND occ AND p>=5e-1) AS occluded_hit FROM mask) SELECT *, round(occluded_hit/occluded_truth,9) AS occlusion_recall FROM c",
    "relaxed_metrics": f"WITH {MASK_CTE}, {_BOUNDS.format(src='mask')}, pd AS (SELECT scene, r, c FROM mask WHERE p>=5e-1), tr AS (SELECT scene, r, c FROM mask WHERE truth=1), "
    + ", ".join(f"wp{r} AS ({_dilated('SELECT * FROM pd', r, True)}), wt{r} AS ({_dilated('SELECT * FROM tr', r, True)})" for r in (3, 5)) + f" SELECT * FROM {_relaxed(3)} UNION ALL SELECT * FROM {_relaxed(5)}",
    "dilate_square": f"WITH {SKELETON_CTE}, {_BOUNDS.format(src='skel')} SELECT scene, count(*) AS pixels, CAST(sum(r) AS BIGINT) AS sum_r, CAST(sum(c) AS BIGINT) AS sum_c FROM ({_dilated('SELECT * FROM skel', 5, False)}) GROUP BY scene",
    "dilate_disk": f"WITH {SKELETON_CTE}, {_BOUNDS.format(src='skel')} SELECT scene, count(*) AS pixels, CAST(sum(r) AS BIGINT) AS sum_r, CAST(sum(c) AS BIGINT) AS sum_c FROM ({_dilated('SELECT * FROM skel', 3, True)}) GROUP BY scene",
    "tile_manifest": f"""WITH {_MOSAIC} SELECT win.scene, win.tile, CAST(sum(truth) AS BIGINT) AS road_pixels, count(*) AS pixels, round(sum(truth)/count(*),9) AS road_fraction, sum(truth)>0 AS has_road
FROM win JOIN mask m ON win.scene=m.scene AND m.r BETWEEN row0 AND row0+63 AND m.c BETWEEN col0 AND col0+63 GROUP BY 1,2""",
    "pixel_extent": f"""WITH {SKELETON_CTE} SELECT scene, round(225e-2,8) AS "left", round(48.85e0-1e-5*(max(r)+1),8) AS bottom, round(225e-2+1e-5*(max(c)+1),8) AS "right", round(4885e-2,8) AS top,
 round(min(225e-2+1e-5*(c+5e-1)),8) AS min_x, round(max(48.85e0-1e-5*(r+5e-1)),8) AS max_y, round(avg(225e-2+1e-5*(c+5e-1)),8) AS mean_x, round(avg(48.85e0-1e-5*(r+5e-1)),8) AS mean_y FROM skel GROUP BY scene""",
    "tile_windows": f"WITH {_MOSAIC} SELECT scene, tile, row0, col0 FROM win",
    "stitch_mosaic": f"""WITH {_MOSAIC}, mo AS (SELECT m.scene, m.r, m.c, avg(p+((tile*13)%7-3)*1e-3) AS p, count(tile) AS n FROM mask m LEFT JOIN win ON win.scene=m.scene AND m.r BETWEEN row0 AND row0+63 AND m.c BETWEEN col0 AND col0+63 GROUP BY 1,2,3)
SELECT scene, n, count(*) AS pixels, round(sum(CASE WHEN (r+c)%5=0 OR p IS NULL THEN 0 ELSE p END),6) AS sum_p FROM mo GROUP BY 1,2""",
    "scene_split": f"WITH {_MAN}, {_SPLIT} SELECT scene, split FROM sp",
    "split_summary": f"WITH {_MAN}, {_SPLIT} SELECT split, count(*) AS tiles, count(*) FILTER (WHERE road_pixels>0) AS with_road, count(*) FILTER (WHERE road_pixels=0) AS empty, round(avg(road_pixels/pixels),9) AS mean_road_fraction FROM man JOIN sp USING (scene) GROUP BY split",
    "class_balance": f"WITH {_MAN}, c AS (SELECT CAST(sum(road_pixels) AS BIGINT) AS road, CAST(sum(pixels-road_pixels) AS BIGINT) AS background FROM man) SELECT road, background, round(road/(road+background),9) AS road_fraction, round(background/road,6) AS pos_weight FROM c",
    "positive_sampling_share": f"WITH {_MAN} SELECT round(3e0*count(*) FILTER (WHERE road_pixels>0)/(3e0*count(*) FILTER (WHERE road_pixels>0)+count(*) FILTER (WHERE road_pixels=0)),9) AS expected_share FROM man",
    "image_mask_manifest": f"WITH {_MAN}, {_SPLIT}, nm AS (SELECT *, scene||'/'||scene||'_tile_'||lpad(CAST(tile AS VARCHAR),3,'0')||'.tif' AS nm FROM man JOIN sp USING (scene)) SELECT split, scene, tile, split||'/images/'||nm AS image_path, split||'/masks/'||nm AS mask_path, 3 AS channels, 256 AS height, 256 AS width, CAST(road_pixels AS BIGINT) AS road_pixels, round(road_pixels/65536,9) AS road_fraction, road_pixels>0 AS has_road FROM nm",
    "band_stats": f"WITH {_BANDS}, {_STATS} SELECT * FROM st",
    "normalize_pixels": f"WITH {_BANDS}, {_STATS} SELECT tile, pixel, " + ", ".join(f"round(({b}-(SELECT mean FROM st WHERE band='{b}'))/(SELECT std FROM st WHERE band='{b}'),6) AS {b}_z, round(greatest(0e0,least(1e0,{b}/(SELECT max FROM st WHERE band='{b}'))),6) AS {b}_u" for b in "rgb")
    + ", round((g-min(g) OVER (PARTITION BY tile))/(max(g) OVER (PARTITION BY tile)-min(g) OVER (PARTITION BY tile)+1e-8),6) AS g_m FROM px",
    "graph_edges": f"""WITH RECURSIVE {_CLUSTER}, {_INNER}, cen AS (SELECT scene, node_id, 225e-2+1e-5*(avg(c)+5e-1) AS x, 48.85e0-1e-5*(avg(r)+5e-1) AS y FROM mem GROUP BY 1,2),
tp AS (SELECT DISTINCT run.scene, run.l, mem.node_id, run.r, run.c FROM run JOIN near ON near.scene=run.scene AND near.r=run.r AND near.c=run.c JOIN mem ON mem.scene=run.scene AND mem.r=near.r2 AND mem.c=near.c2),
sg AS (SELECT run.scene, run.l, 225e-2+1e-5*(run.c+5e-1) AS xa, 48.85e0-1e-5*(run.r+5e-1) AS ya, 225e-2+1e-5*(q.c+5e-1) AS xb, 48.85e0-1e-5*(q.r+5e-1) AS yb
  FROM run JOIN near ON near.scene=run.scene AND near.r=run.r AND near.c=run.c JOIN run q ON q.scene=run.scene AND q.l=run.l AND q.r=near.r2 AND q.c=near.c2 WHERE run.r*1000000+run.c<q.r*1000000+q.c
  UNION ALL SELECT tp.scene, l, x, y, 225e-2+1e-5*(c+5e-1), 48.85e0-1e-5*(r+5e-1) FROM tp JOIN cen USING (scene, node_id)),
gs AS ({geodesic_sql('sg', 'xa', 'ya', 'xb', 'yb')}), lg AS (SELECT scene, l, sum(dist) AS length_m FROM gs GROUP BY 1,2), sz AS (SELECT scene, l, count(*) AS pixels FROM run GROUP BY 1,2)
SELECT 'scene_'||touch.scene AS scene, row_number() OVER (PARTITION BY touch.scene ORDER BY a, b, touch.l)-1 AS edge_id, a AS start_node, b AS end_node, pixels AS pixel_count, round(length_m,6) AS length_m, pixels+2 AS points FROM touch JOIN sz USING (scene, l) JOIN lg USING (scene, l)""",
    "skeleton_degree": f"WITH {_DEG} SELECT scene, degree, count(*) AS pixels FROM dg GROUP BY 1,2",
    "node_clusters": f"""WITH RECURSIVE {_CLUSTER} SELECT scene, node_id, count(*) AS pixels, round(avg(r),6) AS "row", round(avg(c),6) AS col, coalesce(any_value(degree),0) AS degree,
 CASE WHEN coalesce(any_value(degree),0)<=1 THEN 'endpoint' WHEN any_value(degree)>=3 THEN 'intersection' ELSE 'junction' END AS node_type FROM mem LEFT JOIN outside USING (scene,node_id) GROUP BY 1,2""",
    "corridor_edges": f"WITH RECURSIVE {_CLUSTER}, {_INNER} SELECT scene, a AS start_node, b AS end_node, count(DISTINCT l) AS edges, count(*) AS pixels FROM touch JOIN run USING (scene, l) GROUP BY 1,2,3",
    "nearest_snap": f"""WITH {network_sql('net', 'n', 'e')}, hl AS (SELECT c_custkey AS point_id, CAST(2.25e0+(c_custkey%25)*8e-4+((c_custkey*7919)%1000)*1e-7 AS DOUBLE) AS px, CAST(48.85e0+(c_custkey//25)*5e-4+((c_custkey*104729)%1000)*1e-7 AS DOUBLE) AS py FROM customer),
cx AS (SELECT point_id, node_id, px, py, x, y FROM hl CROSS JOIN n), gd AS ({geodesic_sql('cx', 'px', 'py', 'x', 'y')})
SELECT point_id, node_id, round(dist,6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, node_id) AS k FROM gd) WHERE k=1""",
    "od_path_error": f"{_ERR} SELECT s, t, round(length_m,6) AS length_m, round(reference_m,6) AS reference_m, round(abs_error_m,6) AS abs_error_m, round(error_pct,6) AS error_pct FROM er",
    "path_error_summary": f"""{_ERR} SELECT count(*) AS pairs, round(avg(abs_error_m),6) AS mean_abs_m, round(median(abs_error_m),6) AS median_abs_m, round(avg(error_pct),6) AS mean_pct, round(median(error_pct),6) AS median_pct, round(max(error_pct),6) AS max_pct,
 round(avg(length_m),6) AS mean_length_m, round(avg(reference_m),6) AS mean_reference_m FROM er""",
    "highway_histogram": f"SELECT tag, count(*) AS n FROM (SELECT unnest(highway) AS tag FROM ({for_duck(TAGS)})) WHERE tag IS NOT NULL GROUP BY tag",
    "mask_algebra": f"WITH {MASK_CTE}, q AS (SELECT scene, c, p>=5e-1 AS p, truth=1 AS t FROM mask) " + " UNION ALL ".join(f"SELECT scene, count(*) AS pixels, CAST(sum(c) AS BIGINT) AS sum_c, '{how}' AS how FROM q WHERE {how_sql} GROUP BY scene" for how, how_sql in (("and", "p AND t"), ("or", "p OR t"), ("and not", "p AND NOT t"))),
    "od_sample": f"""{_NET}, k AS (SELECT node_id, row_number() OVER (ORDER BY node_id)-1 AS i FROM n), z AS (SELECT count(*) AS n, count(*)*(count(*)-1) AS p FROM n),
q AS (SELECT (i*(CASE WHEN p%1000003<>0 THEN 1000003 ELSE 1000033 END)+42*7919)%p AS x, n FROM z, (SELECT unnest(range(0,500)) AS i) r WHERE i<p), w AS (SELECT x//(n-1) AS a, x%(n-1) AS b FROM q)
SELECT k1.node_id AS s, k2.node_id AS t FROM w JOIN k k1 ON k1.i=a JOIN k k2 ON k2.i=b+(CASE WHEN b>=a THEN 1 ELSE 0 END)""",
    "scalar_functions": """WITH q AS (SELECT s_suppkey AS k, s_nationkey AS m, s_suppkey*7919%360 AS a, s_suppkey*104729%360 AS b FROM supplier)
SELECT k, 'AOI_'||k||'_tile_'||lpad(CAST(m AS VARCHAR),3,'0')||'.tif' AS tile_name, 'AOI_'||k AS scene_id, CAST(least(abs(a-b),360-abs(a-b)) AS DOUBLE) AS angle, (a+180)%360 AS reverse, CASE WHEN b>0 THEN round(a/b,9) ELSE -1 END AS ratio, round(a/(b+1e-8),6) AS eps,
 CASE WHEN b>0 THEN round((a-b)/b*100,6) ELSE 0 END AS change, round(a/(30*1000/3600),6) AS seconds, round(1/(1+exp(-CAST(m-12 AS DOUBLE))),9) AS sigmoid, CASE WHEN m%5<=1 THEN 'endpoint' WHEN m%5>=3 THEN 'intersection' ELSE 'junction' END AS node_type, CASE WHEN k%3<>0 THEN '7' ELSE 'x7' END AS maybe_id, CASE WHEN m>12 THEN 1 ELSE 0 END AS binary, round(greatest(0,least(1,(m-3)/20e0))*20,6) AS unscaled, (m%2<>0 OR coalesce(CASE WHEN k%5>0 THEN k%3 END,0)<>0) AS valid FROM q""",
    "positive_tile_stats": f"""WITH {_MOSAIC}, tl AS (SELECT win.scene, win.tile, p, max(truth) OVER (PARTITION BY win.scene, win.tile) AS t FROM win JOIN mask m ON win.scene=m.scene AND m.r BETWEEN row0 AND row0+63 AND m.c BETWEEN col0 AND col0+63)
SELECT round(min(p),9) AS min_p, round(max(p),9) AS max_p, round(avg(p),9) AS mean_p, round(stddev_samp(p),9) AS std_p FROM tl WHERE t>0""",
    "formatted_balance": f"WITH {_MAN}, c AS (SELECT CAST(sum(road_pixels) AS BIGINT) AS road, CAST(sum(pixels-road_pixels) AS BIGINT) AS background FROM man) SELECT format('{{:,}}', road) AS road, format('{{:,}}', background) AS background, printf('%.6f%%', round(road/(road+background),9)*100) AS road_percent FROM c",
    "single_pair": f"{_D}, ends AS (SELECT min(node_id) AS a, max(node_id) AS b FROM n) SELECT s, t, round(dist,6) AS dist, s AS first, t AS last FROM d JOIN ends ON s=a AND t=b UNION ALL SELECT a, -1, NULL, NULL, NULL FROM ends",
    "directed_to_undirected": f"""SELECT src, dst, seq, length_m FROM (SELECT least(u,v) AS src, greatest(u,v) AS dst, seq, CAST(seq%997 AS DOUBLE) AS length_m, row_number() OVER (PARTITION BY least(u,v), greatest(u,v) ORDER BY seq%997, seq) AS k FROM ({PAIRS}) WHERE v IS NOT NULL AND u<>v) WHERE k=1""",
    "geojson_round_trip": f"""WITH {network_sql('net')}, dg AS (SELECT node_id, x, y, (SELECT count(*) FROM e WHERE src=node_id OR dst=node_id) AS d FROM n)
SELECT 'node' AS kind, node_id AS id, x, y, CAST(d AS DOUBLE) AS value FROM dg UNION ALL SELECT 'edge', row_number() OVER (ORDER BY src, dst), a.x, b.y, round(w,6) FROM e JOIN n a ON a.node_id=src JOIN n b ON b.node_id=dst""",
    "graphml_round_trip": f"WITH {network_sql('net')} SELECT src, dst, round(w,6) AS length_m, x, y FROM e JOIN n ON node_id=src",
    "manifest_round_trip": f"""WITH {_MAN}, {_SPLIT}, nm AS (SELECT *, 'scene_'||scene||'_tile_'||lpad(CAST(tile AS VARCHAR),3,'0')||'.tif' AS f FROM man JOIN sp USING (scene))
SELECT 'scene_'||scene AS scene_id, f AS tile, 'images/'||f AS image_path, 3 AS channels, CAST(road_pixels AS BIGINT) AS road_pixels, round(road_pixels/pixels,9) AS road_fraction, road_pixels>0 AS has_road FROM nm WHERE split='train'""",
    "geotiff_window": f"WITH {MASK_CTE} SELECT scene, count(*) AS pixels, CAST(sum(truth) AS BIGINT) AS road, min(r) AS top, max(c) AS \"right\" FROM mask WHERE r BETWEEN 10 AND 49 AND c BETWEEN 20 AND 69 GROUP BY scene",
    "rasterized_lines": f"""WITH sg AS ({SEGMENTS}), ct AS (SELECT *, unnest(list_concat([0e0, 1e0], list_transform(range(CAST(floor(least(r0,r1)) AS BIGINT)+1, CAST(ceil(greatest(r0,r1)) AS BIGINT)), lambda k: (k-r0)/(r1-r0)), list_transform(range(CAST(floor(least(c0,c1)) AS BIGINT)+1, CAST(ceil(greatest(c0,c1)) AS BIGINT)), lambda k: (k-c0)/(c1-c0)))) AS t FROM sg),
md AS (SELECT *, (t+lead(t) OVER (PARTITION BY scene, r0, c0, r1, c1 ORDER BY t))/2 AS m FROM (SELECT DISTINCT * FROM ct)), px AS (SELECT DISTINCT scene, CAST(floor(r0+m*(r1-r0)) AS BIGINT) AS r, CAST(floor(c0+m*(c1-c0)) AS BIGINT) AS c FROM md WHERE m IS NOT NULL)
SELECT scene, count(*) AS pixels, CAST(sum(r) AS BIGINT) AS sum_r, CAST(sum(c) AS BIGINT) AS sum_c FROM px GROUP BY scene""",
    "geodesic_pairs": f"WITH {network_sql('net')}, pq AS (SELECT a.node_id, a.x, a.y, b.x AS x2, b.y AS y2 FROM n a JOIN n b ON b.node_id=a.node_id+13) SELECT node_id, round(dist,6) AS dist, round(azimuth,6) AS azimuth FROM ({geodesic_sql('pq', 'x', 'y', 'x2', 'y2')})",
}
_REPORTS = {
    "edge_length_summary": ("edges", "total_length_m"), "avg_path_efficiency": ("n", "avg_path_m", "efficiency_all"), "class_balance": ("road_fraction",), "healing_report": ("components_before", "components_after", "bridges"),
    "centrality_summary": ("max_bc",), "path_error_summary": ("mean_abs_m", "max_pct"),
}
ORACLES["results_summary"] = "SELECT " + ", ".join(
    [f"(SELECT {c} FROM ({ORACLES[name]})) AS {c}" for name, columns in _REPORTS.items() for c in columns]
    + [f"(SELECT count(*) FROM ({ORACLES['node_failure_scenarios']})) AS scenarios", f"(SELECT round(avg(resilience_index),6) FROM ({ORACLES['node_failure_scenarios']})) AS mean_resilience"]
    + [f"(SELECT CAST(sum({c}) AS BIGINT) FROM ({ORACLES[name]})) AS {kind}_{c}" for kind, name in (("node", "node_rerouting"), ("edge", "edge_failure_rerouting")) for c in ("affected", "reroutable")]
)

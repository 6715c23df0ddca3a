"""Road networks, masks, tiles and manifests derived from the driver's tables, as Spark SQL and as DuckDB CTEs.

Only integer arithmetic and literals are used, so both engines derive equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stradale.functions.geo import geodesic_sql, with_geodesic


def _lattice(table: str, key: str, width: int) -> str:
    return f"SELECT {key} AS k, CAST(2.25e0+({key}%{width})*8e-4+(({key}*7919)%1000)*1e-7 AS DOUBLE) AS x, CAST(48.85e0+({key} DIV {width})*5e-4+(({key}*104729)%1000)*1e-7 AS DOUBLE) AS y, * FROM {table}"


def _links(width: int, east: str, north: str) -> str:
    return f"SELECT a.k AS src, b.k AS dst, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM lat a JOIN lat b ON (b.k=a.k+1 AND a.k%{width}<>{width - 1} AND ({east})) OR (b.k=a.k+{width} AND ({north}))"


#: name -> table, key, width, east and north predicates
NETWORKS = {
    "net": ("supplier", "s_suppkey", 10, "a.s_nationkey%4<>0", "a.s_nationkey%3<>0"),
    "heal": ("customer", "c_custkey", 25, "a.c_mktsegment IN ('BUILDING','MACHINERY')", "a.c_nationkey%5<2"),
}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def network(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    """``nodes(node_id, x, y)`` and ``edges(edge_id, src, dst, length_m)`` of a lattice."""
    table, key, width, east, north = NETWORKS[name]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    lat = spark.sql(_lattice("{t}", key, width), t=source)
    step = lambda d, ok: lat.alias("a").selectExpr(f"k+{d} AS to", "k AS src", "x AS x1", "y AS y1", f"({ok}) AS ok").where("ok")
    ends = lat.selectExpr("k AS to", "x AS x2", "y AS y2")
    both = step(1, f"k%{width}<>{width - 1} AND {east}").unionByName(step(width, north))
    pairs = both.join(ends, "to").selectExpr("src", "to AS dst", "x1", "y1", "x2", "y2")
    edges = with_geodesic(pairs, "x1", "y1", "x2", "y2", "length_m", "azimuth").select("src", "dst", "length_m")
    return lat.selectExpr("k AS node_id", "x", "y"), edges


def network_sql(name: str, n: str = "n", e: str = "e") -> str:
    """CTEs ``n(node_id, x, y)`` and ``e(src, dst, w)`` for DuckDB."""
    table, key, width, east, north = NETWORKS[name]
    lat = _lattice(table, key, width).replace(" DIV ", "//")
    return f"lat AS ({lat}), {n} AS (SELECT k AS node_id, x, y FROM lat), pairs AS ({_links(width, east, north)}), {e} AS (SELECT src, dst, dist AS w FROM ({geodesic_sql('pairs', 'x1', 'y1', 'x2', 'y2')}))"


#: All consecutive suppliers of an order's lines.
PAIRS = """SELECT l_suppkey AS u, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS v,
 l_orderkey*100+row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS seq FROM lineitem"""
MANIFEST = """SELECT p_partkey DIV 36 AS scene, p_partkey%36 AS tile, CASE WHEN p_size%3=0 THEN 0 ELSE (p_partkey*7919)%65536 END AS road_pixels, 65536 AS pixels FROM part"""
BAND = """SELECT p_partkey DIV 100 AS tile, p_partkey AS pixel, CAST(p_size*30 AS DOUBLE) AS r, p_retailprice AS g, CAST((p_partkey*37)%1000 AS DOUBLE) AS b FROM part"""
SEGMENTS = """SELECT s_suppkey%3 AS scene, CAST((s_suppkey*37)%101+25e-2 AS DOUBLE) AS r0, CAST((s_suppkey*53)%89+75e-2 AS DOUBLE) AS c0, CAST((s_suppkey*71)%97+5e-1 AS DOUBLE) AS r1, CAST((s_suppkey*29)%83+125e-3 AS DOUBLE) AS c1 FROM supplier"""
TAGS = """SELECT o_orderkey, CASE WHEN o_orderkey%11=0 THEN NULL WHEN o_orderkey%7=0 THEN {array}(o_orderpriority,o_orderstatus) ELSE {array}(o_orderpriority) END AS highway FROM orders"""
SKELETON = """SELECT DISTINCT scene, r0+dr*i AS r, c0+dc*i AS c FROM (
 SELECT (k DIV 25) DIV 20 AS scene, ((k DIV 25)%20)*6 AS r0, (k%25)*6 AS c0, dr, dc FROM (
  SELECT a.c_custkey AS k, 0 AS dr, 1 AS dc FROM customer a JOIN customer b ON b.c_custkey=a.c_custkey+1 WHERE a.c_custkey%25<>24 AND a.c_mktsegment IN ('BUILDING','MACHINERY')
  UNION ALL SELECT a.c_custkey, 1, 0 FROM customer a JOIN customer b ON b.c_custkey=a.c_custkey+25 WHERE a.c_nationkey%5<2 AND (a.c_custkey DIV 25)%20<>19)) q
 CROSS JOIN (SELECT {unnest}({seq}(0,{six})) AS i) s"""
MASK = """SELECT g.scene, g.r, g.c, CASE WHEN t.r IS NULL THEN 0 ELSE 1 END AS truth,
 35e-2*(CASE WHEN t.r IS NULL THEN 0 ELSE 1 END)+65e-2*((g.r*7919+g.c*104729+g.scene*31)%1000)/1000e0 AS p, (g.r DIV 16+g.c DIV 16)%3=0 AS occ
 FROM (SELECT scene, r, {unnest}({seq}(0,mc{last})) AS c FROM (SELECT scene, mc, {unnest}({seq}(0,mr{last})) AS r FROM (SELECT scene, max(r) AS mr, max(c) AS mc FROM skel GROUP BY scene) b) d) g
 LEFT JOIN (SELECT DISTINCT scene, r+dr AS r, c+dc AS c FROM skel CROSS JOIN (SELECT {unnest}({seq}(-1,{two})) AS dr) x CROSS JOIN (SELECT {unnest}({seq}(-1,{two})) AS dc) y) t ON t.scene=g.scene AND t.r=g.r AND t.c=g.c"""
_SPARK = {"unnest": "explode", "seq": "sequence", "six": 6, "last": "", "two": 1, "array": "array"}
_DUCK = {"unnest": "unnest", "seq": "range", "six": 7, "last": "+1", "two": 2, "array": "list_value"}


def for_spark(text: str) -> str:
    return text.format(**_SPARK)


def for_duck(text: str) -> str:
    return text.format(**_DUCK).replace(" DIV ", "//")


def _merged(text: str, start: str, *names: str) -> str:
    """``text`` with the joins of the selects that begin with ``start`` as merges: what ``explode`` makes of few rows is taken for as few
    rows, and would be broadcast."""
    return text.replace(f"SELECT {start}", f"SELECT /*+ MERGE({', '.join(names)}) */ {start}")


def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "customer")
    return spark.sql(_merged(for_spark(SKELETON), "a.c_custkey", "a", "b"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    skeleton(spark, sf_dir).createOrReplaceTempView("skel")
    return spark.sql(_merged(for_spark(MASK), "g.scene", "g", "t"))


SKELETON_CTE = f"skel AS ({for_duck(SKELETON)})"
MASK_CTE = f"{SKELETON_CTE}, mask AS ({for_duck(MASK)})"

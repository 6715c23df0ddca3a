"""GeoJSON, GraphML, node-link JSON, manifests, reports and file inventories."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stradale.functions.scalars import readable_size
from stradale.operators.ordinal import numbered

NODES = "struct<features:array<struct<geometry:struct<coordinates:array<double>>,properties:struct<node_id:bigint,node_type:string,degree:int>>>>"
EDGES = "struct<features:array<struct<geometry:struct<coordinates:array<array<double>>>,properties:struct<edge_id:bigint,start_node:bigint,end_node:bigint,length_m:double,pixel_count:int,bridge:boolean,bridge_method:string>>>>"
MANIFEST = "split string, scene_id string, tile string, image_path string, mask_path string, channels int, height int, width int, road_pixels long, road_fraction double, has_road boolean"


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


#: Names of the coordinate system that coordinates have to be in: longitude and latitude on WGS84.
DEGREES = ("urn:ogc:def:crs:OGC:1.3:CRS84", "urn:ogc:def:crs:OGC::CRS84", "urn:ogc:def:crs:EPSG::4326", "EPSG:4326")


def _features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document per file; a missing path is an error, and so are coordinates that are not degrees. No ``crs`` means degrees."""
    told = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    doc = F.from_json("value", schema.removesuffix(">") + ",crs:struct<properties:struct<name:string>>>")
    name = doc["crs"]["properties"]["name"]
    fine = name.isNull() | name.isin(*DEGREES)
    features = F.when(fine, doc["features"]).otherwise(F.raise_error(F.concat(F.lit("coordinates have to be in EPSG:4326, not in "), name)))
    return told.select(F.inline(features))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    p = F.col("properties")
    return _features(spark, path, NODES).select(p["node_id"].alias("node_id"), F.col("geometry.coordinates")[0].alias("x"), F.col("geometry.coordinates")[1].alias("y"), F.coalesce(p["node_type"], F.lit("unknown")).alias("node_type"), F.coalesce(p["degree"], F.lit(0)).alias("degree"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    p = F.col("properties")
    return _features(spark, path, EDGES).where(F.size("geometry.coordinates") > 0).select(F.coalesce(p["edge_id"], F.lit(-1).cast("long")).alias("edge_id"), p["start_node"].alias("src"), p["end_node"].alias("dst"), F.coalesce(p["length_m"], F.lit(0.0)).alias("length_m"), p["pixel_count"].alias("pixel_count"), F.coalesce(p["bridge"], F.lit(False)).alias("bridge"), p["bridge_method"].alias("bridge_method"), F.col("geometry.coordinates").alias("coordinates"))


#: Features of a GeoJSON document at most; more are written as several documents.
PER_FILE = 100_000


def _collection(features: DataFrame, path: str, per_file: int) -> None:
    """Documents of up to ``per_file`` features each, in the order of ids: a document is one value by its format, and so bounded."""
    if features.count() <= per_file:
        one = features.agg(F.array_sort(F.collect_list(F.struct("id", "f"))).alias("a"))
    else:
        part = F.floor((F.col("rank") - 1) / per_file)
        one = numbered(features, "id").groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("id", "f"))).alias("a")).repartition("part")
    rows = one.select(*(c for c in one.columns if c == "part"), F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("a", lambda x: x["f"]).alias("features"))).alias("value"))
    (rows.write.partitionBy("part") if "part" in rows.columns else rows.write).text(path)


def write_nodes(nodes: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("node_id", "node_type", "degree").alias("properties"))
    _collection(nodes.select(F.col("node_id").alias("id"), feature.alias("f")), path, per_file)


def write_edges(edges: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    geometry = F.struct(F.lit("LineString").alias("type"), F.col("coordinates"))
    own = F.struct("edge_id", F.col("src").alias("start_node"), F.col("dst").alias("end_node"), "length_m", "pixel_count", "bridge", "bridge_method")
    _collection(edges.select(F.col("edge_id").alias("id"), F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), own.alias("properties")).alias("f")), path, per_file)


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """``directed, multigraph, graph, nodes, edges`` as one JSON document."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("id"), "x", "y"))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "length_m"))).alias("edges"))
    n.crossJoin(e).select(F.to_json(F.struct(F.lit(False).alias("directed"), F.lit(False).alias("multigraph"), F.create_map().alias("graph"), "nodes", "edges"))).write.text(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a GraphML file, ids cast to numbers where they are, ``length_m`` falling back to ``weight``."""
    keys = {r._id: r["_attr.name"] for r in spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string").load(path).collect()}
    data = "data array<struct<_key:string,_VALUE:string>>"
    value = lambda name: F.get(F.filter("data", lambda d: d["_key"].isin([k for k, v in keys.items() if v == name])), F.lit(0))["_VALUE"]
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path)
    nodes = nodes.select(F.col("_id").try_cast("long").alias("node_id"), *(value(c).try_cast("double").alias(c) for c in ("x", "y")))
    length = F.coalesce(value("length_m").try_cast("double"), value("weight").try_cast("double"))
    return nodes, edges.select(F.col("_source").try_cast("long").alias("src"), F.col("_target").try_cast("long").alias("dst"), length.alias("length_m"))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """``nodes(node_id, x, y)`` and ``edges(src, dst, length_m)`` as one undirected GraphML document, nodes first, each in order of ids."""
    keys = "".join(f'<key id="d{k}" for="{what}" attr.name="{name}" attr.type="double"/>' for k, (what, name) in enumerate((("node", "x"), ("node", "y"), ("edge", "length_m"))))
    frame = nodes.sparkSession.createDataFrame([(0, 0, 0, f'<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="undirected">'), (3, 0, 0, "</graph></graphml>")], "part int, a long, b long, value string")
    data = lambda k, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="d{k}">'), F.col(c).cast("string"), F.lit("</data>"))).otherwise("")
    node = F.concat(F.lit('<node id="'), F.col("node_id").cast("string"), F.lit('">'), data(0, "x"), data(1, "y"), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), F.col("src").cast("string"), F.lit('" target="'), F.col("dst").cast("string"), F.lit('">'), data(2, "length_m"), F.lit("</edge>"))
    lines = frame.unionAll(nodes.select(F.lit(1), F.col("node_id").cast("long"), F.lit(0).cast("long"), node)).unionAll(edges.select(F.lit(2), F.col("src").cast("long"), F.col("dst").cast("long"), edge))
    lines.orderBy("part", "a", "b").coalesce(1).select("value").write.text(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row table as a JSON document."""
    report.limit(1).coalesce(1).write.json(path)


def read_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The columns of a manifest by the names in its header, in any order; others are left out, a missing one is an error."""
    columns = [c.split() for c in MANIFEST.split(", ")]
    told = require_columns(spark.read.csv(path, header=True), [name for name, _ in columns])
    rows = told.select(*(F.col(name).try_cast(kind).alias(name) for name, kind in columns))
    return rows if split is None else rows.where(F.col("split") == split)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True)


def read_report(spark: SparkSession, path: str) -> DataFrame | None:
    """A JSON document; a missing one is warned of and gives None, so a summary goes on without it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        warnings.warn(f"no report at {path}", stacklevel=2)
        return None
    return spark.read.json(path, multiLine=True)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def inventory(files: DataFrame, root: str) -> DataFrame:
    """Files and bytes of each folder right below ``root``."""
    folder = F.split(F.substring_index("path", root.rstrip("/") + "/", -1), "/")[0]
    return files.groupBy(folder.alias("dataset")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).withColumn("size", readable_size(F.col("bytes")))


def missing_folders(files: DataFrame, required: list[str]) -> DataFrame:
    """Those of ``required`` that hold no file."""
    want = files.sparkSession.createDataFrame([(x,) for x in required], "folder string")
    found = F.col("path").contains(F.concat(F.lit("/"), F.col("folder"), F.lit("/")))
    return want.join(files.select("path"), found, "left_anti")

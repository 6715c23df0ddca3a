"""Weighted draws of tiles, and images with their masks."""

import bisect
import itertools

import pytest
from pyspark.sql import functions as F

from stradale.operators import raster
from stradale.sources import documents


def test_draws_are_those_of_summed_weights(spark):
    rows = [(k // 5, k % 5, (k * 7) % 3 if k != 11 else None) for k in range(40)]
    tiles = spark.createDataFrame(rows, "scene int, tile int, road_pixels int")
    got = {r.draw: r for r in raster.weighted_draw(tiles, ["scene", "tile"], 2000).collect()}
    assert sorted(got) == list(range(2000))
    order = sorted(rows, key=lambda t: (not (t[2] or 0) > 0, t))
    sums = list(itertools.accumulate(3.0 if (t[2] or 0) > 0 else 1.0 for t in order))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(42), F.col("id")), 11) / float(1 << 53)
    for r in spark.range(2000).select("id", u.alias("u")).collect():
        t = order[bisect.bisect_right(sums, r.u * sums[-1])]
        assert (got[r.id].scene, got[r.id].tile, got[r.id].road_pixels) == t
    share = sum((r.road_pixels or 0) > 0 for r in got.values()) / 2000
    assert abs(share - raster.weighted_share(tiles.fillna(0)).first().expected_share) < 0.04
    assert raster.weighted_draw(tiles, ["scene", "tile"]).count() == 40
    assert raster.weighted_draw(tiles.limit(0), ["scene", "tile"], 5).count() == 0
    for only in ("road_pixels > 0", "road_pixels = 0"):
        assert raster.weighted_draw(tiles.where(only), ["scene", "tile"], 50).where(only).count() == 50


def test_images_need_masks_of_their_size(spark):
    images = spark.createDataFrame([("train", "a", 1, "i/1", 3, 8, 4), ("train", "a", 2, "i/2", 3, 8, 4)], "split string, scene string, tile int, path string, channels int, height int, width int")
    shape = "split string, scene string, tile int, path string, height int, width int, road_pixels int"
    masks = [("train", "a", 1, "m/1", 8, 4, 8), ("train", "a", 2, "m/2", 8, 4, 0), ("val", "a", 1, "m/3", 8, 4, 1)]
    got = [tuple(r) for r in raster.paired_manifest(images, spark.createDataFrame(masks, shape)).orderBy("tile").collect()]
    assert got == [("train", "a", 1, "i/1", "m/1", 3, 8, 4, 8, 0.25, True), ("train", "a", 2, "i/2", "m/2", 3, 8, 4, 0, 0.0, False)]
    with pytest.raises(Exception, match="no mask for i/2"):
        raster.paired_manifest(images, spark.createDataFrame(masks[:1], shape)).count()
    with pytest.raises(Exception, match="another size for i/2"):
        raster.paired_manifest(images, spark.createDataFrame([masks[0], (*masks[1][:4], 4, 8, 0)], shape)).count()


def test_manifests_are_read_by_the_names_in_their_header(spark, tmp_path):
    images = spark.createDataFrame([("train", "a", "t1", "i/1", 3, 8, 4), ("val", "a", "t2", "i/2", 3, 8, 4)], "split string, scene string, tile string, path string, channels int, height int, width int")
    masks = images.select("split", "scene", "tile", F.concat(F.lit("m"), "path").alias("path"), "height", "width", F.lit(8).alias("road_pixels"))
    want = raster.paired_manifest(images, masks).withColumnRenamed("scene", "scene_id")
    documents.write_manifest(want.select("has_road", F.lit("x").alias("note"), *reversed(want.columns[:-1])), str(tmp_path / "m"))
    got = documents.read_manifest(spark, str(tmp_path / "m"))
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    assert [r.tile for r in documents.read_manifest(spark, str(tmp_path / "m"), "val").collect()] == ["t2"]
    documents.write_manifest(want.drop("width"), str(tmp_path / "short"))
    with pytest.raises(ValueError, match="width"):
        documents.read_manifest(spark, str(tmp_path / "short"))

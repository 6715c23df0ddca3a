"""Rasters as rows of pixels: windows, mosaics, dilation, neighbourhoods, band statistics, thinning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stradale.functions.scalars import ratio, scaled
from stradale.operators.ordinal import numbered
from stradale.plans.staging import materialize


def tile_windows(scenes: DataFrame, size: int = 256, stride: int = 192) -> DataFrame:
    """Complete windows of ``scenes(scene, height, width)``, numbered row by row: ``scene, tile, row0, col0``."""
    starts = lambda n: F.when(F.col(n) >= size, F.sequence(F.lit(0), F.col(n) - size, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    across = F.size(starts("width"))
    rows = scenes.select("scene", across.alias("n"), F.posexplode(starts("height")).alias("i", "row0"), starts("width").alias("cols"))
    return rows.select("scene", "n", "i", "row0", F.posexplode("cols").alias("j", "col0")).select("scene", (F.col("i") * F.col("n") + F.col("j")).cast("long").alias("tile"), "row0", "col0")


def cut_tiles(pixels: DataFrame, windows: DataFrame, size: int = 256, stride: int = 192) -> DataFrame:
    """The pixels of every window that covers them: a pixel is sent to its few windows by arithmetic, not by a range join. Tables of
    pixels are merged: the sizes that Spark takes rows from ``explode`` to have are far too small, and it would broadcast them."""
    reach = (size - 1) // stride
    first = lambda c: F.sequence(F.greatest(F.floor(F.col(c) / stride) - reach, F.lit(0)), F.floor(F.col(c) / stride))
    at = pixels.withColumn("row0", F.explode(first("r"))).withColumn("col0", F.explode(first("c")))
    at = at.withColumns({"row0": F.col("row0") * stride, "col0": F.col("col0") * stride}).where((F.col("r") < F.col("row0") + size) & (F.col("c") < F.col("col0") + size))
    return at.hint("merge").join(windows, ["scene", "row0", "col0"])


def stitch(tiles: DataFrame, grid: DataFrame) -> DataFrame:
    """Mean of overlapping tile values at each pixel of ``grid(scene, r, c)``; 0 where no tile reaches."""
    mean = tiles.groupBy("scene", "r", "c").agg(F.avg(F.col("p").cast("double")).alias("p"), F.count("*").alias("n"))
    return grid.join(mean.hint("merge"), ["scene", "r", "c"], "left").select("scene", "r", "c", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def mask_nodata(pixels: DataFrame, valid: DataFrame) -> DataFrame:
    """``p`` is 0 where no band has data."""
    seen = valid.select("scene", "r", "c", F.lit(True).alias("_v"))
    return pixels.join(seen.hint("merge"), ["scene", "r", "c"], "left").withColumn("p", F.when(F.col("_v"), F.col("p")).otherwise(0.0)).drop("_v")


def dilate(pixels: DataFrame, radius: int, disk: bool = False, bounds: DataFrame | None = None) -> DataFrame:
    """Set pixels within a square or a disk of set pixels, clipped to ``bounds(scene, height, width)``; repeated pixels count once.

    Rows of pixels become runs; a run widens to one interval in each row that it reaches, intervals that meet are merged, and
    only then become pixels: the pairs of rows and runs are shuffled, not a square of pixels for each.
    """
    row = W.partitionBy("scene", "r")
    runs = pixels.select("scene", "r", "c").withColumn("g", F.col("c") - F.dense_rank().over(row.orderBy("c"))).groupBy("scene", "r", "g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    reach = [(d, int((radius * radius - d * d) ** 0.5) if disk else radius) for d in range(-radius, radius + 1)]
    wide = runs.select("scene", "r", "lo", "hi", F.inline(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in reach))))
    wide = wide.select("scene", (F.col("r") + F.col("d")).alias("r"), (F.col("lo") - F.col("w")).alias("lo"), (F.col("hi") + F.col("w")).alias("hi"))
    before = F.max("hi").over(row.orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1))
    fresh = wide.withColumn("fresh", (F.coalesce(F.col("lo") > before + 1, F.lit(True))).cast("int"))
    part = fresh.withColumn("g", F.sum("fresh").over(row.orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, 0)))
    merged = part.groupBy("scene", "r", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    if bounds is not None:
        merged = merged.join(bounds.select("scene", "height", "width"), "scene").where("r >= 0 AND r < height AND hi >= 0 AND lo < width")
        merged = merged.withColumns({"lo": F.greatest("lo", F.lit(0)), "hi": F.least("hi", F.col("width") - 1)})
    return merged.select("scene", "r", F.explode(F.sequence("lo", "hi")).alias("c"))


def combined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Set pixels of two masks ``scene, r, c``: in both (``and``), in any (``or``), or in the first but not the second (``and not``)."""
    on = ["scene", "r", "c"]
    one, two = a.select(*on).distinct(), b.select(*on)
    return one.unionByName(two).distinct() if how == "or" else one.join(two, on, {"and": "left_semi", "and not": "left_anti"}[how])


def neighbours(pixels: DataFrame) -> DataFrame:
    """Pairs of set pixels that touch: ``scene, r, c, r2, c2``."""
    spread = F.sequence(F.lit(-1), F.lit(1))
    around = pixels.select("scene", F.col("r").alias("r2"), F.col("c").alias("c2"), F.explode(spread).alias("dr")).select("*", F.explode(spread).alias("dc")).where("dr <> 0 OR dc <> 0")
    return around.select("scene", (F.col("r2") + F.col("dr")).alias("r"), (F.col("c2") + F.col("dc")).alias("c"), "r2", "c2").join(pixels.select("scene", "r", "c"), ["scene", "r", "c"])


def pixel_degrees(pixels: DataFrame) -> DataFrame:
    """``scene, r, c, degree``: set pixels among the eight around."""
    n = neighbours(pixels).groupBy("scene", "r", "c").agg(F.count("*").alias("degree"))
    return pixels.select("scene", "r", "c").join(n, ["scene", "r", "c"], "left").select("scene", "r", "c", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def band_stats(pixels: DataFrame, bands: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Count, mean, population deviation, minimum and maximum of each band, in one pass."""
    long = pixels.select(F.inline(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in bands))))
    return long.groupBy("band").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def normalize(pixels: DataFrame, stats: DataFrame, bands: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Z-scores ``<band>_z`` and values clipped to 0..1 of the maximum, ``<band>_u``. The statistics are a row per band."""
    wide = stats.agg(*(F.max(F.when(F.col("band") == b, F.struct("mean", "std", "max"))).alias(f"_{b}") for b in bands))
    out = pixels.crossJoin(F.broadcast(wide))
    for b in bands:
        out = out.withColumns({f"{b}_z": F.round((F.col(b) - F.col(f"_{b}.mean")) / F.col(f"_{b}.std"), 6), f"{b}_u": F.round(scaled(F.col(b), F.col(f"_{b}.max")), 6)})
    return out.drop(*(f"_{b}" for b in bands))


def minmax_by_tile(pixels: DataFrame, band: str) -> DataFrame:
    ends = pixels.groupBy("tile").agg(F.min(band).alias("_lo"), F.max(band).alias("_hi"))
    return pixels.join(ends, "tile").withColumn(f"{band}_m", F.round((F.col(band) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8), 6)).drop("_lo", "_hi")


def split_scenes(manifest: DataFrame) -> DataFrame:
    """``scene, split``: the first 70 % train, up to 90 % validation, the rest test, by half-even rounding over all scenes."""
    scenes = manifest.select("scene").distinct()
    ranked = numbered(scenes, "scene", name="i").withColumn("i", F.col("i") - 1).crossJoin(F.broadcast(scenes.agg(F.count("*").alias("n"))))
    cut = lambda share: F.bround(F.col("n") * share)
    return ranked.select("scene", F.when(F.col("i") < cut(0.7), "train").when(F.col("i") < cut(0.9), "val").otherwise("test").alias("split"))


def tile_manifest(tiles: DataFrame) -> DataFrame:
    """``scene, tile, road_pixels, pixels, road_fraction, has_road`` of the pixels ``tiles(scene, tile, truth)``."""
    road = F.sum(F.col("truth").cast("long"))
    rows = tiles.groupBy("scene", "tile").agg(road.alias("road_pixels"), F.count("*").alias("pixels"))
    return rows.withColumns({"road_fraction": F.round(ratio(F.col("road_pixels"), F.col("pixels")), 9), "has_road": F.col("road_pixels") > 0})


def split_summary(tiles: DataFrame) -> DataFrame:
    road = F.col("road_pixels") > 0
    return tiles.groupBy("split").agg(F.count("*").alias("tiles"), F.count_if(road).alias("with_road"), F.count_if(~road).alias("empty"), F.round(F.avg(F.col("road_pixels") / F.col("pixels")), 9).alias("mean_road_fraction"))


def class_balance(tiles: DataFrame) -> DataFrame:
    one = tiles.agg(F.sum("road_pixels").cast("long").alias("road"), F.sum(F.col("pixels") - F.col("road_pixels")).cast("long").alias("background"))
    return one.select("road", "background", F.round(ratio(F.col("road"), F.col("road") + F.col("background")), 9).alias("road_fraction"), F.round(ratio(F.col("background"), F.col("road")), 6).alias("pos_weight"))


def positive_tiles(pixels: DataFrame) -> DataFrame:
    """Of the pixels ``scene, tile, truth, p`` those of tiles that hold a road."""
    road = pixels.groupBy("scene", "tile").agg(F.max("truth").alias("_t")).where("_t > 0").select("scene", "tile")
    return pixels.join(road, ["scene", "tile"], "left_semi")


def weighted_share(tiles: DataFrame, weight: float = 3.0) -> DataFrame:
    """Expected share of tiles with roads when they are drawn with this weight against 1."""
    w = F.when(F.col("road_pixels") > 0, weight).otherwise(1.0)
    return tiles.agg(F.round(F.sum(F.when(F.col("road_pixels") > 0, w).otherwise(0.0)) / F.sum(w), 9).alias("expected_share"))


def weighted_draw(tiles: DataFrame, order: list[str], most: int | None = None, weight: float = 3.0, seed: int = 42) -> DataFrame:
    """``most`` draws with replacement (as many as there are tiles by default), ``weight`` to 1 for tiles with roads: ``draw`` and the tile.

    Tiles with roads are numbered before those without, by ``order``, which should leave no ties; a draw falls on a number by the
    inverse of the summed weights, so only draws and numbers are joined. Null road pixels count as none; no tiles give no draws.
    """
    road = F.coalesce(F.col("road_pixels") > 0, F.lit(False))
    placed = materialize(numbered(tiles, road.desc(), *order, name="_k"), "placed")
    n, positive = placed.agg(F.count("*"), F.count_if(road)).first()
    at = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "draw"), 11) / float(1 << 53) * (weight * positive + n - positive)
    draws = tiles.sparkSession.range((n if most is None else most) if n else 0).withColumnRenamed("id", "draw")
    place = F.when(at < weight * positive, F.floor(at / weight)).otherwise(positive + F.floor(at - weight * positive))
    return draws.withColumn("_k", F.least(place, F.lit(n - 1)) + 1).join(placed, "_k").drop("_k")


def paired_manifest(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Tiles of images with their masks: paths, bands and size of the image, road pixels of the mask, and their share.

    ``images`` has ``split, scene, tile, path, channels, height, width``; ``masks`` the same but for channels, and ``road_pixels``.
    An image without a mask, or with one of another size, is an error; masks without an image are left out.
    """
    key = ["split", "scene", "tile"]
    own = masks.select(*key, F.col("path").alias("mask_path"), F.col("height").alias("_h"), F.col("width").alias("_w"), F.col("road_pixels").cast("long").alias("road_pixels"))
    rows = images.select(*key, F.col("path").alias("image_path"), "channels", "height", "width").join(own, key, "left")
    fail = lambda what: F.raise_error(F.concat(F.lit(what), F.col("image_path"))).cast("boolean")
    same = (F.col("_h") == F.col("height")) & (F.col("_w") == F.col("width"))
    rows = rows.where(F.when(F.col("mask_path").isNull(), fail("no mask for ")).when(~F.coalesce(same, F.lit(False)), fail("mask of another size for ")).otherwise(True))
    share = ratio(F.col("road_pixels"), F.col("height").cast("long") * F.col("width"))
    return rows.select(*key, "image_path", "mask_path", "channels", "height", "width", "road_pixels", F.round(share, 9).alias("road_fraction"), (F.col("road_pixels") > 0).alias("has_road"))


def _thin(mask: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning."""
    img = np.pad(mask.astype(np.uint8), 1)
    while True:
        changed = False
        for turn in (0, 1):
            p = [img[:-2, 1:-1], img[:-2, 2:], img[1:-1, 2:], img[2:, 2:], img[2:, 1:-1], img[2:, :-2], img[1:-1, :-2], img[:-2, :-2]]
            near = sum(x.astype(int) for x in p)
            rises = sum(((p[k] == 0) & (p[(k + 1) % 8] == 1)).astype(int) for k in range(8))
            n, e, s, w = p[0], p[2], p[4], p[6]
            a, b = ((n & e & s), (e & s & w)) if turn == 0 else ((n & e & w), (n & s & w))
            drop = (img[1:-1, 1:-1] == 1) & (near >= 2) & (near <= 6) & (rises == 1) & (a == 0) & (b == 0)
            if drop.any():
                img[1:-1, 1:-1][drop] = 0
                changed = True
        if not changed:
            return img[1:-1, 1:-1].astype(bool)


def skeletonize(pixels: DataFrame) -> DataFrame:
    """Thinned masks, a scene per task: a scene is one image, whose size is bounded by its acquisition."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = frame.r.min(), frame.c.min()
        mask = np.zeros((frame.r.max() - r0 + 1, frame.c.max() - c0 + 1), bool)
        mask[frame.r - r0, frame.c - c0] = True
        r, c = np.nonzero(_thin(mask))
        return pd.DataFrame({"scene": frame.scene.iloc[0], "r": r + r0, "c": c + c0})

    kind = pixels.schema["scene"].dataType.simpleString()
    return pixels.select("scene", F.col("r").cast("long"), F.col("c").cast("long")).groupBy("scene").applyInPandas(run, f"scene {kind}, r long, c long")


def rasterize(segments: DataFrame) -> DataFrame:
    """Pixels that straight segments ``scene, r0, c0, r1, c1`` (pixel units) touch, by stepping from cell border to cell border."""

    def run(frames):
        for f in frames:
            out = []
            for s in f.itertuples():
                cuts = {0.0, 1.0}
                for a, b in ((s.r0, s.r1), (s.c0, s.c1)):
                    if a != b:
                        cuts.update((k - a) / (b - a) for k in range(int(np.floor(min(a, b))) + 1, int(np.ceil(max(a, b)))))
                t = np.array(sorted(cuts))
                mid = (t[:-1] + t[1:]) / 2
                out += [(s.scene, int(np.floor(s.r0 + m * (s.r1 - s.r0))), int(np.floor(s.c0 + m * (s.c1 - s.c0)))) for m in mid]
            yield pd.DataFrame(out, columns=["scene", "r", "c"]).astype({"r": "int64", "c": "int64"})

    return segments.mapInPandas(run, f"scene {segments.schema['scene'].dataType.simpleString()}, r long, c long").distinct()

"""Scores of masks against truth: confusion counts, overlaps, sweeps, relaxed and occluded variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stradale.functions.scalars import epsilon_ratio, ratio


def confusion(pred: Column, truth: Column) -> list[Column]:
    return [F.count_if(pred & truth).alias("tp"), F.count_if(pred & ~truth).alias("fp"), F.count_if(~pred & truth).alias("fn"), F.count_if(~pred & ~truth).alias("tn")]


def with_scores(counts: DataFrame, form: str = "zero") -> DataFrame:
    """IoU, Dice, precision, recall from counts. ``form``: ``zero`` gives 0 for empty denominators, ``epsilon`` adds 1e-8, ``mask`` gives overlaps of 1 when both masks are empty."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    parts = {"iou": (tp, tp + fp + fn), "dice": (2 * tp, 2 * tp + fp + fn), "precision": (tp, tp + fp), "recall": (tp, tp + fn)}
    for name, (n, d) in parts.items():
        value = epsilon_ratio(n, d) if form == "epsilon" else ratio(n, d, 1.0 if form == "mask" and name in ("iou", "dice") else 0.0)
        counts = counts.withColumn(name, F.round(value, 9))
    return counts


def threshold_sweep(pixels: DataFrame, thresholds: list[float]) -> DataFrame:
    """Scores and predicted share at each threshold in one pass: each pixel is compared with a short literal list."""
    truth = F.col("truth") == 1
    rows = pixels.select("truth", "p", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    pred = F.col("p") >= F.col("threshold")
    counts = rows.groupBy("threshold").agg(*confusion(pred, truth), F.round(F.avg(pred.cast("double")), 9).alias("predicted_share"))
    return with_scores(counts)


def probability_stats(pixels: DataFrame) -> DataFrame:
    return pixels.agg(F.round(F.min("p"), 9).alias("min_p"), F.round(F.max("p"), 9).alias("max_p"), F.round(F.avg("p"), 9).alias("mean_p"), F.round(F.stddev_samp("p"), 9).alias("std_p"))


def prediction_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    d = F.abs(F.col("a.p") - F.col("b.p"))
    return a.alias("a").join(b.alias("b"), keys).agg(F.round(F.max(d), 9).alias("max_abs"), F.round(F.avg(d), 9).alias("mean_abs"))


def occlusion_recall(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    hidden = (F.col("truth") == 1) & F.col("occ")
    one = pixels.agg(F.count_if(hidden).alias("occluded_truth"), F.count_if(hidden & (F.col("p") >= threshold)).alias("occluded_hit"))
    return one.withColumn("occlusion_recall", F.round(ratio(F.col("occluded_hit"), F.col("occluded_truth")), 9))


def relaxed(pred: DataFrame, truth: DataFrame, radius: int, bounds: DataFrame) -> DataFrame:
    """Overlap of both masks widened by a disk; share of truth near the prediction, and of the prediction near truth."""
    from stradale.operators.raster import dilate

    on = ["scene", "r", "c"]
    mark = lambda df, name: df.select(*on, F.lit(1).alias(name))
    wide_p, wide_t = dilate(pred, radius, True, bounds), dilate(truth, radius, True, bounds)
    every = mark(wide_p, "wp").join(mark(wide_t, "wt"), on, "full").join(mark(pred, "p"), on, "left").join(mark(truth, "t"), on, "left")
    has = lambda *names: F.count_if(sum((F.coalesce(F.col(n), F.lit(0)) for n in names), F.lit(0)) == len(names))
    one = every.agg(has("wp", "wt").alias("both"), F.count("*").alias("any"), has("t").alias("truth"), has("p").alias("pred"), has("t", "wp").alias("near_truth"), has("p", "wt").alias("near_pred"))
    return one.select(F.lit(radius).cast("long").alias("radius"), "both", "any", F.round(ratio(F.col("both"), F.col("any"), 1.0), 9).alias("relaxed_iou"), F.round(ratio(F.col("near_truth"), F.col("truth")), 9).alias("completeness"), F.round(ratio(F.col("near_pred"), F.col("pred")), 9).alias("relaxed_precision"))

"""Pixels and coordinates: affine transforms, bounds, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pixel_centre(r: Column, c: Column, transform: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """``x, y`` of the centre of a pixel; ``transform`` is ``(a, b, c, d, e, f)`` with ``x = a * col + b * row + c``."""
    ax, bx, cx, ay, by, cy = transform
    across, down = c + 0.5, r + 0.5
    return ax * across + bx * down + cx, ay * across + by * down + cy


def raster_bounds(scenes: DataFrame, transform: tuple[float, float, float, float, float, float]) -> DataFrame:
    """``scene, left, bottom, right, top`` of ``scenes(scene, height, width)`` that are not rotated."""
    ax, _, cx, _, by, cy = transform
    x, y = (F.lit(cx), cx + ax * F.col("width")), (F.lit(cy), cy + by * F.col("height"))
    return scenes.select("scene", F.least(*x).alias("left"), F.least(*y).alias("bottom"), F.greatest(*x).alias("right"), F.greatest(*y).alias("top"))


def without_repeats(line: Column) -> Column:
    """An array without the elements that equal the one before them."""
    return F.filter(line, lambda p, k: (k == 0) | ~p.eqNullSafe(F.get(line, F.greatest(k - 1, F.lit(0)))))


def first_coordinate(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first known of several columns, as a number; those the table lacks are passed over. None at all is an error."""
    here = [F.col(f"`{n}`").try_cast("double") for n in names if n in df.columns]
    if not here:
        raise ValueError(f"none of the columns {', '.join(names)}")
    return F.coalesce(*here)


def mismatched(one: DataFrame, two: DataFrame) -> DataFrame:
    """Scenes whose ``height`` or ``width`` differ in two tables, or that one of them lacks."""
    shape = lambda df, k: df.select("scene", F.struct("height", "width").alias(k))
    return shape(one, "a").join(shape(two, "b"), "scene", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("scene")

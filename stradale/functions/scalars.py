"""Small expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column, empty: float | None = 0.0) -> Column:
    """``n / d``; ``empty`` where ``d`` is not positive (null for None)."""
    return F.when(d > 0, n.cast("double") / d).otherwise(F.lit(empty).cast("double"))


def epsilon_ratio(n: Column, d: Column) -> Column:
    return n.cast("double") / (d.cast("double") + F.lit(1e-8))


def percent_change(old: Column, new: Column, empty: float | None = 0.0) -> Column:
    return F.when(old > 0, (new - old) / old * 100).otherwise(F.lit(empty).cast("double"))


def travel_seconds(metres: Column, kmh: float = 30.0) -> Column:
    return metres / (kmh * 1000.0 / 3600.0)


def node_type(degree: Column) -> Column:
    """An end has at most one neighbour, an intersection three or more, a junction two."""
    return F.when(degree <= 1, "endpoint").when(degree >= 3, "intersection").otherwise("junction")


def floor_percentile(values: Column, share: float) -> Column:
    """The element of the sorted array at ``int(share * (n - 1))``, without interpolation; null for an empty array."""
    return F.try_element_at(F.array_sort(values), (F.floor(share * (F.size(values) - 1)) + 1).cast("int"))


def path_uses_edge(path: Column, u: Column, v: Column) -> Column:
    """Whether ``u`` and ``v`` follow each other on the path, in either order."""
    pairs = F.arrays_zip(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))).alias("a"), F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))).alias("b"))
    return F.coalesce(F.exists(pairs, lambda p: ((p["a"] == u) & (p["b"] == v)) | ((p["a"] == v) & (p["b"] == u))), F.lit(False))


def readable_size(n: Column) -> Column:
    """Bytes in steps of 1024 with two decimals."""
    out = F.format_string("%.2f B", n.cast("double"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.2f {unit}", n / float(1024**k))).otherwise(out)
    return out


def thousands(n: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(n, 0)


def percent(share: Column, decimals: int = 6) -> Column:
    """A share as a percentage with so many decimals."""
    return F.format_string(f"%.{decimals}f%%", share * 100)


def scene_of(name: Column, prefix: str = "RGB-PanSharpen_") -> Column:
    """The scene id in an image name: what follows the prefix."""
    return F.replace(name, F.lit(prefix), F.lit(""))


def tile_name(scene: Column, number: Column) -> Column:
    return F.format_string("%s_tile_%03d.tif", scene, number)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x.cast("double")))


def whole_id(value: Column) -> Column:
    """An id as text: that of the whole number where it is one, else as it was."""
    return F.coalesce(value.try_cast("long").cast("string"), value.cast("string"))


def binarized(value: Column) -> Column:
    return (value > 0).cast("int")


def scaled(value: Column, largest: Column) -> Column:
    """Shares of the largest value, clipped to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / largest))


def unscaled(share: Column, largest: Column) -> Column:
    """The inverse of :func:`scaled`; shares are clipped first."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * largest


def any_data(*bands: Column) -> Column:
    """Whether any band is there and not 0."""
    return F.greatest(*(F.coalesce((b != 0).cast("int"), F.lit(0)) for b in bands)) == 1

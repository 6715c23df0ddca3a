"""Synthetic occlusion of square tiles: shapes are drawn by hash as a small table, then painted tile by tile.

Tiles have pixels ``tile, r, c, red, green, blue`` with bands from 0 to 1; where there is a column ``scene``, it is part of a
tile's name. Draws depend on the seed, the tile and the number of the draw only, never on pixels or partitions, so the mask can
be made again without pixels. A task paints a tile at a time: it holds ``size * size`` pixels at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed values. Effect: least and most shapes, opacity, colour or bounds of a drawn one, pixels of the blur's kernel (0: hard edges).
EFFECTS = {
    "tree_canopy": (3, 8, 0.75, (0.18, 0.24, 0.12), 21),
    "vehicles": (2, 10, 0.85, (0.05, 0.35), 0),
    "shadows": (1, 1, 0.55, (0.0, 0.0, 0.0), 31),
    "clouds": (1, 3, 0.55, (1.0, 1.0, 1.0), 51),
    "urban_clutter": (5, 15, 0.65, (0.1, 0.9), 0),
    "illumination": (1, 1, 0.35, (), 0),
}
#: Least and most side of a rectangle, in pixels.
SIDES = {"vehicles": (4, 18), "urban_clutter": (3, 15)}
#: Numbers drawn for a shape.
DRAWS = 8
BANDS = ("red", "green", "blue")


def _key(rows: DataFrame) -> list[str]:
    return [c for c in ("scene", "tile") if c in rows.columns]


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53)


def gated(tiles: DataFrame, probability: float, seed: int = 42, enabled: bool = True) -> DataFrame:
    """Tiles to occlude: with roads, and drawn with this probability; none unless ``enabled``."""
    return tiles.where(F.lit(enabled) & F.col("has_road") & (uniform(seed, *map(F.col, _key(tiles)), F.lit("gate")) <= probability))


def chosen_effects(tiles: DataFrame, seed: int = 42, least: int = 1, most: int = 3) -> DataFrame:
    """``least`` to ``most`` effects of each tile, in hash order, without repeats: the tile, ``effect``, ``turn``."""
    key = _key(tiles)
    rows = tiles.select(*key).distinct().select(*key, F.explode(F.array(*map(F.lit, EFFECTS))).alias("effect"))
    rows = rows.withColumn("turn", F.row_number().over(W.partitionBy(*key).orderBy(F.xxhash64(F.lit(seed), *key, "effect"), "effect")))
    return rows.where(F.col("turn") <= F.floor(uniform(seed, *map(F.col, key), F.lit("count")) * (most - least + 1)) + least)


def shapes(effects: DataFrame, seed: int = 42) -> DataFrame:
    """The drawn shapes, few per tile, whatever its pixels: the tile, ``effect, turn, shape`` and ``draws``, numbers in [0, 1)."""
    bound = lambda k: F.create_map(*(x for name, e in EFFECTS.items() for x in (F.lit(name), F.lit(e[k]))))[F.col("effect")]
    key = _key(effects)
    named = [*map(F.col, key), F.col("effect")]
    n = F.floor(bound(0) + uniform(seed, *named, F.lit("n")) * (bound(1) - bound(0) + 1)).cast("int")
    rows = effects.select(*key, "effect", F.col("turn").cast("int").alias("turn"), F.explode(F.sequence(F.lit(1), n)).alias("shape"))
    return rows.withColumn("draws", F.array(*(uniform(seed, *named, F.col("shape"), F.lit(f"draw {k}")) for k in range(DRAWS))))


def _between(u: float, low: int, high: int) -> int:
    return low + int(u * (max(low, high) - low + 1))


def _ellipse(size: int, u: list[float], rows: tuple[int, int], cols: tuple[int, int]) -> np.ndarray:
    y, x = np.ogrid[:size, :size]
    dx, dy, turn = x - int(u[0] * size), y - int(u[1] * size), np.pi * u[4]
    along, across = dx * np.cos(turn) + dy * np.sin(turn), dy * np.cos(turn) - dx * np.sin(turn)
    return (along / _between(u[2], *cols)) ** 2 + (across / _between(u[3], *rows)) ** 2 <= 1


def _box(size: int, u: list[float], low: int, high: int) -> np.ndarray:
    wide, tall = (_between(x, min(low, size), min(high, size)) for x in u[:2])
    left, top = int(u[2] * (size - wide + 1)), int(u[3] * (size - tall + 1))
    mask = np.zeros((size, size), bool)
    mask[top : top + tall, left : left + wide] = True
    return mask


def _polygon(size: int, u: list[float]) -> np.ndarray:
    """The polygon of four corners, by the even-odd rule, with the pixels of its outline."""
    y, x = np.mgrid[:size, :size]
    corners = [(int(a * size), int(b * size)) for a, b in zip(u[0::2], u[1::2])]
    mask, outline = np.zeros((size, size), bool), np.zeros((size, size), bool)
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]):
        if y0 != y1:
            mask ^= ((y < y0) != (y < y1)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
        at = np.linspace(0, 1, max(abs(x1 - x0), abs(y1 - y0)) + 1)
        outline[np.rint(y0 + at * (y1 - y0)).astype(int), np.rint(x0 + at * (x1 - x0)).astype(int)] = True
    return mask | outline


def geometry(effect: str, size: int, u: list[float]) -> np.ndarray:
    """The pixels that a shape hides. Ellipses grow with the tile; illumination hides none."""
    if effect in SIDES:
        return _box(size, u, *SIDES[effect])
    if effect == "shadows":
        return _polygon(size, u)
    if effect == "tree_canopy":
        radii = max(8, size // 20), max(12, size // 6)
        return _ellipse(size, u, radii, radii)
    if effect == "clouds":
        return _ellipse(size, u, (max(1, size // 10), max(1, size // 4)), (max(1, size // 8), max(1, size // 3)))
    return np.zeros((size, size), bool)


def blurred(mask: np.ndarray, kernel: int) -> np.ndarray:
    """Shares of 255 steps after a Gaussian blur with a kernel of so many pixels; the tile is mirrored at its border pixels."""
    far = kernel // 2
    weights = np.exp(-0.5 * (np.arange(-far, far + 1) / (0.3 * (far - 1) + 0.8)) ** 2)
    weights /= weights.sum()
    out = np.pad(mask.astype(float), far, "reflect")
    for axis in (0, 1):
        out = np.lib.stride_tricks.sliding_window_view(out, kernel, axis) @ weights
    return np.rint(out * 255) / 255


def hidden(drawn: list[dict], size: int) -> np.ndarray:
    """The pixels of a tile that its shapes hide."""
    return np.any([np.zeros((size, size), bool), *(geometry(s["effect"], size, s["draws"]) for s in drawn)], axis=0)


def paint(values: np.ndarray, r: np.ndarray, c: np.ndarray, size: int, drawn: list[dict]) -> np.ndarray:
    """The values (pixels by bands) at rows ``r`` and columns ``c`` under the shapes of their tile.

    Effects follow each other by turn, and values are clipped after each. Boxes blend one by one; other shapes of an effect merge,
    are blurred and blend once. Illumination changes contrast, then brightness. Missing values stay missing.
    """
    drawn = sorted(drawn, key=lambda s: (s["turn"], s["shape"]))
    for effect in dict.fromkeys(s["effect"] for s in drawn):
        mine = [s for s in drawn if s["effect"] == effect]
        _, _, strength, colour, kernel = EFFECTS[effect]
        if effect == "illumination":
            brightness, contrast = (1 + strength * (2 * x - 1) for x in mine[0]["draws"][:2])
            values = ((values - 0.5) * contrast + 0.5) * brightness
        elif kernel:
            alpha = strength * blurred(hidden(mine, size), kernel)[r, c, None]
            values = values * (1 - alpha) + alpha * np.array(colour)
        else:
            for s in mine:
                tint = colour[0] + np.array(s["draws"][4:7]) * (colour[1] - colour[0])
                values = np.where(hidden([s], size)[r, c, None], values * (1 - strength) + strength * tint, values)
        values = np.clip(values, 0, 1)
    return values


def occlude(pixels: DataFrame, effects: DataFrame, size: int = 256, seed: int = 42) -> DataFrame:
    """The pixels with the effects of their tile, and ``occluded``: whether a shape hides them.

    All columns are kept but for an ``occluded`` of their own; tiles without effects are unchanged, missing values stay missing,
    repeated pixels are each painted, and pixels beyond ``size`` or without a row or column are refused.
    """
    key = _key(pixels)
    rows = pixels.drop("occluded").withColumns({b: F.col(b).cast("double") for b in BANDS})
    names = rows.columns

    def run(tile: pa.Table, mine: pa.Table) -> pa.Table:
        r, c = (tile[x].to_numpy().astype(np.int64) for x in ("r", "c"))
        if not ((0 <= r) & (r < size) & (0 <= c) & (c < size)).all():
            raise ValueError(f"a pixel lies outside a tile of {size} by {size} pixels")
        drawn = mine.to_pylist()
        values = paint(np.stack([tile[b].to_numpy() for b in BANDS], axis=1), r, c, size, drawn)
        made = {b: pa.array(values[:, k], pa.float64(), from_pandas=True) for k, b in enumerate(BANDS)}
        return pa.table([*(made[x] if x in made else tile[x] for x in names), pa.array(hidden(drawn, size)[r, c])], [*names, "occluded"])

    schema = rows.withColumn("occluded", F.lit(True)).schema
    return rows.groupBy(*key).cogroup(shapes(effects, seed).groupBy(*key)).applyInArrow(run, schema)


def occlusion_mask(effects: DataFrame, size: int = 256, seed: int = 42) -> DataFrame:
    """The pixels that :func:`occlude` hides with the same seed, made without pixels: the tile, ``r``, ``c``."""
    key = _key(effects)
    drawn = shapes(effects, seed)

    def run(mine: pa.Table) -> pa.Table:
        r, c = np.nonzero(hidden(mine.to_pylist(), size))
        whose = mine.select(key).take(np.zeros(len(r), np.int64))
        return pa.table([*whose.columns, pa.array(r, pa.int32()), pa.array(c, pa.int32())], [*key, "r", "c"])

    schema = drawn.select(*key, F.lit(0).alias("r"), F.lit(0).alias("c")).schema
    return drawn.groupBy(*key).applyInArrow(run, schema)


def single_effect(pixels: DataFrame, effect: str, size: int = 256, seed: int = 42) -> DataFrame:
    """The pixels with one effect on every tile."""
    alone = pixels.select(*_key(pixels)).distinct().withColumns({"effect": F.lit(effect), "turn": F.lit(1)})
    return occlude(pixels, alone, size, seed).drop("occluded")


def difference_mask(clean: DataFrame, changed: DataFrame, least: float = 0.015) -> DataFrame:
    """Pixels of which a band differs by more than ``least``."""
    on = [*_key(clean), "r", "c"]
    d = F.greatest(*(F.abs(F.col(f"a.{b}") - F.col(f"b.{b}")) for b in BANDS))
    return clean.alias("a").join(changed.alias("b"), on).where(d > least).select(*on)

"""Painted tiles against plain loops over their pixels."""

import math

import numpy as np
from pyspark.sql import functions as F

from stradale.operators import occlusion as oc

SIZE = 40


def tiles(spark, n):
    rows = spark.range(n * SIZE * SIZE).selectExpr("'a' AS scene", f"id DIV {SIZE * SIZE} AS tile", f"(id DIV {SIZE}) % {SIZE} AS r", f"id % {SIZE} AS c")
    return rows.withColumns({b: oc.uniform(k, F.col("tile"), F.col("r"), F.col("c")) for k, b in enumerate(oc.BANDS)})


def pick(u, low, high):
    return low + math.floor(u * (high - low + 1))


def plain_hidden(shape, r, c):
    """Whether a shape other than a polygon hides a pixel."""
    u, kind = shape.draws, shape.effect
    if kind in ("vehicles", "urban_clutter"):
        low, high = {"vehicles": (4, 18), "urban_clutter": (3, 15)}[kind]
        wide, tall = pick(u[0], low, high), pick(u[1], low, high)
        left, top = math.floor(u[2] * (SIZE - wide + 1)), math.floor(u[3] * (SIZE - tall + 1))
        return left <= c < left + wide and top <= r < top + tall
    if kind in ("tree_canopy", "clouds"):
        rx, ry = (pick(u[2], 8, 12), pick(u[3], 8, 12)) if kind == "tree_canopy" else (pick(u[2], 5, 13), pick(u[3], 4, 10))
        dx, dy, t = c - math.floor(u[0] * SIZE), r - math.floor(u[1] * SIZE), math.pi * u[4]
        return ((dx * math.cos(t) + dy * math.sin(t)) / rx) ** 2 + ((dy * math.cos(t) - dx * math.sin(t)) / ry) ** 2 <= 1
    return False


def mirrored(i):
    while not 0 <= i < SIZE:
        i = -i if i < 0 else 2 * (SIZE - 1) - i
    return i


def plain_blur(mask, kernel, r, c):
    far = kernel // 2
    w = [math.exp(-(d * d) / (2 * (0.3 * (far - 1) + 0.8) ** 2)) for d in range(-far, far + 1)]
    total = sum(w[i] * w[j] * mask[mirrored(r + i - far)][mirrored(c + j - far)] for i in range(kernel) for j in range(kernel))
    return round(255 * total / sum(w) ** 2) / 255


def test_every_effect_against_loops(spark):
    rows = tiles(spark, 1).cache()
    before = {(p.r, p.c): (p.red, p.green, p.blue) for p in rows.collect()}
    for effect, (_, _, strength, colour, kernel) in oc.EFFECTS.items():
        alone = rows.select("scene", "tile").distinct().withColumns({"effect": F.lit(effect), "turn": F.lit(1)})
        drawn = oc.shapes(alone).orderBy("shape").collect()
        got = {(p.r, p.c): p for p in oc.occlude(rows, alone, SIZE).collect()}
        assert len(got) == SIZE * SIZE
        mask = [[got[r, c].occluded for c in range(SIZE)] for r in range(SIZE)]
        if effect != "shadows":
            assert mask == [[any(plain_hidden(s, r, c) for s in drawn) for c in range(SIZE)] for r in range(SIZE)]
        assert any(map(any, mask)) == (effect != "illumination")
        for r, c in [(0, 0), (3, 17), (20, 20), (39, 5), (12, 33)] + [k for k, p in got.items() if p.occluded][::97]:
            want = np.array(before[r, c])
            if effect == "illumination":
                want = ((want - 0.5) * (0.65 + 0.7 * drawn[0].draws[1]) + 0.5) * (0.65 + 0.7 * drawn[0].draws[0])
            elif kernel:
                a = strength * plain_blur(mask, kernel, r, c)
                want = want * (1 - a) + a * np.array(colour)
            else:
                for s in drawn:
                    if plain_hidden(s, r, c):
                        want = want * (1 - strength) + strength * (colour[0] + np.array(s.draws[4:7]) * (colour[1] - colour[0]))
            p = got[r, c]
            # a share that lies between two of the 255 steps may round either way
            assert np.allclose((p.red, p.green, p.blue), np.clip(want, 0, 1), atol=1 / 255 if kernel else 1e-12), (effect, r, c)


def test_polygons():
    u = [10 / SIZE + 1e-9, 5 / SIZE + 1e-9, 30 / SIZE + 1e-9, 5 / SIZE + 1e-9, 30 / SIZE + 1e-9, 25 / SIZE + 1e-9, 10 / SIZE + 1e-9, 25 / SIZE + 1e-9]
    box = oc.geometry("shadows", SIZE, u)
    assert {(r, c) for r, c in zip(*np.nonzero(box))} == {(r, c) for r in range(5, 26) for c in range(10, 31)}
    crossed = oc.geometry("shadows", SIZE, u[:4] + u[6:] + u[4:6])  # two triangles that meet in the middle
    assert crossed[7, 20] and crossed[23, 20] and not crossed[15, 12] and not crossed[15, 28]
    assert oc.geometry("shadows", SIZE, [0.5] * 8).sum() == 1


def test_shapes_grow_with_the_tile():
    for size, canopy, high, wide in ((256, (12, 42), (25, 64), (32, 85)), (64, (8, 12), (6, 16), (8, 21))):
        for k, u in enumerate((0.0, 1 - 1e-9)):
            middle = [0.5, 0.5, u, u, 0.0, 0, 0, 0]
            for effect, rows, cols in (("tree_canopy", canopy, canopy), ("clouds", high, wide)):
                mask = oc.geometry(effect, size, middle)
                assert mask.any(1).sum() == min(size, 2 * rows[k] + 1) and mask.any(0).sum() == min(size, 2 * cols[k] + 1), (effect, size)


def test_whole_tiles(spark):
    rows = tiles(spark, 6).withColumn("note", F.col("r") + 1).cache()
    effects = oc.chosen_effects(rows)
    turns = {}
    for e in effects.collect():
        turns.setdefault(e.tile, []).append(e.turn)
    assert set(turns) == set(range(6)) and all(sorted(t) == list(range(1, len(t) + 1)) and len(t) <= 3 for t in turns.values())
    out = oc.occlude(rows.repartition(7), effects, SIZE)
    assert out.columns == [*rows.columns, "occluded"]
    mask = {tuple(p) for p in oc.occlusion_mask(effects, SIZE).collect()}
    assert {(p.scene, p.tile, p.r, p.c) for p in out.where("occluded").collect()} == mask
    # other seeds draw other shapes; the same ones whatever the layout
    again = oc.occlude(rows.coalesce(1), effects, SIZE)
    assert out.exceptAll(again).count() == 0 and {tuple(p) for p in oc.occlusion_mask(effects, SIZE, 7).collect()} != mask


def test_odd_pixels(spark):
    shape = "tile int, r int, c int, red double, green double, blue double, occluded string"
    rows = spark.createDataFrame([(1, 0, 0, None, 0.5, 0.5, "x"), (1, 0, 0, 0.25, 0.5, 0.5, "y"), (None, 1, 1, 0.5, 0.5, 0.5, None)], shape)
    got = oc.single_effect(rows, "illumination", 2).collect()
    assert len(got) == 3 and sum(p.red is None for p in got) == 1 and "occluded" not in got[0]
    assert oc.occlude(rows, oc.chosen_effects(rows).limit(0), 2).where("not occluded").count() == 3
    assert oc.occlude(rows.limit(0), oc.chosen_effects(rows.limit(0)), 2).count() == 0
    for bad in ((1, 2, 0), (1, -1, 0), (1, None, 0)):
        try:
            oc.single_effect(spark.createDataFrame([(*bad, 0.5, 0.5, 0.5, None)], shape), "clouds", 2).collect()
        except Exception as e:
            assert "outside a tile" in str(e)
        else:
            raise AssertionError(bad)
    gate = spark.createDataFrame([(k, k % 2 == 0) for k in range(100)], "tile int, has_road boolean")
    assert oc.gated(gate, 1.0).count() == 50 and 10 < oc.gated(gate, 0.5).count() < 40 and oc.gated(gate, 1.0, enabled=False).count() == 0

"""Sequential kernels and layer drawing against definitions written out, and against answers known from the formats they serve."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import layout, scalars
from rasterloom.operators import colour, documents, duplicates, geometry, grid, motion


def test_packing_pads_all_sides_and_grows_near_square():
    assert geometry.packed([(1, 10, 10)], 2) == (14, 14, {1: (2, 2)})
    width, height, places = geometry.packed([(1, 16, 16), (2, 16, 16), (3, 16, 16), (4, 16, 16)])
    assert (width, height) == (32, 32) and sorted(places.values()) == [(0, 0), (0, 16), (16, 0), (16, 16)]
    assert geometry.packed([(1, 30, 20)], power_of_two=True)[:2] == (32, 32)
    with pytest.raises(ValueError):
        geometry.packed([(1, 10, 10), (2, 10, 10)], most=(10, 10))
    rng = np.random.default_rng(3)
    sizes = [(i, int(w), int(h)) for i, (w, h) in enumerate(rng.integers(1, 40, (80, 2)))]
    width, height, places = geometry.packed(sizes, 1)
    used = np.zeros((height, width), int)
    for i, w, h in sizes:
        x, y = places[i]
        used[y - 1 : y + h + 1, x - 1 : x + w + 1] += 1
    assert used.max() == 1


def test_chamfer_equals_pixel_by_pixel():
    rng = np.random.default_rng(5)
    for _ in range(20):
        alpha = np.where(rng.random((9, 13)) < 0.15, rng.integers(0, 11, (9, 13)), 255)
        d = np.where(alpha > 10, 10**9, 0)
        for rows, cols, near in ((range(9), range(13), ((-1, 0, 3), (0, -1, 3), (-1, -1, 4), (-1, 1, 4))), (range(8, -1, -1), range(12, -1, -1), ((1, 0, 3), (0, 1, 3), (1, 1, 4), (1, -1, 4)))):
            for y in rows:
                for x in cols:
                    for dy, dx, cost in near:
                        if 0 <= y + dy < 9 and 0 <= x + dx < 13:
                            d[y, x] = min(d[y, x], d[y + dy, x + dx] + cost)
        assert np.allclose(geometry.chamfer(alpha), np.minimum(d / max(1, d.max()), 1))


def _sheet(cols, rows, cell, gap, lead, w=None, h=None):
    w, h = w or 2 * lead + cols * cell + (cols - 1) * gap, h or 2 * lead + rows * cell + (rows - 1) * gap
    image = np.zeros((h, w, 4), np.uint8)
    for r in range(rows):
        for c in range(cols):
            y, x = lead + r * (cell + gap), lead + c * (cell + gap)
            image[y : y + cell, x : x + cell] = (200, 10 + 5 * c, 90, 255)
    return image


def test_padding_of_detected_grids():
    found = grid.grid_of(_sheet(4, 3, 16, 2, 3))
    assert (found["cols"], found["rows"]) == (4, 3)
    assert [found[k] for k in ("left", "right", "top", "bottom", "space_x", "space_y")] == [3, 3, 3, 3, 2, 2]
    # Solid tiles up to the corners: the gutters are found by transparency.
    found = grid.grid_of(_sheet(4, 4, 16, 2, 0))
    assert (found["cols"], found["rows"], found["space_x"], found["left"]) == (4, 4, 2, 0)
    # What a flush grid explains has no padding, nor has one cell.
    assert grid.inferred_padding(np.tile([0, 1, 1, 1, 1, 0], 5).astype(float), 5) == (0, 0, 0)
    assert grid.inferred_padding(np.array([0, 0, 1, 1, 0]), 1) == (0, 0, 0)
    assert grid.inferred_padding(np.array([0, 1, 1, 1, 0, 0, 1, 1, 0], float), 2) == (0, 0, 0)
    assert grid.grid_of(np.zeros((7, 7, 4), np.uint8))["method"] == "none"


def test_stated_grids_win(spark):
    row = (1, 8, 2, 0.6, "gaps", 3, 3, 0, 0, 2, 0, 140, 32)
    df = spark.createDataFrame([row], "sheet long, cols int, rows int, confidence double, method string, left int, right int, top int, bottom int, space_x int, space_y int, width int, height int")
    none = F.lit(None).cast("int")
    kept = grid.resolved(df, none, none, {}).first()
    assert (kept.cols, kept.left, kept.space_x) == (8, 3, 2)
    dropped = grid.resolved(df, F.lit(7), none, {"top": F.lit(0)}).first()
    assert (dropped.cols, dropped.left, dropped.space_x) == (7, 0, 0)


def test_ramps_are_largest_first_with_greys_among_them(spark):
    reds, greys, blue = [0x401010, 0x802020, 0xC03030], [0x101010, 0x808080], [0x2030C0]
    df = spark.createDataFrame([(1, c) for c in greys + blue + reds], "frame long, rgb int")
    l, c, h = scalars.oklch(*scalars.unpacked_rgb(F.col("rgb")))  # noqa: E741
    found = colour.ramps(df.select("frame", "rgb", l.alias("l"), c.alias("c"), h.alias("h")), "frame")
    rows = sorted(found.collect(), key=lambda r: (r.ramp, r.place))
    assert [[r.rgb for r in rows if r.ramp == n] for n in range(3)] == [reds, greys, blue]
    assert [r.rgb for r in rows if r.anchor] == [0xC03030, 0x101010, 0x2030C0] or [r.rgb for r in rows if r.anchor][0] == 0xC03030
    assert [r.achromatic for r in rows if r.anchor] == [False, True, False]
    # A ramp on its own base stays; a lighter base never leaves 0..1 nor the order.
    same = colour.remapped_ramps(found, "frame", found.where("anchor").select("frame", "ramp", F.col("rgb").alias("base")))
    assert same.count() == 0
    moved = {r.rgb: r.to for r in colour.remapped_ramps(found, "frame", spark.createDataFrame([(1, 0, 0x30A040)], "frame long, ramp int, base int")).collect()}
    assert set(moved) == set(reds) and all((v >> 8 & 255) > (v >> 16) for v in moved.values())
    assert [moved[r] >> 8 & 255 for r in reds] == sorted(moved[r] >> 8 & 255 for r in reds)


def test_colours_there_and_back(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([tuple(map(int, r)) for r in rng.integers(0, 256, (200, 3))], "r int, g int, b int")
    l, c, h = scalars.oklch(F.col("r"), F.col("g"), F.col("b"))  # noqa: E741
    back = df.select("r", "g", "b", scalars.oklch_rgb(l, c, F.coalesce(h, F.lit(0.0))).alias("t")).collect()
    assert all(tuple(x.t) == (x.r, x.g, x.b) for x in back)
    wide = spark.range(1).select(scalars.oklch_rgb(F.lit(0.7), F.lit(0.9), F.lit(140.0)).alias("t"), scalars.rotated(F.lit(9), F.lit(80), F.lit(200), F.lit(-720.0)).alias("u"), scalars.hue_delta(F.lit(350.0), F.lit(10.0)).alias("d")).first()
    assert all(0 <= v <= 255 for v in wide.t) and tuple(wide.u) == (9, 80, 200) and wide.d == 20


def test_median_cut_keeps_few_pixels_as_they_are(spark):
    df = spark.createDataFrame([(1, x, 0, 10, 20, 30, 255) for x in range(3)], "frame long, x int, y int, r int, g int, b int, a int")
    assert [(r["rank"], r.r) for r in colour.median_cut(df, "frame", 4).orderBy("rank").collect()] == [(0, 10), (1, 10), (2, 10)]


def test_names_never_meet(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "a_2"), (1, 3, "a"), (2, 4, "a"), (2, 5, ""), (2, 6, "")], "sheet long, ord int, name string")
    got = [r.unique_name for r in documents.resolved_names(df, "sheet", "name", "ord").orderBy("ord").collect()]
    assert got == ["a", "a_2", "a_2_2", "a_3", "a", "frame", "frame_2"]


def _mul(a, b):
    t = a * b + 128
    return ((t >> 8) + t) >> 8


def test_layers_are_drawn_in_order(spark):
    layers = [(0, 0, "normal", 255, (200, 100, 50, 255)), (1, 2, "multiply", 200, (10, 240, 128, 200)), (2, 0, "normal", 90, (0, 0, 255, 128)), (3, 0, "normal", 0, (1, 2, 3, 255))]
    df = spark.createDataFrame([(7, 0, 0, n, z, m, o, *p) for n, z, m, o, p in layers], "sprite long, x int, y int, layer int, z int, mode string, opacity int, r int, g int, b int, a int")

    def over(b, s, opacity):
        sa = _mul(s[3], opacity)
        if b[3] == 0:
            return (*s[:3], sa)
        ra = sa + b[3] - _mul(b[3], sa)
        return (*(x + int((y - x) * sa / ra) for x, y in zip(b[:3], s[:3])), ra)

    want = over((0, 0, 0, 0), layers[0][4], 255)
    want = over(want, layers[2][4], 90)  # layer 1 has a z of 2, so it comes after layer 2
    top = tuple(_mul(x, y) for x, y in zip(want[:3], layers[1][4][:3])) + (200,)
    want = over(want, top, 200)
    got = colour.composited(df, "sprite").first()
    assert (got.r, got.g, got.b, got.a) == want


def test_phaser_documents_say_all_that_a_reader_asks(spark):
    frames = spark.createDataFrame([(1, 0, 0, 0, 16, 32, 90, 8, 16), (1, 1, 16, 0, 16, 32, 80, None, None)], "sheet long, frame long, x int, y int, w int, h int, ms int, px int, py int")
    own = spark.createDataFrame([("go", 0, 1, "reverse")], "name string, from_f int, to_f int, direction string")
    doc = json.loads(documents.phaser_json(frames, own).first().document)
    first = doc["frames"]["1_000"]
    assert first["rotated"] is False and first["trimmed"] is False and first["spriteSourceSize"] == {"x": 0, "y": 0, "w": 16, "h": 32}
    assert first["anchor"] == {"x": 0.5, "y": 0.5} and "anchor" not in doc["frames"]["1_001"] and first["duration"] == 90
    assert doc["animations"] == {"go": ["1_001", "1_000"]} and doc["meta"]["size"] == {"w": 32, "h": 32}


def test_long_tags_own_their_frames(spark):
    frames = spark.createDataFrame([(0,), (1,), (150_000,), (250_000,)], "frame int")
    own = spark.createDataFrame([(3, 0, 200_000), (1, 1, 1)], "ord int, from_f int, to_f int")
    got = {r.frame: r.owner for r in duplicates.tag_partitions(frames, own, "frame", 9).collect()}
    assert got == {0: 3, 1: 1, 150_000: 3, 250_000: 9}


def test_hashes_of_names(spark):
    def fnv(text):
        h = 0xCBF29CE484222325
        for b in text.encode() + b"\0" * 8:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    texts = ["", "a", "hero_00", "häß"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", layout.fnv64(F.col("t")).alias("h")).collect()
    assert {r.t: (r.h.hi << 32) + r.h.lo for r in rows} == {t: fnv(t) for t in texts}


def test_transforms_follow_the_parents(spark):
    parts = pd.DataFrame([(1, "hip", None, 0.0, 0.0, 90.0), (1, "knee", "hip", 10.0, 0.0, -90.0), (1, "lone", "gone", 1.0, 1.0, 0.0)], columns=["character", "part", "parent", "x", "y", "angle"])
    got = {r.part: [round(r[c], 9) for c in "abcdef"] for r in motion.pose_transforms(spark.createDataFrame(parts)).collect()}
    assert got["hip"] == [0, 1, -1, 0, 0, 0] and got["lone"] == [1, 0, 0, 1, 0, 0]
    # The knee is carried to (0, 10) and stands upright there.
    a, b, c, d, e, f = got["knee"]
    assert (round(a * 10 + e, 9), round(b * 10 + f, 9)) == (0, 10) and (a, d) == (1, 1)


def test_legs_reach_their_targets(spark):
    goal = (F.lit(6.0), F.lit(20.0))
    t = spark.range(1).select(motion.two_bone((F.lit(0.0), F.lit(0.0)), goal, F.lit(12.0), F.lit(16.0)).alias("t")).first().t
    end = [12 * np.cos(np.radians(t.upper)) + 16 * np.cos(np.radians(t.lower)), 12 * np.sin(np.radians(t.upper)) + 16 * np.sin(np.radians(t.lower))]
    assert np.allclose(end, [6, 20])


def test_parts_are_moved_apart():
    boxes = [(i, 10 * i, 5, 30 + i, 20) for i in range(9)] + [(99, 0, 0, 0, 5)]
    width, height, moves = geometry.exploded(boxes, 120, 100)
    own = {i: (x, y, w, h) for i, x, y, w, h in boxes}
    placed = [(own[i][0] + dx, own[i][1] + dy, own[i][2], own[i][3]) for i, dx, dy in moves]
    assert len(moves) == 9 and all(x + w <= width and y + h <= height for x, y, w, h in placed)
    assert all(a[0] + a[2] <= b[0] or b[0] + b[2] <= a[0] or a[1] + a[3] <= b[1] or b[1] + b[3] <= a[1] for k, a in enumerate(placed) for b in placed[:k])

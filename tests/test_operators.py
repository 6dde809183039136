"""Small hand-written inputs with the answers they must have."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import scalars
from rasterloom.operators import colour, documents, duplicates, geometry, grid, lint, pixels, timeline, usage
from rasterloom.sources import ase, png

ROWS = "day string, provider string, model string, status string, requests long, completed long, cost_micros long, unknown_costs long"
PIX = "frame int, x int, y int, r int, g int, b int, a int"


def raster(spark, frames):
    """Frames as lists of rows of (r, g, b, a)."""
    return spark.createDataFrame([(i, x, y, *p) for i, f in enumerate(frames) for y, row in enumerate(f) for x, p in enumerate(row)], PIX)


def test_days_are_filled_and_unknown_dates_kept(spark):
    rows = [("2027-10-20", "x", "m", "done", 1, 1, 26000, 0), ("2027-10-22", "x", "m", "done", 1, 1, 26000, 0), (None, "x", "m", "done", 1, 1, 100000, 0)]
    got = {r.key: r.cost_micros for r in usage.aggregate_activity(spark.createDataFrame(rows, ROWS), "day").collect()}
    assert got == {"2027-10-20": 26000, "2027-10-21": 0, "2027-10-22": 26000, "Date unknown": 100000}


def test_weeks_begin_on_monday_and_months_are_filled(spark):
    one = lambda day: (day, "x", "m", "done", 1, 1, 1, 0)
    df = spark.createDataFrame([one("2027-01-03"), one("2027-01-04")], ROWS)
    assert sorted(r.key for r in usage.aggregate_activity(df, "week").collect()) == ["2026-12-28", "2027-01-04"]
    df = spark.createDataFrame([one("2026-12-05"), one("2027-02-01")], ROWS)
    assert sorted(r.key for r in usage.aggregate_activity(df, "month").collect()) == ["2026-12", "2027-01", "2027-02"]
    assert usage.aggregate_activity(spark.createDataFrame([], ROWS), "day").count() == 0


def test_undated_rows_go_only_under_a_range(spark):
    df = spark.createDataFrame([(None, "x", "lite", "done", 1, 1, 1, 0), ("2027-01-05", "x", "lite", "done", 1, 1, 1, 0)], ROWS)
    assert usage.filter_activity(df, model="lite").count() == 2
    assert usage.filter_activity(df, model="lite", since="2027-01-05", until="2027-01-05").count() == 1


def test_rates_delays_and_money(spark):
    row = spark.createDataFrame([(10.0, 24.0, 12.0, 0.0, float("nan"))], "a double, b double, c double, d double, e double").select(*[scalars.fps_to_ms(F.col(c)).alias(c) for c in "abcde"]).first()
    assert tuple(row) == (100, 42, 83, 1000, 1000)
    df = spark.createDataFrame([(125, 133, 5)], "a int, b int, c int")
    assert tuple(df.select(*[scalars.gif_delay(F.col(c)) for c in "abc"]).first()) == (130, 130, 20)
    df = spark.createDataFrame([(26000, 1500000, 1234567890123)], "a long, b long, c long")
    assert tuple(df.select(*[scalars.money(F.col(c)) for c in "abc"]).first()) == ("$0.026", "$1.50", "$1,234,567.890123")


def test_rounding_rules(spark):
    df = spark.createDataFrame([(-2.5, 2.5, 3.5, 300.0)], "a double, b double, c double, d double")
    got = df.select(scalars.round_half_up(F.col("a")), *[scalars.stored_byte(F.col(c)) for c in "abcd"]).first()
    assert tuple(got) == (-2, 0, 2, 4, 255)


def test_cells_of_padded_and_flush_sheets(spark):
    fit = lambda *v: spark.range(1).select(grid.fitted(*[F.lit(x) for x in v])).first()[0]
    assert [fit(64, 2, 0, 0, 0), fit(96, 3, 0, 0, 0), fit(208, 6, 0, 0, 0), fit(208, 6, 3, 3, 2), fit(140, 4, 3, 3, 2), fit(270, 8, 0, 0, 3)] == [32, 32, 34, 32, 32, None]


@pytest.mark.parametrize(("cols", "rows", "cell", "radius"), [(2, 2, 32, 12), (5, 5, 40, 14), (3, 4, 32, 12)])
def test_detected_grids(spark, cols, rows, cell, radius):
    y, x = np.mgrid[0 : rows * cell, 0 : cols * cell]
    alpha = np.where(((x % cell) - cell // 2) ** 2 + ((y % cell) - cell // 2) ** 2 <= radius**2, 255, 0).astype(np.uint8)
    df = spark.createDataFrame([(1, cols * cell, rows * cell, bytearray(alpha.tobytes()))], "sheet long, width int, height int, alpha binary")
    r = grid.detected(df).first()
    assert (r.cols, r.rows) == (cols, rows)


def test_duplicates_numbers_tags_and_holds(spark):
    a, b = [[(9, 9, 9, 255)] * 2] * 2, [[(1, 1, 1, 255)] * 2] * 2
    clear = [[(200, 7, 7, 0)] * 2] * 2
    frames = raster(spark, [a, a, b, a, clear, [[(0, 0, 0, 0)] * 2] * 2]).withColumn("sheet", F.lit(1))
    mapped = duplicates.renumbered(duplicates.exact(duplicates.signatures(frames, "sheet", "frame"), "sheet", "frame"), "sheet", "frame")
    assert [r.new_index for r in mapped.orderBy("frame").collect()] == [0, 0, 1, 0, 2, 2]
    mapping = mapped.select("frame", "new_index")
    tags = spark.createDataFrame([(0, "run", 2, 3), (1, "all", 3, 0), (2, "far", 50, 60)], "ord int, name string, from_f int, to_f int")
    got = {r.name: (list(r.frames), r.from_f, r.to_f, r.contiguous) for r in duplicates.remapped_tags(tags, mapping, 6).collect()}
    assert got == {"run": ([1, 0], 0, 1, False), "all": ([0, 1, 0], 0, 1, False), "far": ([], 0, 0, False)}
    holds = spark.createDataFrame([(0, None), (1, 250), (2, 120), (3, 999)], "frame int, hold int")
    assert {r.new_index: r.hold for r in duplicates.remapped_durations(holds, mapping).collect()} == {0: 250, 1: 120}


def test_greedy_merging_does_not_chain(spark):
    frames = raster(spark, [[[(v, 0, 0, 255)] * 4] + [[(0, 0, 0, 255)] * 4] * 3 for v in (0, 15, 30)]).withColumn("sheet", F.lit(1).cast("long")).withColumn("frame", F.col("frame").cast("long"))
    near = duplicates.distances(frames, "sheet", "frame", 1.0)
    assert sorted((r.a, r.b, r.distance) for r in near.collect()) == [(0, 1, 0.9375), (1, 2, 0.9375)]
    got = duplicates.greedy(frames.select("sheet", "frame").distinct(), near, "sheet", "frame")
    assert [r.rep for r in got.orderBy("frame").collect()] == [0, 0, 2]


def test_partitions_take_the_first_tag(spark):
    tags = spark.createDataFrame([(0, "idle", 0, 2), (1, "walk", 2, 3), (2, "late", 10, 12)], "ord int, name string, from_f int, to_f int")
    frames = spark.range(6).select(F.col("id").cast("int").alias("frame"))
    assert [r.owner for r in duplicates.tag_partitions(frames, tags, "frame", 3).orderBy("frame").collect()] == [0, 0, 0, 1, 3, 3]


def test_playback_orders(spark):
    tags = spark.createDataFrame([("f", 1, 3, "forward"), ("r", 1, 3, "reverse"), ("p", 1, 4, "pingpong"), ("q", 1, 4, "pingpong-reverse"), ("two", 1, 2, "pingpong"), ("tow", 1, 2, "pingpong-reverse")], "name string, from_f int, to_f int, direction string")
    got = {}
    for r in timeline.playback(tags).orderBy("name", "step").collect():
        got.setdefault(r.name, []).append(r.frame)
    assert got == {"f": [1, 2, 3], "r": [3, 2, 1], "p": [1, 2, 3, 4, 3, 2], "q": [4, 3, 2, 1, 2, 3], "two": [1, 2], "tow": [2, 1]}


def test_palette_and_nearest_and_pairs(spark):
    red, green = (255, 0, 0, 255), (0, 255, 0, 255)
    df = raster(spark, [[[red] * 4] * 2 + [[green] * 4] * 2])
    assert [(r.rgb, r.n, r["rank"]) for r in colour.extracted(df, "frame", 4).orderBy("rank").collect()] == [(0xFF0000, 8, 0), (0x00FF00, 8, 1)]
    near = colour.nearest(colour.populations(df, "frame"), [(250, 5, 5), (0, 200, 0), (250, 5, 5)])
    assert {r.rgb: r.to for r in near.collect()} == {0xFF0000: 0, 0x00FF00: 1}
    cut = colour.median_cut(df.withColumn("frame", F.col("frame").cast("long")), "frame", 2)
    assert sorted((r.r, r.g, r.b) for r in cut.collect()) == [(0, 255, 0), (255, 0, 0)]
    colours = spark.createDataFrame([(0x646464,), (0x656464,), (0xFFFFFF,)], "rgb int")
    assert [(r.a, r.b, r.d2) for r in colour.near_duplicates(colours, 2.0).collect()] == [(0x646464, 0x656464, 1)]


def test_pixel_operators_on_a_dot(spark):
    empty, dot = (0, 0, 0, 0), (10, 20, 30, 255)
    df = raster(spark, [[[dot if (x, y) == (1, 1) else empty for x in range(3)] for y in range(3)]])
    assert pixels.boxes(df, "frame").first()[1:] == (1, 1, 1, 1, 1)
    assert pixels.outlined(df, "frame", 1, (255, 0, 0)).where("a = 255").count() == 9
    assert pixels.choked(df, "frame", 1).where("a > 0").count() == 0
    assert pixels.edge_counts(df, "frame").first()[1:] == (1, 1)
    assert pixels.eagle2x(df, "frame").where("a > 0").count() == 0
    assert pixels.scale2x(df, "frame").where("a > 0").count() == 4
    assert pixels.upscaled(df, 3).where("a > 0").count() == 9
    keyed = pixels.soft_key(raster(spark, [[[(0, 0, 0, 255), (30, 0, 0, 255), (90, 0, 0, 255)]]]), (F.lit(0), F.lit(0), F.lit(0)), 20, 20)
    assert [r.a for r in keyed.orderBy("x").collect()] == [0, 128, 255]


def test_lint_findings(spark):
    box = lambda y: [[(9, 9, 9, 255) if 4 <= x < 8 and y <= v < y + 4 else (0, 0, 0, 0) for x in range(32)] for v in range(32)]
    df = raster(spark, [box(20), box(20), box(2), box(20)]).withColumn("sheet", F.lit(1))
    assert [(r.frame, r.detail) for r in lint.pivot_drift(df, 32, 32).collect()] == [(2, '{"axis":"y","x":"6","y":"5"}')]
    cover = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.0), (1, 2, 0.001), (1, 3, 0.0), (2, 0, 0.0), (2, 1, 0.0)], "sheet int, frame int, coverage double")
    assert sorted((r.sheet, r.frame if r.frame is not None else -1, r.severity) for r in lint.empty_cell(cover).collect()) == [(1, 1, "warning"), (1, 2, "info"), (1, 3, "info"), (2, -1, "warning")]
    sizes = spark.createDataFrame([(1, 100, 100), (2, 64, 32)], "sheet int, width int, height int")
    assert [r.sheet for r in lint.non_power_of_two(sizes).collect()] == [1]
    bar = [[(9, 9, 9, 255) if 3 <= x and 2 <= y < 6 else (0, 0, 0, 0) for x in range(8)] for y in range(8)]
    other = [[(9, 9, 9, 255) if x < 3 and 2 <= y < 6 else (0, 0, 0, 0) for x in range(8)] for y in range(8)]
    seams = lint.frame_bleed(raster(spark, [bar, other]).withColumn("sheet", F.lit(1)), 2, 8, 8).collect()
    assert [(r.frame, r.detail) for r in seams] == [(0, '{"seam":"vertical","length":"4","at":"2"}')]


def test_geometry_kernels():
    mask = np.zeros((5, 5), bool)
    mask[1:4, 1:4] = True
    line = geometry.traced(mask)
    assert line[0] == (1, 1) and len(line) == 8 and set(line) == {(x, y) for x in (1, 2, 3) for y in (1, 2, 3)} - {(2, 2)}
    assert geometry.traced(np.ones((1, 1), bool)) == [(0, 0)] and geometry.traced(np.zeros((2, 2), bool)) == []
    assert geometry.hull([(0, 0), (2, 0), (1, 0), (2, 2), (0, 2), (1, 1)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert geometry.simplified([(0, 0), (1, 0), (2, 0), (2, 5)], 0.5) == [(0, 0), (2, 0), (2, 5)]
    sizes = [(i, 3 + i * 7 % 11, 2 + i * 5 % 13) for i in range(60)]
    width, height, places = geometry.packed(sizes, 1)
    used = np.zeros((height, width), int)
    for i, w, h in sizes:
        x, y = places[i]
        used[y : y + h + 1, x : x + w + 1] += 1
        assert x + w + 1 <= width and y + h + 1 <= height
    assert used.max() == 1
    assert geometry.chamfer(np.full((2, 2), 255)).tolist() == [[1, 1], [1, 1]]


def test_documents(spark):
    frames = spark.createDataFrame([(1, 0, 0, 0, 16, 48, 100), (1, 1, 16, 0, 16, 48, 50)], "sheet long, frame long, x int, y int, w int, h int, ms int")
    marks = spark.createDataFrame([(0, 0, 1, 1), (1, 0, 8, 47)], "ord int, frame long, x int, y int")
    found = documents.attached(frames, marks)
    assert [(r.px, r.py) for r in found.orderBy("frame").collect()] == [(8, 48), (None, None)]
    assert documents.unity_rects(found, F.lit(96)).orderBy("frame").first()[2:] == (0, 48, 16, 48, 0.5, 0.0)
    assert '"anchor":{"x":0.5,"y":1.0}' in documents.phaser_json(found).first().document
    assert "1_001" in documents.aseprite_json(found).first().document


def test_png_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    images = {f"i{k}": rng.integers(0, 256, (k + 1, 5, 4), dtype=np.uint8) for k in range(3)}
    for name, image in images.items():
        (tmp_path / f"{name}.png").write_bytes(png.encode(image))
    rows = png.read(spark, str(tmp_path))
    for r in rows.collect():
        image = images[r.path.rsplit("/", 1)[1][:-4]]
        assert (r.height, r.width) == image.shape[:2] and bytes(r.rgba) == image.tobytes()
    assert sorted((r.width, r.height) for r in png.sizes(spark, str(tmp_path)).collect()) == [(5, 1), (5, 2), (5, 3)]
    again = png.write(png.packed(png.exploded(rows), "path"), "path").collect()
    assert len(again) == 3 and all((png.decode(bytes(r.png)) == images[r.key.rsplit("/", 1)[1][:-4]]).all() for r in again)
    bad = bytearray(png.encode(images["i0"]))
    bad[30] ^= 1
    with pytest.raises(png.PngError):
        png.decode(bytes(bad))


def _ase():
    text = lambda s: struct.pack("<H", len(s)) + s.encode()
    chunk = lambda kind, body: struct.pack("<IH", len(body) + 6, kind) + body
    layer = lambda name, type_, level: chunk(0x2004, struct.pack("<HHHHHHB3x", 1, type_, level, 0, 0, 0, 255) + text(name))
    pixels_ = bytes([1, 2, 3, 255] * 4)
    first = [layer("group", 1, 0), layer("body", 0, 1), chunk(0x2005, struct.pack("<HhhBHh5x", 1, 1, 2, 200, 2, 0) + struct.pack("<HH", 2, 2) + zlib.compress(pixels_)), chunk(0x2018, struct.pack("<H8x", 1) + struct.pack("<HHBH10x", 0, 1, 2, 0) + text("walk"))]
    second = [chunk(0x2005, struct.pack("<HhhBHh5x", 1, 0, 0, 255, 1, 0) + struct.pack("<H", 0))]
    frames = b""
    for ms, chunks in ((100, first), (250, second)):
        body = b"".join(chunks)
        frames += struct.pack("<IHHH2xI", len(body) + 16, 0xF1FA, len(chunks), ms, len(chunks)) + body
    head = struct.pack("<IHHHHH", 128 + len(frames), 0xA5E0, 2, 4, 4, 32)
    return head + bytes(128 - len(head)) + frames


def test_layered_files(spark, tmp_path):
    doc = ase.parse(_ase())
    assert doc.durations == [100, 250] and [(x["name"], x["parent"], x["grouped"]) for x in doc.layers] == [("group", -1, True), ("body", 0, False)]
    assert doc.cels[1]["link"] == 0 and doc.cels[1]["rgba"] == doc.cels[0]["rgba"] == bytes([1, 2, 3, 255] * 4)
    assert doc.tags[0]["direction"] == "pingpong"
    (tmp_path / "a.ase").write_bytes(_ase())
    assert [r.ms for r in ase.read(spark, str(tmp_path), "frames").orderBy("frame").collect()] == [100, 250]
    assert ase.read(spark, str(tmp_path), "cels").count() == 2 and ase.read(spark, str(tmp_path), "tags").first().name == "walk"
    for cut in (3, 60, 150, 200):
        with pytest.raises(ase.AseError):
            ase.parse(_ase()[:cut])


def _tables(spark, path, frames=4, users=9):
    """embeddings of `frames` frames in which a channel's value is the frame's, and an event of each user at hour = user."""
    spark.createDataFrame([(i, [(i + 0.5) / 256 - 0.5] * 64) for i in range(frames)], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    events = spark.createDataFrame([(u, f"2024-01-{u + 3:02d} {u:02d}:00:00") for u in range(users)], "user_id long, t string")
    events.select("user_id", F.to_timestamp("t").alias("ts")).write.parquet(f"{path}/events.parquet")


def test_every_neighbouring_pair_is_blended_and_every_canvas_cropped(spark, tmp_path):
    from rasterloom.plans.colour import blend_modes
    from rasterloom.plans.grid import auto_crop

    _tables(spark, str(tmp_path))
    blended = blend_modes(spark, str(tmp_path))
    assert sorted((r.mode, r.frame) for r in blended.where("x = 0 and y = 0 and mode in ('darken', 'lighten')").collect()) == [(m, f) for m in ("darken", "lighten") for f in range(3)]
    assert blended.count() == 15 * 3 * 16
    got = sorted((r.sheet, r.frame, r.x, r.y) for r in auto_crop(spark, str(tmp_path)).collect())
    assert got == [(0, 0, 1, 1), (0, 7, 8, 8), (1, 1, 1, 1), (1, 8, 8, 8)] + [(s, s, 1, 1) for s in range(2, 7)]


def test_palette_of_many_colours_is_cut(spark):
    few = [[(9, 9, 9, 255)] * 4] * 4
    many = [[(v, 0, 0, 255) for v in (0, 1, 200, 201)]] * 4
    repeats = [[(10, 10, 10, 255)] * 4, [(10, 10, 10, 255)] * 4, [(10, 10, 10, 255)] * 4, [(10, 10, 10, 255), (11, 10, 10, 255), (12, 10, 10, 255), (250, 10, 10, 255)]]
    df = raster(spark, [few, many, repeats])
    got = {}
    for r in colour.palette(df, "frame", 3).orderBy("frame", "rank").collect():
        got.setdefault(r.frame, []).append((r["rank"], r.rgb >> 16, r.n))
    assert got[0] == [(0, 9, 16)]
    assert got[1] == [(0, 0, None), (1, 1, None), (2, 201, None)]
    assert got[2] == [(0, 10, None), (1, 71, None)]
    assert {r.frame for r in colour.extracted(df, "frame", 3).collect()} == {0}


def test_every_part_may_have_a_pivot(spark, tmp_path):
    from rasterloom.plans import documents

    spark.createDataFrame([(k, 1000.0) for k in range(1, 7)], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(k, k, 1, 1, 100.0, 3.0, "N") for k in range(1, 6)] + [(9, 5, 1, 1, 100.0, 4.0, "R")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber long, l_suppkey long, l_extendedprice double, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {1: 3, 2: 3, 3: 3, 4: 3, 5: None, 6: None}
    assert {r.frame: r.px for r in documents.normalized_frames(spark, str(tmp_path)).collect()} == want
    assert sum(r.document.count('"anchor"') for r in documents.phaser_documents(spark, str(tmp_path)).collect()) == 4
    assert sum(r.document.count("pivot: {x: 0.1875") for r in documents.unity_documents(spark, str(tmp_path)).collect()) == 4


def test_tags_of_every_sheet_and_all_hours(spark, tmp_path):
    from rasterloom.plans.duplicates import remapped_tags
    from rasterloom.plans.grid import detected_grids

    _tables(spark, str(tmp_path / "a"), frames=260)
    got = {(r.sheet, r.name): list(r.frames) for r in remapped_tags(spark, str(tmp_path / "a")).collect()}
    assert {s for s, _ in got} == {0, 1} and got[1, "idle"] == [0] and got[0, "far"] == got[1, "far"] == []
    # Every hour of thirty days: eight blocks of three hours, where dropping each fourth hour left six.
    events = spark.range(30 * 24).select(F.lit(1).cast("long").alias("user_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 3600).alias("ts"))
    events.write.parquet(f"{tmp_path}/b/events.parquet")
    r = detected_grids(spark, str(tmp_path / "b")).first()
    assert (r.cols, r.rows, r.method) == (8, 1, "gaps")


def test_bytes_of_a_high_sheet_need_more_than_32_bits(spark, tmp_path):
    from rasterloom.plans.layout import cell_geometry

    def rows(name, keys):
        spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/{name}/part.parquet")
        df = cell_geometry(spark, str(tmp_path / name))
        return dict(df.dtypes), {r.p_partkey: r for r in df.collect()}

    for name, keys, byte, y in (("a", [0, 9], "int", "int"), ("b", [13, 1_199_999], "bigint", "int"), ("c", [500_000_006], "bigint", "bigint"), ("d", [], "int", "int")):
        kinds, got = rows(name, keys)
        assert (kinds["byte"], kinds["row"], kinds["y"], kinds["py"], kinds["back"], kinds["x"]) == (byte, y, y, y, "bigint", "int")
        for k in keys:
            row, col = divmod(k, 7)
            px, py = 2 + col * 17 + 4, 3 + row * 34 + 5
            assert tuple(got[k]) == (k, row, col, k, px - 4, py - 5, (py * 131 + px) * 4, px, py)

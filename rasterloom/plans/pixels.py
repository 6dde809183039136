"""Queries of pixel operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.scalars import luminance
from rasterloom.operators import pixels as op
from rasterloom.plans.registry import plan
from rasterloom.plans.relations import CANVAS, KEYED, PIXELS, canvas, keyed, pixels

_VOTE = """v AS (SELECT frame, r, g, b, count(*) AS n, min(y * 65536 + x) AS first FROM keyed WHERE x IN (0, 3) AND y IN (0, 3) GROUP BY 1, 2, 3, 4),
 bg AS (SELECT frame, min(struct_pack(m := -n, f := first, r := r, g := g, b := b)) AS s FROM v GROUP BY 1)"""


@plan(f"WITH {KEYED}, {_VOTE} SELECT frame, s.r AS r, s.g AS g, s.b AS b FROM bg")
def background_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.corner_vote(keyed(spark, sf_dir), "frame")


@plan(f"""WITH {PIXELS}, d AS (SELECT *, sqrt(((r - 128) * (r - 128) + (g - 128) * (g - 128) + (b - 128) * (b - 128))::DOUBLE) AS d FROM pixels)
 SELECT frame, x, y, r, g, b, round_even(least(greatest(least(a, 255 * CASE WHEN d < 20 THEN 0 WHEN d < 60 THEN (d - 20) / 40 ELSE 1 END), 0), 255), 0)::INT AS a FROM d""")
def chroma_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = F.lit(128)
    return op.soft_key(pixels(spark, sf_dir), (grey, grey, grey), 20, 40)


@plan(f"WITH {PIXELS} SELECT k.frame, k.x, k.y, k.r, k.g, k.b, min(n.a) AS a FROM pixels k JOIN pixels n ON n.frame = k.frame AND abs(n.x - k.x) <= 1 AND abs(n.y - k.y) <= 1 GROUP BY ALL")
def choked_matte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.choked(pixels(spark, sf_dir), "frame", 1)


@plan(f"""WITH {KEYED}, m AS (SELECT k.frame, k.x, k.y, any_value(k.r) r, any_value(k.g) g, any_value(k.b) b, any_value(k.a) a, max((n.a > 0)::INT) AS near FROM keyed k JOIN keyed n ON n.frame = k.frame AND abs(n.x - k.x) <= 1 AND abs(n.y - k.y) <= 1 GROUP BY 1, 2, 3)
 SELECT frame, x, y, CASE WHEN near = 1 AND a = 0 THEN 255 ELSE r END AS r, CASE WHEN near = 1 AND a = 0 THEN 0 ELSE g END AS g, CASE WHEN near = 1 AND a = 0 THEN 0 ELSE b END AS b, CASE WHEN near = 1 THEN 255 ELSE a END AS a FROM m""")
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.outlined(keyed(spark, sf_dir), "frame", 1, (255, 0, 0))


@plan(f"""WITH {PIXELS} SELECT frame, (x // 2)::INT AS x, (y // 2)::INT AS y, CASE WHEN sum(a) > 0 THEN floor(sum(r * a) / sum(a) + 0.5) ELSE 0 END::INT AS r, CASE WHEN sum(a) > 0 THEN floor(sum(g * a) / sum(a) + 0.5) ELSE 0 END::INT AS g,
 CASE WHEN sum(a) > 0 THEN floor(sum(b * a) / sum(a) + 0.5) ELSE 0 END::INT AS b, floor(avg(a) + 0.5)::INT AS a FROM pixels GROUP BY 1, 2, 3""")
def downscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.downscaled(pixels(spark, sf_dir), "frame", 2)


@plan(f"WITH {KEYED} SELECT frame, (x * 3 + dx)::INT AS x, (y * 3 + dy)::INT AS y, r, g, b, a FROM keyed, (SELECT unnest([0, 1, 2]) AS dx), (SELECT unnest([0, 1, 2]) AS dy)")
def upscaled_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.upscaled(keyed(spark, sf_dir), 3)


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few colours, so that neighbours are equal now and then."""
    p = keyed(spark, sf_dir)
    return p.withColumns({c: (F.floor(F.col(c) / 128) * 128).cast("int") for c in "rgb"})


_COARSE = KEYED + ", c AS (SELECT frame, x, y, (r // 128 * 128)::INT AS r, (g // 128 * 128)::INT AS g, (b // 128 * 128)::INT AS b, a FROM keyed), k AS (SELECT *, CASE WHEN a = 0 THEN 0 ELSE a::BIGINT * 16777216 + r * 65536 + g * 256 + b END AS key FROM c)"


def _near(name: str, dx: int, dy: int) -> str:
    return f"JOIN k {name} ON {name}.frame = e.frame AND {name}.x = least(greatest(e.x + {dx}, 0), 3) AND {name}.y = least(greatest(e.y + {dy}, 0), 3)"


_FOUR = " ".join(_near(n, dx, dy) for n, dx, dy in (("b", 0, -1), ("d", -1, 0), ("f", 1, 0), ("h", 0, 1)))
_DIAGONAL = " ".join(_near(n, dx, dy) for n, dx, dy in (("aa", -1, -1), ("cc", 1, -1), ("gg", -1, 1), ("ii", 1, 1)))


def _quads(cases: list[str]) -> str:
    parts = [f"SELECT e.frame, e.x * 2 + {i % 2} AS x, e.y * 2 + {i // 2} AS y, {c} AS s FROM k e {_FOUR} {_DIAGONAL}" for i, c in enumerate(cases)]
    return f"WITH {_COARSE}, o AS ({' UNION ALL '.join(parts)}) SELECT frame, x, y, s.r AS r, s.g AS g, s.b AS b, s.a AS a FROM o"


def _pack(n: str) -> str:
    return f"struct_pack(r := {n}.r, g := {n}.g, b := {n}.b, a := {n}.a)"


_EDGE = "b.key <> h.key AND d.key <> f.key"


@plan(_quads([f"CASE WHEN {_EDGE} AND {p}.key = {q}.key THEN {_pack(s)} ELSE {_pack('e')} END" for p, q, s in (("d", "b", "d"), ("b", "f", "f"), ("d", "h", "d"), ("h", "f", "f"))]))
def scale2x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.scale2x(_coarse(spark, sf_dir), "frame")


@plan(_quads([f"CASE WHEN {p}.key = {t}.key AND {t}.key = {q}.key THEN {_pack(t)} ELSE {_pack('e')} END" for p, t, q in (("d", "aa", "b"), ("f", "cc", "b"), ("d", "gg", "h"), ("f", "ii", "h"))]))
def eagle2x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.eagle2x(_coarse(spark, sf_dir), "frame")


def _nine() -> str:
    same = lambda p, q: f"{p}.key = {q}.key"
    side = lambda p, q, far, r, t, other: f"(({same(p, q)} AND e.key <> {far}.key) OR ({same(r, t)} AND e.key <> {other}.key))"
    rules = [(same("d", "b"), "d"), (side("d", "b", "cc", "b", "f", "aa"), "b"), (same("b", "f"), "f"), (side("d", "b", "gg", "d", "h", "aa"), "d"), ("false", "e"), (side("b", "f", "ii", "h", "f", "cc"), "f"), (same("d", "h"), "d"), (side("d", "h", "ii", "h", "f", "gg"), "h"), (same("h", "f"), "f")]
    parts = [f"SELECT e.frame, e.x * 3 + {i % 3} AS x, e.y * 3 + {i // 3} AS y, CASE WHEN {_EDGE} AND {w} THEN {_pack(t)} ELSE {_pack('e')} END AS s FROM k e {_FOUR} {_DIAGONAL}" for i, (w, t) in enumerate(rules)]
    return f"WITH {_COARSE}, o AS ({' UNION ALL '.join(parts)}) SELECT frame, x, y, s.r AS r, s.g AS g, s.b AS b, s.a AS a FROM o"


@plan(_nine())
def scale3x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.scale3x(_coarse(spark, sf_dir), "frame")


@plan(f"""WITH {PIXELS}, m AS (SELECT frame, floor(avg(r) + 0.5) AS mr, floor(avg(g) + 0.5) AS mg, floor(avg(b) + 0.5) AS mb FROM pixels WHERE x IN (0, 3) AND y IN (0, 3) GROUP BY 1),
 d AS (SELECT p.*, sqrt(((r - mr) * (r - mr) + (g - mg) * (g - mg) + (b - mb) * (b - mb))::DOUBLE) AS d FROM pixels p JOIN m USING (frame)),
 k AS (SELECT *, CASE WHEN d < 20 THEN 0 WHEN d < 60 THEN floor((d - 20) / 40 * 255 + 0.5) ELSE 255 END / 255::DOUBLE AS w FROM d)
 SELECT frame, x, y, round_even(r * w + 200 * (1 - w), 0)::INT AS r, round_even(g * w + 100 * (1 - w), 0)::INT AS g, round_even(b * w + 50 * (1 - w), 0)::INT AS b, 255 AS a FROM k""")
def solid_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.solid_fill(pixels(spark, sf_dir), "frame", (200, 100, 50), 20, 40)


@plan(f"WITH {PIXELS} SELECT frame, x, y, round((r * 0.2126 + g * 0.7152 + b * 0.0722) / 255 * (a / 255), 9)::DOUBLE AS light FROM pixels")
def luminances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    return p.select("frame", "x", "y", F.round(luminance(*[F.col(c) for c in "rgba"]), 9).alias("light"))


@plan(f"""WITH {PIXELS}, h AS (SELECT frame, x, y, avg(r) OVER (PARTITION BY frame, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM pixels)
 SELECT frame, x, y, round(avg(m) OVER (PARTITION BY frame, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS r FROM h""")
def box_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).select("frame", "x", "y", F.col("r").cast("double").alias("r"))
    return op.blurred(p, "frame", "r", 1).withColumn("r", F.round("r", 6))


@plan(f"""WITH {PIXELS}, h AS (SELECT frame, x, y, ((r * 0.2126 + g * 0.7152 + b * 0.0722) / 255 * (a / 255))::DOUBLE AS h FROM pixels),
 d AS (SELECT e.frame, e.x, e.y, l.h - r.h AS dx, u.h - o.h AS dy FROM h e JOIN h l ON l.frame = e.frame AND l.y = e.y AND l.x = greatest(e.x - 1, 0) JOIN h r ON r.frame = e.frame AND r.y = e.y AND r.x = least(e.x + 1, 3)
  JOIN h u ON u.frame = e.frame AND u.x = e.x AND u.y = greatest(e.y - 1, 0) JOIN h o ON o.frame = e.frame AND o.x = e.x AND o.y = least(e.y + 1, 3)), s AS (SELECT *, sqrt(dx * dx + dy * dy + 1) AS n FROM d)
 SELECT frame, x, y, floor((dx / n * 0.5 + 0.5) * 255 + 0.5)::INT AS nx, floor((dy / n * 0.5 + 0.5) * 255 + 0.5)::INT AS ny, floor((1 / n * 0.5 + 0.5) * 255 + 0.5)::INT AS nz FROM s""")
def normal_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.normals(pixels(spark, sf_dir), "frame")


@plan(f"""WITH {KEYED}, m AS (SELECT unnest(range(0, 9))::INT AS t), a AS (SELECT t, CASE WHEN t < 1 THEN t WHEN t >= 8 THEN 4 - (9 - t) ELSE 1 + least(1, (t - 1) * 2 // 7) END::INT AS f FROM m)
 SELECT k.frame, ax.t AS x, ay.t AS y, k.r, k.g, k.b, k.a FROM keyed k JOIN a ax ON ax.f = k.x JOIN a ay ON ay.f = k.y""")
def nine_slice_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stretched(keyed(spark, sf_dir), "frame", 4, 4, 1, 9, 9)


@plan(f"WITH {KEYED}, p AS (SELECT unnest(range(-2, 6))::INT AS t) SELECT k.frame, px.t AS x, py.t AS y, k.r, k.g, k.b, k.a FROM keyed k JOIN p px ON least(greatest(px.t, 0), 3) = k.x JOIN p py ON least(greatest(py.t, 0), 3) = k.y")
def extruded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.extruded(keyed(spark, sf_dir), 4, 4, 2)


@plan(f"""WITH {KEYED}, e AS (SELECT k.frame, k.a, EXISTS (SELECT 1 FROM keyed n WHERE n.frame = k.frame AND abs(n.x - k.x) + abs(n.y - k.y) = 1 AND n.a = 0) AS edge FROM keyed k)
 SELECT frame, count(*) FILTER (a > 0) AS solid, count(*) FILTER (a > 0 AND edge) AS edge FROM e GROUP BY 1""")
def silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.edge_counts(keyed(spark, sf_dir), "frame")


@plan(f"WITH {CANVAS} SELECT frame, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS pixels FROM canvas GROUP BY 1")
def trim_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.boxes(canvas(spark, sf_dir).withColumn("a", F.lit(255)), "frame")


@plan(f"WITH {PIXELS} SELECT frame, count(*) FILTER (a > 127) AS opaque, round(avg((a > 127)::INT), 6) AS coverage, bool_or(a = 0) AS any_clear, bool_or(a > 0 AND a < 255) AS any_half, bool_and(a IN (0, 255)) AS binary_alpha FROM pixels GROUP BY 1")
def alpha_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    return pixels(spark, sf_dir).groupBy("frame").agg(
        F.count_if(a > 127).alias("opaque"), F.round(F.avg((a > 127).cast("double")), 6).alias("coverage"), F.bool_or(a == 0).alias("any_clear"), F.bool_or((a > 0) & (a < 255)).alias("any_half"), F.bool_and(a.isin(0, 255)).alias("binary_alpha")
    )


@plan(f"WITH {PIXELS} SELECT frame, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(a) AS a, avg(a) < 128 AS clear FROM pixels WHERE x IN (0, 3) AND y IN (0, 3) GROUP BY 1")
def corner_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.corner_means(pixels(spark, sf_dir), "frame", 4, 4)


@plan(f"""WITH {KEYED}, m AS (SELECT k.frame, k.x, k.y, any_value(k.r) AS r, any_value(k.g) AS g, any_value(k.b) AS b, any_value(k.a) AS a, min(n.a) AS least FROM keyed k JOIN keyed n ON n.frame = k.frame AND abs(n.x - k.x) <= 2 AND abs(n.y - k.y) <= 2 GROUP BY 1, 2, 3),
 e AS (SELECT *, least(255, g - greatest(0, r, b)) AS excess FROM m) SELECT frame, x, y, r, CASE WHEN a > 0 AND excess > 0 AND least < 255 THEN round_even(g - excess * 0.4::DOUBLE, 0)::INT ELSE g END AS g, b, a FROM e""")
def suppressed_spill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Green taken out of the edges of mattes, two fifths of what is too much."""
    return op.suppressed_spill(keyed(spark, sf_dir), "frame", (0, 255, 0), 8)


@plan(f"""WITH {KEYED}, c AS (SELECT k.frame, k.x, k.y, min(greatest(abs(n.x - k.x), abs(n.y - k.y))) AS d FROM keyed k LEFT JOIN keyed n ON n.frame = k.frame AND n.a = 0 WHERE k.a > 0 GROUP BY 1, 2, 3),
 e AS (SELECT frame, x, y, least(coalesce(d, 99), x + 1, y + 1, 4 - x, 4 - y) AS d FROM c) SELECT frame, x, y, CASE WHEN d <= 1 THEN d END::INT AS distance FROM e""")
def inner_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.inner_distances(keyed(spark, sf_dir), "frame", 4, 4, 1)


_BACK = [(0, 255, 0), (255, 0, 255), (0, 255, 255), (255, 128, 0)]
_NEAR = lambda c, n: f"greatest(abs(r - {c[0]}), abs(g - {c[1]}), abs(b - {c[2]})) < {n}"


@plan(f"WITH {PIXELS}, n AS (SELECT frame, {', '.join(f'count(*) FILTER (a > 0 AND {_NEAR(c, 90)}) AS n{i}' for i, c in enumerate(_BACK))} FROM pixels GROUP BY 1) SELECT frame, CASE least(n0, n1, n2, n3) WHEN n0 THEN 0 WHEN n1 THEN 1 WHEN n2 THEN 2 ELSE 3 END AS background FROM n")
def completion_backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.completion_backgrounds(pixels(spark, sf_dir), "frame", _BACK)


@plan(f"WITH {PIXELS} SELECT frame, x, y, {', '.join(f'CASE WHEN {_NEAR((128, 128, 128), 80)} THEN 0 ELSE {c} END::INT AS {c}' for c in 'rgba')} FROM pixels")
def removed_backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.without_background(pixels(spark, sf_dir), (128, 128, 128))


@plan(f"""WITH {KEYED}, s AS (SELECT frame // 25 AS sheet, frame, x, y, r, g, b, CASE WHEN x > 0 THEN a ELSE 0 END AS a FROM keyed), b AS (SELECT sheet, min(x) l, min(y) t, max(x) + 1 - min(x) AS cw, max(y) + 1 - min(y) AS ch FROM s WHERE a > 0 GROUP BY 1),
 o AS (SELECT *, greatest(1, floor(cw * least(1.0::DOUBLE, 2.0::DOUBLE / cw, 2.0::DOUBLE / ch) + 0.5))::INT AS ow, greatest(1, floor(ch * least(1.0::DOUBLE, 2.0::DOUBLE / cw, 2.0::DOUBLE / ch) + 0.5))::INT AS oh FROM b),
 g AS (SELECT sheet, u, v, l + u * cw // ow AS x0, l + (u + 1) * cw // ow AS x1, t + v * ch // oh AS y0, t + (v + 1) * ch // oh AS y1 FROM (SELECT *, unnest(range(0, ow)) AS u FROM o) p, (SELECT sheet AS sh, unnest(range(0, oh)) AS v FROM o) q WHERE sh = sheet)
 SELECT s.sheet, s.frame, g.u::INT AS x, g.v::INT AS y, {', '.join(f'floor(avg(CASE WHEN a > 0 THEN {c} ELSE 0 END) + 0.5)::INT AS {c}' for c in 'rgba')} FROM s JOIN g ON s.sheet = g.sheet AND s.x >= x0 AND s.x < x1 AND s.y >= y0 AND s.y < y1 GROUP BY ALL""")
def comparison_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of 25 frames whose first column is clear, cut to 3 x 4 pixels and shrunk to 2 x 2."""
    p = keyed(spark, sf_dir).withColumns({"sheet": F.floor(F.col("frame") / 25), "a": F.when(F.col("x") > 0, F.col("a")).otherwise(0)})
    return op.comparison_samples(p, "sheet", "frame", 2)


_BOY = [(0x0F, 0x38, 0x0F), (0x30, 0x62, 0x30), (0x8B, 0xAC, 0x0F), (0x9B, 0xBC, 0x0F)]


@plan(f"""WITH {PIXELS}, d AS (SELECT frame, (x // 2)::INT AS x, (y // 2)::INT AS y, {', '.join(f'CASE WHEN sum(a) > 0 THEN floor(sum({c} * a) / sum(a) + 0.5) ELSE 0 END::INT AS {c}' for c in 'rgb')}, CASE WHEN floor(avg(a) + 0.5) > 100 THEN 255 ELSE 0 END AS a FROM pixels GROUP BY 1, 2, 3),
 n AS (SELECT d.*, i, pr, pg, pb, (r - pr) ** 2 + (g - pg) ** 2 + (b - pb) ** 2 AS e FROM d, (VALUES {', '.join(f'({i}, {r}, {g}, {b})' for i, (r, g, b) in enumerate(_BOY))}) pal(i, pr, pg, pb)),
 m AS (SELECT frame, x, y, any_value(a) AS a, any_value(r) AS r, any_value(g) AS g, any_value(b) AS b, arg_min(pr, e * 10 + i) AS nr, arg_min(pg, e * 10 + i) AS ng, arg_min(pb, e * 10 + i) AS nb FROM n GROUP BY 1, 2, 3)
 SELECT frame, x, y, CASE WHEN a > 0 THEN nr ELSE r END AS r, CASE WHEN a > 0 THEN ng ELSE g END AS g, CASE WHEN a > 0 THEN nb ELSE b END AS b, a FROM m""")
def pixelated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.pixelated(pixels(spark, sf_dir), "frame", 2, _BOY, 100)

"""Queries of palettes, colour space and blending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import scalars
from rasterloom.operators import colour
from rasterloom.plans.registry import plan
from rasterloom.plans.relations import KEYED, PIXELS, SHEET, keyed, pixels

_COLOURS = PIXELS + ", col AS (SELECT DISTINCT r, g, b FROM pixels)"
_LIN = lambda c: f"CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92::DOUBLE ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055::DOUBLE, 2.4) END"


@plan(f"""WITH {_COLOURS}, lin AS (SELECT r, g, b, ({_LIN('r')})::DOUBLE AS x, ({_LIN('g')})::DOUBLE AS y, ({_LIN('b')})::DOUBLE AS z FROM col),
 lms AS (SELECT r, g, b, cbrt(0.4122214708::DOUBLE * x + 0.5363325363::DOUBLE * y + 0.0514459929::DOUBLE * z) AS l, cbrt(0.2119034982::DOUBLE * x + 0.6806995451::DOUBLE * y + 0.1073969566::DOUBLE * z) AS m, cbrt(0.0883024619::DOUBLE * x + 0.2817188376::DOUBLE * y + 0.6299787005::DOUBLE * z) AS s FROM lin),
 lab AS (SELECT r, g, b, 0.2104542553::DOUBLE * l + 0.7936177850::DOUBLE * m - 0.0040720468::DOUBLE * s AS li, 1.9779984951::DOUBLE * l - 2.4285922050::DOUBLE * m + 0.4505937099::DOUBLE * s AS u, 0.0259040371::DOUBLE * l + 0.7827717662::DOUBLE * m - 0.8086757660::DOUBLE * s AS v FROM lms),
 lch AS (SELECT r, g, b, li, sqrt(u * u + v * v) AS c, degrees(atan2(v, u)) AS h FROM lab)
 SELECT r, g, b, round(li, 6) AS l, round(c, 6) AS c, CASE WHEN c > 0.001 THEN round(CASE WHEN h < 0 THEN h + 360 ELSE h END, 4) END AS h FROM lch""")
def oklch_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pixels(spark, sf_dir).select("r", "g", "b").distinct()
    lightness, chroma, hue = scalars.oklch(F.col("r"), F.col("g"), F.col("b"))
    return found.select("r", "g", "b", F.round(lightness, 6).alias("l"), F.round(chroma, 6).alias("c"), F.when(chroma > 0.001, F.round(hue, 4)).alias("h"))


@plan(f"WITH {_COLOURS}, h AS (SELECT r, g, b, '#' || lower(lpad(to_hex(r), 2, '0') || lpad(to_hex(g), 2, '0') || lpad(to_hex(b), 2, '0')) AS hex FROM col) SELECT hex, r, g, b FROM h")
def hex_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To hex text and back."""
    found = pixels(spark, sf_dir).select(scalars.hex_rgb(F.col("r"), F.col("g"), F.col("b")).alias("hex")).distinct()
    return found.select("hex", *[c.alias(n) for c, n in zip(scalars.from_hex(F.col("hex"), 255), "rgb", strict=True)])


_POP = f"{KEYED}, pop AS (SELECT frame, r * 65536 + g * 256 + b AS rgb, count(*) AS n, min(y * 4 + x) AS first FROM keyed WHERE a > 0 GROUP BY 1, 2)"


@plan(f"WITH {_POP} SELECT frame, rgb, n, (row_number() OVER (PARTITION BY frame ORDER BY n DESC, first, rgb) - 1)::INT AS rank FROM pop")
def colour_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All colours of every frame, by population."""
    return colour.extracted(keyed(spark, sf_dir), "frame", None)


@plan()
def palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame's palette; those of more than eight colours by median cut, which SQL cannot say."""
    return colour.palette(keyed(spark, sf_dir), "frame", 8)


_PALETTE = [(0, 0, 0), (255, 255, 255), (128, 128, 128), (160, 100, 60), (60, 100, 160), (110, 140, 110)]
_PAL_SQL = "pal(i, pr, pg, pb) AS (VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(_PALETTE)) + ")"


@plan(f"""WITH {_POP}, {_PAL_SQL}, col AS (SELECT DISTINCT rgb FROM pop), d AS (SELECT rgb, i, ((rgb >> 16) - pr) ** 2 + ((rgb >> 8 & 255) - pg) ** 2 + ((rgb & 255) - pb) ** 2 AS d FROM col, pal),
 t AS (SELECT rgb, arg_min(i, d * 100 + i)::INT AS "to" FROM d GROUP BY 1) SELECT frame, rgb, n, "to" FROM pop JOIN t USING (rgb)""")
def palette_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours to their nearest in a palette: found once for each distinct colour of a frame, not for each pixel."""
    return colour.nearest(colour.populations(keyed(spark, sf_dir), "frame"), _PALETTE).select("frame", "rgb", "n", "to")


@plan(f"WITH {_POP}, col AS (SELECT DISTINCT rgb FROM pop), p AS (SELECT x.rgb AS a, y.rgb AS b, ((x.rgb >> 16) - (y.rgb >> 16)) ** 2 + ((x.rgb >> 8 & 255) - (y.rgb >> 8 & 255)) ** 2 + ((x.rgb & 255) - (y.rgb & 255)) ** 2 AS d FROM col x JOIN col y ON x.rgb < y.rgb) SELECT a, b, d::INT AS d2 FROM p WHERE d <= 9")
def near_duplicate_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    colours = colour.populations(keyed(spark, sf_dir), "frame").select("rgb").distinct()
    return colour.near_duplicates(colours, 3.0)


@plan(f"WITH {PIXELS} SELECT frame // {SHEET} AS sheet, count(DISTINCT r * 65536 + g * 256 + b) AS colours, median(r)::DOUBLE AS median_r, round(avg(g), 6) AS mean_g FROM pixels GROUP BY 1")
def colour_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    return p.groupBy(F.floor(F.col("frame") / SHEET).alias("sheet")).agg(F.count_distinct(scalars.packed_rgb(F.col("r"), F.col("g"), F.col("b"))).alias("colours"), F.median("r").alias("median_r"), F.round(F.avg("g"), 6).alias("mean_g"))


@plan(f"WITH {PIXELS}, h AS (SELECT frame, sum(sin(radians(r * 360 / 256.0::DOUBLE))) AS s, sum(cos(radians(r * 360 / 256.0::DOUBLE))) AS c FROM pixels GROUP BY 1), d AS (SELECT frame, degrees(atan2(s, c)) AS h FROM h) SELECT frame, round(CASE WHEN h < 0 THEN h + 360 ELSE h END, 5) AS hue FROM d")
def circular_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = F.radians(F.col("r") * 360 / 256)
    mean = F.degrees(F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle))))
    return pixels(spark, sf_dir).groupBy("frame").agg(mean.alias("h")).select("frame", F.round(F.when(F.col("h") < 0, F.col("h") + 360).otherwise(F.col("h")), 5).alias("hue"))


_MODES = ("normal", "multiply", "screen", "overlay", "darken", "lighten", "dodge", "burn", "hard-light", "difference", "exclusion", "addition", "subtract", "divide", "soft-light")


def _mul(a: str, b: str) -> str:
    return f"(((({a}) * ({b}) + 128) >> 8) + ({a}) * ({b}) + 128) >> 8"


def _blend_sql(mode: str, b: str, s: str) -> str:
    screen = lambda x, y: f"({x} + {y} - ({_mul(x, y)}))"
    hard = lambda x, y: f"CASE WHEN {y} < 128 THEN ({_mul(x, f'{y} * 2')}) ELSE {screen(x, f'({y} * 2 - 255)')} END"
    div = lambda x, y: f"((({x}) * 255 + ({y}) // 2) // ({y}))"
    return {
        "normal": s, "multiply": f"({_mul(b, s)})", "screen": screen(b, s), "overlay": hard(s, b), "darken": f"least({b}, {s})", "lighten": f"greatest({b}, {s})",
        "dodge": f"CASE WHEN {b} = 0 THEN 0 WHEN {b} >= 255 - {s} THEN 255 ELSE {div(b, f'255 - {s}')} END",
        "burn": f"CASE WHEN {b} = 255 THEN 255 WHEN 255 - {b} >= {s} THEN 0 ELSE 255 - {div(f'255 - {b}', s)} END",
        "hard-light": hard(b, s), "difference": f"abs({b} - {s})", "exclusion": f"({b} + {s} - 2 * ({_mul(b, s)}))", "addition": f"least({b} + {s}, 255)", "subtract": f"greatest({b} - {s}, 0)",
        "soft-light": f"floor(CASE WHEN {s} / 255 <= 0.5 THEN {b} / 255 - (1 - 2 * ({s} / 255)) * ({b} / 255) * (1 - {b} / 255) ELSE {b} / 255 + (2 * ({s} / 255) - 1) * (CASE WHEN {b} / 255 <= 0.25 THEN ((16 * ({b} / 255) - 12) * ({b} / 255) + 4) * ({b} / 255) ELSE sqrt({b} / 255) END - {b} / 255) END * 255 + 0.5)::INT",
        "divide": f"CASE WHEN {b} = 0 THEN 0 WHEN {b} >= {s} THEN 255 ELSE {div(b, s)} END",
    }[mode]


def _over_sql() -> str:
    parts = []
    for m in _MODES:
        own = {c: _blend_sql(m, f"b.{c}", f"s.{c}") for c in "rgb"}
        sa = f"({_mul('s.a', '200')})"
        ra = f"({sa} + b.a - ({_mul('b.a', sa)}))"
        cols = ", ".join(f"CASE WHEN b.a = 0 THEN {own[c]} WHEN s.a = 0 THEN b.{c} ELSE b.{c} + trunc((({own[c]}) - b.{c}) * {sa} / ({ra})::DOUBLE) END::INT AS {c}" for c in "rgb")
        parts.append(f"SELECT '{m}' AS mode, b.frame, b.x, b.y, {cols}, CASE WHEN b.a = 0 THEN {sa} WHEN s.a = 0 THEN b.a ELSE {ra} END::INT AS a FROM pixels b JOIN pixels s ON s.frame = b.frame + 1 AND s.x = b.x AND s.y = b.y")
    return f"WITH {PIXELS} " + " UNION ALL ".join(parts)


@plan(_over_sql())
def blend_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame is a backdrop and the one after it a layer on it, in fifteen modes at an opacity of 200."""
    p = pixels(spark, sf_dir)
    return _blended(p, p)


def _blended(backdrops: DataFrame, p: DataFrame) -> DataFrame:
    base = backdrops.select("frame", "x", "y", *[F.col(c).alias(f"b{c}") for c in "rgba"])
    top = p.select((F.col("frame") - 1).alias("frame"), "x", "y", *[F.col(c).alias(f"s{c}") for c in "rgba"])
    both = base.join(top, ["frame", "x", "y"])
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), *[colour.blended(m, F.col(f"b{c}"), F.col(f"s{c}")).cast("int").alias(f"o{c}") for c in "rgb"]) for m in _MODES])
    each = both.select("frame", "x", "y", "br", "bg", "bb", "ba", "sa", F.inline(rows))
    done = colour.over(F.lit(200), {c: F.col(f"b{c}") for c in "rgba"}, {**{c: F.col(f"o{c}") for c in "rgb"}, "a": F.col("sa")})
    return each.select("mode", "frame", "x", "y", *[v.alias(k) for k, v in done.items()])


_LUM = lambda c: f"(0.3::DOUBLE * {c[0]} + 0.59::DOUBLE * {c[1]} + 0.11::DOUBLE * {c[2]})"


def _hsl_sql() -> str:
    """One chain of common tables a mode: the chosen triple, its lightness set, clipped below and above."""
    start = {
        "hue": ("CASE WHEN ss > 0 THEN (s{c} - sl) * bs / ss ELSE 0 END", "bl"), "saturation": ("CASE WHEN bs > 0 THEN (b{c} - bl0) * ss / bs ELSE 0 END", "bl"),
        "color": ("s{c}", "bl"), "luminosity": ("b{c}", "sll"),
    }
    parts = []
    for mode, (term, light) in start.items():
        one = ", ".join(f"({term.format(c=c)})::DOUBLE AS c{c}" for c in "rgb")
        parts.append(f"""SELECT '{mode}' AS mode, frame, x, y, ba, sa, pr, pg, pb, {', '.join(f"(CASE WHEN isnan(q{c}) THEN 0 ELSE trunc(q{c} * 255)::INT & 255 END) AS q{c}" for c in 'rgb')} FROM (
 SELECT *, {', '.join(f"CASE WHEN hi > 1 THEN l + (e{c} - l) * (1 - l) / (hi - l) ELSE e{c} END AS q{c}" for c in 'rgb')} FROM (
 SELECT *, {', '.join(f"CASE WHEN lo < 0 THEN l + (d{c} - l) * l / (l - lo) ELSE d{c} END AS e{c}" for c in 'rgb')} FROM (
 SELECT *, {_LUM(['dr', 'dg', 'db'])} AS l, least(dr, dg, db) AS lo, greatest(dr, dg, db) AS hi FROM (
 SELECT *, {', '.join(f"c{c} + ({light} - {_LUM(['cr', 'cg', 'cb'])}) AS d{c}" for c in 'rgb')} FROM (SELECT *, {one} FROM t)))))""")
    sa = f"({_mul('sa', '200')})"
    ra = f"({sa} + ba - ({_mul('ba', sa)}))"
    cols = ", ".join(f"CASE WHEN ba = 0 THEN q{c} WHEN sa = 0 THEN p{c} ELSE p{c} + trunc((q{c} - p{c}) * {sa} / ({ra})::DOUBLE) END::INT AS {c}" for c in "rgb")
    return f"""WITH {PIXELS}, t AS (SELECT *, least(sr, sg, sb) AS sl, greatest(sr, sg, sb) - least(sr, sg, sb) AS ss, least(br, bg, bb) AS bl0, greatest(br, bg, bb) - least(br, bg, bb) AS bs, {_LUM(['br', 'bg', 'bb'])} AS bl, {_LUM(['sr', 'sg', 'sb'])} AS sll FROM (
 SELECT b.frame, b.x, b.y, b.a AS ba, s.a AS sa, b.r AS pr, b.g AS pg, b.b AS pb, {', '.join(f'b.{c} / 255.0::DOUBLE AS b{c}, s.{c} / 255.0::DOUBLE AS s{c}' for c in 'rgb')} FROM pixels b JOIN pixels s ON s.frame = b.frame + 1 AND s.x = b.x AND s.y = b.y))
 SELECT mode, frame, x, y, {cols}, CASE WHEN ba = 0 THEN {sa} WHEN sa = 0 THEN ba ELSE {ra} END::INT AS a FROM ({' UNION ALL '.join(parts)})"""


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    top = p.select((F.col("frame") - 1).alias("frame"), "x", "y", *[F.col(c).alias(f"s{c}") for c in "rgba"])
    return p.select("frame", "x", "y", *[F.col(c).alias(f"b{c}") for c in "rgba"]).join(top, ["frame", "x", "y"])


@plan(_hsl_sql())
def hsl_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame and the one after it on it in the four modes of whole triples, at an opacity of 200."""
    both = _neighbours(spark, sf_dir)
    b, s = ({c: F.col(f"{p}{c}") for c in "rgba"} for p in "bs")
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), colour.hsl_blended(m, b, s).alias("o")) for m in ("hue", "saturation", "color", "luminosity")])
    each = both.select("*", F.inline(rows))
    done = colour.over(F.lit(200), b, {**{c: F.col(f"o.{c}") for c in "rgb"}, "a": F.col("sa")})
    return each.select("mode", "frame", "x", "y", *[v.alias(k) for k, v in done.items()])


_SHIFT = lambda c: f"(b{c} + (((((s{c} - b{c}) * 90 + 128) >> 8) + (s{c} - b{c}) * 90 + 128) >> 8))"


@plan(f"""WITH {PIXELS}, t AS (SELECT b.frame, b.x, b.y, {', '.join(f'b.{c} AS b{c}, s.{c} AS s{c}' for c in 'rgba')} FROM pixels b JOIN pixels s ON s.frame = b.frame + 1 AND s.x = b.x AND s.y = b.y), u AS (SELECT *, {_SHIFT('a')} AS ra FROM t)
 SELECT frame, x, y, {', '.join(f"CASE WHEN ra = 0 THEN 0 WHEN ba = 0 THEN s{c} WHEN sa = 0 THEN b{c} ELSE {_SHIFT(c)} END::INT AS {c}" for c in 'rgb')}, ra::INT AS a FROM u""")
def merged_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, s = ({c: F.col(f"{p}{c}") for c in "rgba"} for p in "bs")
    return _neighbours(spark, sf_dir).select("frame", "x", "y", *[v.alias(k) for k, v in colour.merged(F.lit(90), b, s).items()])


@plan()
def composited_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four frames as the layers of one, in four modes and opacities, of which one is drawn later by its z."""
    layer = (F.col("frame") % 4).cast("int")
    mode = F.get(F.array(*map(F.lit, ["normal", "multiply", "screen", "overlay"])), layer)
    cels = pixels(spark, sf_dir).select(F.floor(F.col("frame") / 4).alias("sprite"), "x", "y", layer.alias("layer"), F.when(layer == 1, 2).otherwise(0).alias("z"), mode.alias("mode"), (F.lit(255) - layer * 40).alias("opacity"), *"rgba")
    return colour.composited(cels, "sprite")


@plan(f"""WITH {KEYED}, n AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY y, x) - 1 AS i FROM keyed WHERE a > 0), s AS (SELECT * FROM n WHERE i % 3 = 0), {_PAL_SQL},
 d AS (SELECT frame, s.i, min((r - pr) ** 2 + (g - pg) ** 2 + (b - pb) ** 2) AS d FROM s, pal GROUP BY 1, 2) SELECT frame, round(avg(sqrt(d)), 6) AS error FROM d GROUP BY 1""")
def palette_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = keyed(spark, sf_dir)
    palette = p.select("frame").distinct().select("frame", F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("rgb", q, strict=True)]) for q in _PALETTE])))
    return colour.palette_error(p, "frame", palette, 3).select("frame", F.round("error", 6).alias("error"))


@plan()
def median_cut_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return colour.median_cut(keyed(spark, sf_dir), "frame", 4)


def _ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = colour.populations(keyed(spark, sf_dir), "frame").select("frame", "rgb")
    lightness, chroma, hue = scalars.oklch(*scalars.unpacked_rgb(F.col("rgb")))
    return colour.ramps(found.select("frame", "rgb", lightness.alias("l"), chroma.alias("c"), hue.alias("h")), "frame")


@plan()
def colour_ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ramps(spark, sf_dir)


@plan()
def remapped_ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's first ramp on a base of orange."""
    found = _ramps(spark, sf_dir)
    return colour.remapped_ramps(found, "frame", found.where("ramp = 0 and anchor").select("frame", "ramp", F.lit(0xE08030).alias("base")))


@plan(f"WITH {_COLOURS}, t(deg) AS (VALUES (0.0), (90.0), (180.0), (270.0), (360.0)) SELECT 'hue' || lpad((deg % 360)::INT::VARCHAR, 3, '0') AS name, count(*) AS colours, count(*) FILTER (deg % 360 = 0) AS same FROM col, t WHERE deg < 360 GROUP BY 1")
def hue_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four turns of all colours; the one of no degrees leaves every colour as it is."""
    found = pixels(spark, sf_dir).select("r", "g", "b").distinct()
    each = found.withColumn("deg", F.explode(F.array(*[F.lit(90.0 * i) for i in range(4)])))
    turned = scalars.rotated(F.col("r"), F.col("g"), F.col("b"), F.col("deg"))
    each = each.withColumn("kept", turned == F.struct("r", "g", "b"))
    name = F.concat(F.lit("hue"), F.lpad(F.col("deg").cast("int").cast("string"), 3, "0"))
    return each.groupBy(name.alias("name")).agg(F.count("*").alias("colours"), F.count_if((F.col("deg") == 0) & F.col("kept")).alias("same"))


@plan()
def dithered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return colour.dithered(pixels(spark, sf_dir), "frame", _PALETTE)

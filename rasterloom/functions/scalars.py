"""Column functions with the rounding and colour rules of the raster model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB and OKLab conversion (public, B. Ottosson 2020).
_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def round_half_up(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def stored_byte(x: Column) -> Column:
    """A real number as a stored channel: clamped to 0..255, halves to even."""
    return F.bround(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0))).cast("int")


def packed_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def unpacked_rgb(rgb: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(rgb, 16).bitwiseAND(255), F.shiftright(rgb, 8).bitwiseAND(255), rgb.bitwiseAND(255)


def distance_sq(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """The squared Euclidean distance of two colours."""
    d = [x - y for x, y in zip(a, b, strict=True)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def hex_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(c)), 2, "0") for c in (r, g, b)])


def from_hex(text: Column, fallback: int) -> tuple[Column, Column, Column]:
    """Channels of #rrggbb or rrggbb; else every channel is the fallback."""
    digits = F.regexp_extract(F.lower(text), r"^#?([0-9a-f]{6})$", 1)
    return tuple(F.when(digits == "", fallback).otherwise(F.conv(F.substring(digits, 1 + 2 * i, 2), 16, 10).cast("int")) for i in range(3))


def _linear(c: Column) -> Column:
    v = c / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    rgb = [_linear(c) for c in (r, g, b)]
    lms = [F.cbrt(rgb[0] * m[0] + rgb[1] * m[1] + rgb[2] * m[2]) for m in _LMS]
    return tuple(lms[0] * m[0] + lms[1] * m[1] + lms[2] * m[2] for m in _LAB)


def oklch(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """(lightness, chroma, hue in degrees from 0)."""
    lightness, u, v = oklab(r, g, b)
    hue = F.degrees(F.atan2(v, u))
    return lightness, F.sqrt(u * u + v * v), F.when(hue < 0, hue + 360).otherwise(hue)


def hue_distance(a: Column, b: Column) -> Column:
    """The shorter way round, 0..180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360 - d)


def luminance(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Rec. 709 lightness of a pixel, 0..1, times its alpha."""
    return (r * 0.2126 + g * 0.7152 + b * 0.0722) / 255 * (a / 255)


def fps_to_ms(fps: Column) -> Column:
    """Milliseconds a frame; rates below 1, null or not a number count as 1."""
    safe = F.when(fps.isNull() | F.isnan(fps) | F.abs(fps).eqNullSafe(F.lit(float("inf"))), 1.0).otherwise(F.greatest(fps, F.lit(1.0)))
    return round_half_up(1000 / safe).cast("int")


def gif_delay(ms: Column) -> Column:
    """The nearest multiple of 10 ms, at least 20."""
    return F.greatest(F.lit(20), round_half_up(ms / 10).cast("int") * 10)


def mul_un8(a: Column, b: Column) -> Column:
    """a * b / 255 with 8-bit rounding."""
    t = a * b + 128
    return F.shiftright(F.shiftright(t, 8) + t, 8)


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def slug(name: Column) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def money(micros: Column) -> Column:
    """US dollars of a number of millionths, with two to six decimals."""
    text = F.format_number(micros / 1_000_000, 6)
    trimmed = F.regexp_replace(text, "(\\.\\d\\d\\d*?)0+$", "$1")
    return F.when(micros < 0, F.concat(F.lit("-$"), F.substring(trimmed, 2, 40))).otherwise(F.concat(F.lit("$"), trimmed))


def hue_delta(a: Column, b: Column) -> Column:
    """The shorter way from one hue to another, -180 (not itself) to 180."""
    d = F.pmod(b - a, F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def wrapped_angle(degrees: Column) -> Column:
    """The same angle, -180 to 180 (not itself)."""
    return F.pmod(degrees + 180, F.lit(360.0)) - 180


# OKLab to linear sRGB (public, B. Ottosson 2020).
_FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
_FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def _linear_of(lightness: Column, chroma: Column, cos: Column, sin: Column) -> list[Column]:
    lms = [lightness * k + chroma * cos * u + chroma * sin * v for k, u, v in _FROM_LAB]
    cubes = [x * x * x for x in lms]
    return [cubes[0] * a + cubes[1] * b + cubes[2] * c for a, b, c in _FROM_LMS]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def oklch_rgb(lightness: Column, chroma: Column, hue: Column) -> Column:
    """(r, g, b) of 8 bits of a colour. Outside sRGB, its chroma is halved in on the edge in 24 steps; lightness and hue stay."""
    angle = F.radians(F.pmod(hue, F.lit(360.0)))

    def inside(v: Column, at: Column) -> Column:
        out = F.lit(True)
        for x in _linear_of(v["l"], at, v["cos"], v["sin"]):
            out = out & x.between(-1e-6, 1 + 1e-6)
        return out

    def halved(v: Column) -> Callable[[Column, Column], Column]:
        def step(s: Column, _: Column) -> Column:
            middle = (s["lo"] + s["hi"]) / 2
            return let(F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), middle.alias("mid"), inside(v, middle).alias("ok")), lambda t: F.struct(F.when(t["ok"], t["mid"]).otherwise(t["lo"]).alias("lo"), F.when(t["ok"], t["hi"]).otherwise(t["mid"]).alias("hi")))

        return step

    def kept(v: Column) -> Column:
        edge = F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.struct(F.lit(0.0).alias("lo"), v["c"].alias("hi")), halved(v), lambda s: s["lo"])
        return F.struct(v["l"].alias("l"), F.when(inside(v, v["c"]), v["c"]).otherwise(edge).alias("c"), v["cos"].alias("cos"), v["sin"].alias("sin"))

    def stored(v: Column) -> Column:
        curve = lambda x: F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(F.greatest(x, F.lit(0.0)), 1 / 2.4) * 1.055 - 0.055)
        byte = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), round_half_up(curve(x) * 255))).cast("int")
        lms = F.array(*[v["l"] * k + v["c"] * v["cos"] * u + v["c"] * v["sin"] * w for k, u, w in _FROM_LAB])
        linear = lambda m: F.array(*[sum((F.get(m, i) * F.get(m, i) * F.get(m, i) * x for i, x in enumerate(row)), F.lit(0.0)) for row in _FROM_LMS])
        return let(lms, lambda m: let(linear(m), lambda x: F.struct(*[byte(F.get(x, i)).alias(n) for i, n in enumerate("rgb")])))

    start = F.struct(lightness.alias("l"), F.greatest(F.lit(0.0), chroma).alias("c"), F.cos(angle).alias("cos"), F.sin(angle).alias("sin"))
    return let(start, lambda v: let(kept(v), stored))


def rotated(r: Column, g: Column, b: Column, degrees: Column) -> Column:
    """(r, g, b) of a colour with its hue turned; a whole turn changes nothing."""
    lightness, chroma, hue = oklch(r, g, b)
    coded = F.struct(lightness.alias("l"), chroma.alias("c"), F.coalesce(hue, F.lit(0.0)).alias("h"))
    own = F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))
    return F.when(F.pmod(degrees, F.lit(360.0)) == 0, own).otherwise(let(coded, lambda v: oklch_rgb(v["l"], v["c"], v["h"] + degrees)))

"""Palettes, ramps and layer blending."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scalars import distance_sq, hue_delta, let, mul_un8, oklch, oklch_rgb, packed_rgb, unpacked_rgb


def populations(pixels: DataFrame, *by: str) -> DataFrame:
    """(by.., rgb, n, first): how often each opaque colour occurs and its first place in reading order."""
    return pixels.where("a > 0").groupBy(*by, packed_rgb(F.col("r"), F.col("g"), F.col("b")).alias("rgb")).agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("first"))


def extracted(pixels: DataFrame, by: str, most: int | None) -> DataFrame:
    """(by, rgb, n, rank): the colours of a raster, by population, then by first place; most: only of rasters with up to that many
    distinct ones (the others need a cut, see `palette`)."""
    counts = populations(pixels, by)
    ordered = counts.groupBy(by).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "rgb"))).alias("c"), F.count("*").alias("k"))
    if most is not None:
        ordered = ordered.where(F.col("k") <= most)
    return ordered.select(by, F.posexplode("c").alias("rank", "e")).select(by, "e.rgb", (-F.col("e.m")).alias("n"), "rank")


def palette(pixels: DataFrame, by: str, most: int) -> DataFrame:
    """(by, rgb, n, rank): `extracted`, and median cut without repeated colours (n null) for rasters with more than `most` colours."""
    own = pixels.withColumn(by, F.col(by).cast("long"))
    many = populations(own, by).groupBy(by).agg(F.count("*").alias("k")).where(F.col("k") > most).select(by)
    rgb = packed_rgb(F.col("r"), F.col("g"), F.col("b"))
    cut = median_cut(own.join(many, by, "left_semi"), by, most).groupBy(by, rgb.alias("rgb")).agg(F.min("rank").alias("at"))
    ordered = cut.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("at", "rgb"))).alias("c")).select(by, F.posexplode("c").alias("rank", "e"))
    return extracted(own, by, most).unionByName(ordered.select(by, "e.rgb", F.lit(None).cast("long").alias("n"), "rank"))


def nearest(colours: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """Adds to: the place in the palette of the nearest colour, the first of equals. The palette is a literal of the plan."""
    own = unpacked_rgb(F.col("rgb"))
    costs = F.array(*[F.struct(distance_sq(own, tuple(F.lit(v) for v in p)).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(palette)])
    return colours.withColumn("to", F.array_min(costs)["i"])


def palette_error(pixels: DataFrame, by: str, palette: DataFrame, stride: int = 1) -> DataFrame:
    """(by, error): the mean distance of every stride-th opaque pixel to the nearest colour of the raster's palette (by, r, g, b).

    Distances are taken once for each distinct colour of a raster, against the array of its palette.
    """
    from pyspark.sql import Window as W

    solid = pixels.where("a > 0").withColumn("__i", F.row_number().over(W.partitionBy(by).orderBy("y", "x")) - 1).where(F.col("__i") % stride == 0)
    counts = solid.groupBy(by, "r", "g", "b").agg(F.count("*").alias("n"))
    own = palette.groupBy(by).agg(F.collect_list(F.struct("r", "g", "b")).alias("p"))
    here = tuple(F.col(c) for c in ("r", "g", "b"))
    nearest_ = F.array_min(F.transform("p", lambda p: distance_sq(here, (p["r"], p["g"], p["b"]))))
    return counts.join(own, by).groupBy(by).agg((F.sum(F.sqrt(nearest_.cast("double")) * F.col("n")) / F.sum("n")).alias("error"))


def near_duplicates(colours: DataFrame, distance: float) -> DataFrame:
    """(a, b, d2) of colours (rgb) at most a distance apart: an equi-join on neighbouring cubes of colour space."""
    side = max(1, int(np.ceil(distance)))
    r, g, b = unpacked_rgb(F.col("rgb"))
    cube = lambda dr, dg, db: F.struct((F.floor(r / side) + dr).alias("r"), (F.floor(g / side) + dg).alias("g"), (F.floor(b / side) + db).alias("b"))
    own = colours.select(F.col("rgb").alias("b"), cube(0, 0, 0).alias("cube"))
    around = F.array(*[cube(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    reach = colours.select(F.col("rgb").alias("a"), F.explode(around).alias("cube"))
    pairs = reach.join(own, "cube").where("a < b")
    return pairs.select("a", "b", distance_sq(unpacked_rgb(F.col("a")), unpacked_rgb(F.col("b"))).alias("d2")).where(F.col("d2") <= distance * distance)


def median_cut(pixels: DataFrame, by: str, most: int) -> DataFrame:
    """(by, rank, r, g, b): boxes of colours split at the middle of their widest channel until there are `most`. One raster at a time."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        boxes = [part.loc[part.a > 0].sort_values(["y", "x"])[["r", "g", "b"]].to_numpy()]
        if len(boxes[0]) <= most:  # every pixel is a colour, also of equal ones
            return pd.DataFrame([(part[by].iloc[0], i, *map(int, p)) for i, p in enumerate(boxes[0])], columns=[by, "rank", "r", "g", "b"])
        while len(boxes) < most:
            wide = [(int(np.ptp(b, axis=0).max()), -i) for i, b in enumerate(boxes) if len(b) > 1]
            if not wide or max(wide)[0] == 0:
                break
            i = -max(wide)[1]
            box = boxes.pop(i)
            box = box[np.argsort(box[:, int(np.ptp(box, axis=0).argmax())], kind="stable")]
            boxes[i:i] = [box[: len(box) // 2], box[len(box) // 2 :]]
        means = [np.floor(b.mean(0) + 0.5).astype(int) for b in boxes if len(b)]
        return pd.DataFrame([(part[by].iloc[0], i, *map(int, m)) for i, m in enumerate(means)], columns=[by, "rank", "r", "g", "b"])

    return pixels.groupBy(by).applyInPandas(run, f"{by} long, rank int, r int, g int, b int")


def ramps(colours: DataFrame, by: str, reach: float = 25.0, grey: float = 0.03) -> DataFrame:
    """(by, rgb, ramp, place, anchor, achromatic) of colours (by, rgb, l, c, h): clusters of hue, seeded by the largest chroma.

    A colour joins the cluster whose mean hue is nearest within reach; those of little chroma are a ramp of their own. In a ramp, colours
    go by lightness; its anchor has the largest chroma, of equals the one nearest the median lightness. Ramps are numbered by size, then
    by their anchor's hue and lightness. One raster's colours at a time.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(h=part.h.fillna(0.0))
        grey_ = part[part.c < grey]
        clusters: list[list[tuple]] = []
        sums: list[np.ndarray] = []
        for row in part[part.c >= grey].sort_values(["c", "h", "l"], ascending=[False, True, True]).itertuples(index=False):
            turn = np.radians(row.h)
            gaps = [abs((row.h - np.degrees(np.arctan2(s[0], s[1])) + 180) % 360 - 180) for s in sums]
            i = int(np.argmin(gaps)) if gaps else -1
            if i < 0 or gaps[i] > reach:
                clusters.append([])
                sums.append(np.zeros(2))
                i = len(sums) - 1
            clusters[i].append(row)
            sums[i] += (np.sin(turn), np.cos(turn))
        made = [(c, False) for c in clusters]
        if len(grey_):
            made.append((list(grey_.itertuples(index=False)), True))
        found = []
        for own, achromatic in made:
            own = sorted(own, key=lambda r: r.l)
            middle = np.median([r.l for r in own])
            anchor = min(range(len(own)), key=lambda i: (-own[i].c, abs(own[i].l - middle), i))
            found.append((own, anchor, achromatic))
        found.sort(key=lambda f: (-len(f[0]), f[0][f[1]].h, f[0][f[1]].l))
        rows = [(part[by].iloc[0], r.rgb, n, i, i == anchor, achromatic) for n, (own, anchor, achromatic) in enumerate(found) for i, r in enumerate(own)]
        return pd.DataFrame(rows, columns=[by, "rgb", "ramp", "place", "anchor", "achromatic"])

    return colours.groupBy(by).applyInPandas(run, f"{by} long, rgb int, ramp int, place int, anchor boolean, achromatic boolean")


def remapped_ramps(found: DataFrame, by: str, bases: DataFrame) -> DataFrame:
    """(by, ramp, rgb, to): swaps that give each ramp (as of `ramps`) a new base colour (by, ramp, base).

    Lightness is shifted by what the anchor's is, but the whole ramp stays within 0 and 1; hues turn as the anchor's does; chroma is
    scaled with the anchor's, or shifted for a ramp of greys. Colours that stay are left out, as is a ramp whose anchor is the base.
    """
    coded = lambda c: F.struct(*[x.alias(n) for x, n in zip(oklch(*unpacked_rgb(c)), "lch", strict=True)])
    hue = lambda s: F.coalesce(s["h"], F.lit(0.0))
    own = found.withColumn("own", coded(F.col("rgb")))
    ends = own.groupBy(by, "ramp").agg(F.min("own.l").alias("low"), F.max("own.l").alias("high"), F.max(F.when(F.col("anchor"), F.col("own"))).alias("at"))
    aims = ends.join(bases.select(by, "ramp", coded(F.col("base")).alias("aim")), [by, "ramp"])
    shift = F.greatest(-F.col("low"), F.least(1 - F.col("high"), F.col("aim.l") - F.col("at.l")))
    turn = hue_delta(hue(F.col("at")), hue(F.col("aim")))
    joined = own.join(aims, [by, "ramp"])
    scaled = ~F.col("achromatic") & (F.col("at.c") > 1e-4)
    chroma = F.when(scaled, F.col("own.c") * F.col("aim.c") / F.col("at.c")).otherwise(F.greatest(F.lit(0.0), F.col("own.c") + F.col("aim.c") - F.col("at.c")))
    same = (F.col("aim.l") == F.col("at.l")) & (F.col("aim.c") == F.col("at.c")) & (turn == 0)
    aimed = joined.where(~same).select(by, "ramp", "rgb", oklch_rgb(F.col("own.l") + shift, chroma, hue(F.col("own")) + turn).alias("t"))
    return aimed.select(by, "ramp", "rgb", packed_rgb(F.col("t.r"), F.col("t.g"), F.col("t.b")).alias("to")).where("rgb <> to")


def dithered(pixels: DataFrame, by: str, palette: list[tuple[int, int, int]]) -> DataFrame:
    """(by, x, y, to): Floyd-Steinberg, 7 3 5 1 sixteenths of the error to the right and below. One raster at a time."""
    table = np.array(palette, float)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["y", "x"])
        w, h = int(part.x.max()) + 1, int(part.y.max()) + 1
        image = part[["r", "g", "b"]].to_numpy(float).reshape(h, w, 3)
        chosen = np.zeros((h, w), int)
        for y in range(h):
            for x in range(w):
                chosen[y, x] = int(((table - image[y, x]) ** 2).sum(1).argmin())
                error = image[y, x] - table[chosen[y, x]]
                for dx, dy, share in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                    if 0 <= x + dx < w and y + dy < h:
                        image[y + dy, x + dx] += error * share / 16
        return pd.DataFrame({by: part[by].to_numpy(), "x": part.x.to_numpy(), "y": part.y.to_numpy(), "to": chosen.ravel()})

    return pixels.groupBy(by).applyInPandas(one, f"{by} long, x int, y int, to int")


def _toward_zero(a: Column, b: Column) -> Column:
    q = a / b
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("int")


def _divided(a: Column, b: Column) -> Column:
    return F.floor((a * 255 + F.floor(b / 2)) / b).cast("int")


def _soft_light(b: Column, s: Column) -> Column:
    lifted = F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(b))
    value = F.when(s <= 0.5, b - (1 - 2 * s) * b * (1 - b)).otherwise(b + (2 * s - 1) * (lifted - b))
    return F.floor(value * 255 + 0.5)


def blended(mode: str, b: Column, s: Column) -> Column:
    """The value of a channel of a separable mode: backdrop b, source s."""
    screen = lambda x, y: x + y - mul_un8(x, y)
    hard = lambda x, y: F.when(y < 128, mul_un8(x, y * 2)).otherwise(screen(x, y * 2 - 255))
    modes = {
        "normal": lambda: s,
        "multiply": lambda: mul_un8(b, s),
        "screen": lambda: screen(b, s),
        "overlay": lambda: hard(s, b),
        "darken": lambda: F.least(b, s),
        "lighten": lambda: F.greatest(b, s),
        "dodge": lambda: F.when(b == 0, 0).when(b >= 255 - s, 255).otherwise(_divided(b, 255 - s)),
        "burn": lambda: F.when(b == 255, 255).when(255 - b >= s, 0).otherwise(255 - _divided(255 - b, s)),
        "hard-light": lambda: hard(b, s),
        "difference": lambda: F.abs(b - s),
        "exclusion": lambda: b + s - 2 * mul_un8(b, s),
        "addition": lambda: F.least(b + s, F.lit(255)),
        "subtract": lambda: F.greatest(b - s, F.lit(0)),
        "soft-light": lambda: _soft_light(b / 255, s / 255),
        "divide": lambda: F.when(b == 0, 0).when(b >= s, 255).otherwise(_divided(b, s)),
    }
    return modes[mode]()


def over(opacity: Column, b: dict[str, Column], s: dict[str, Column]) -> dict[str, Column]:
    """A source pixel (its colours already those of its mode) on a backdrop: source-over with 8-bit rounding and a truncating divide."""
    sa = mul_un8(s["a"], opacity)
    ra = sa + b["a"] - mul_un8(b["a"], sa)
    out = {c: F.when(b["a"] == 0, s[c]).when(s["a"] == 0, b[c]).otherwise(b[c] + _toward_zero((s[c] - b[c]) * sa, ra)).cast("int") for c in "rgb"}
    out["a"] = F.when(b["a"] == 0, sa).when(s["a"] == 0, b["a"]).otherwise(ra).cast("int")
    return out


def _triple(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def _each(c: Column, f: Callable[[Column], Column]) -> Column:
    return _triple(*[f(c[n]) for n in "xyz"])


def _lum(c: Column) -> Column:
    return F.lit(0.3) * c["x"] + F.lit(0.59) * c["y"] + F.lit(0.11) * c["z"]


def _ends(c: Column) -> tuple[Column, Column]:
    return F.least(c["x"], c["y"], c["z"]), F.greatest(c["x"], c["y"], c["z"])


def _with_lum(c: Column, target: Column) -> Column:
    """A colour moved to a lightness, and pulled toward it where a channel leaves 0..1."""

    def clipped(v: Column) -> Column:
        facts = F.struct(v.alias("c"), _lum(v).alias("l"), _ends(v)[0].alias("low"), _ends(v)[1].alias("high"))
        lifted = lambda t: _each(t["c"], lambda x: F.when(t["low"] < 0, t["l"] + (x - t["l"]) * t["l"] / (t["l"] - t["low"])).otherwise(x))
        lowered = lambda t: _each(t["c"], lambda x: F.when(t["high"] > 1, t["l"] + (x - t["l"]) * (1 - t["l"]) / (t["high"] - t["l"])).otherwise(x))
        return let(facts, lambda t: let(F.struct(lifted(t).alias("c"), t["l"].alias("l"), t["high"].alias("high")), lowered))

    moved = lambda t: _each(t["c"], lambda x: x + t["gap"])
    return let(c, lambda v: let(let(F.struct(v.alias("c"), (target - _lum(v)).alias("gap")), moved), clipped))


def _with_sat(c: Column, target: Column) -> Column:
    facts = lambda v: F.struct(v.alias("c"), _ends(v)[0].alias("low"), (_ends(v)[1] - _ends(v)[0]).alias("span"), target.alias("s"))
    return let(c, lambda v: let(facts(v), lambda t: _each(t["c"], lambda x: F.when(t["span"] > 0, (x - t["low"]) * t["s"] / t["span"]).otherwise(0.0))))


def hsl_blended(mode: str, b: dict[str, Column], s: dict[str, Column]) -> Column:
    """(r, g, b) of a mode of the whole triple: hue, saturation, color or luminosity. Channels are cut off, not rounded."""
    own, top = (_triple(*[p[c] / F.lit(255.0) for c in "rgb"]) for p in (b, s))
    spread = lambda c: _ends(c)[1] - _ends(c)[0]
    made = {
        "hue": lambda t: _with_lum(_with_sat(t["s"], spread(t["b"])), _lum(t["b"])),
        "saturation": lambda t: _with_lum(_with_sat(t["b"], spread(t["s"])), _lum(t["b"])),
        "color": lambda t: _with_lum(t["s"], _lum(t["b"])),
        "luminosity": lambda t: _with_lum(t["b"], _lum(t["s"])),
    }[mode]
    byte = lambda x: F.when(F.isnan(x), 0).otherwise((x * 255).cast("int").bitwiseAND(255))
    return let(F.struct(own.alias("b"), top.alias("s")), lambda t: let(made(t), lambda c: F.struct(*[byte(c[n]).alias(o) for n, o in zip("xyz", "rgb", strict=True)])))


def merged(opacity: Column, b: dict[str, Column], s: dict[str, Column]) -> dict[str, Column]:
    """A backdrop moved to a source by an opacity, on all four channels; nothing where no alpha is left."""
    alpha = b["a"] + mul_un8(s["a"] - b["a"], opacity)
    part = lambda c: F.when(b["a"] == 0, s[c]).when(s["a"] == 0, b[c]).otherwise(b[c] + mul_un8(s[c] - b[c], opacity))
    return {**{c: F.when(alpha == 0, 0).otherwise(part(c)).cast("int") for c in "rgb"}, "a": alpha.cast("int")}


def composited(cels: DataFrame, *by: str) -> DataFrame:
    """(by.., x, y, r, g, b, a): layers drawn on each other, pixel by pixel, from transparency on.

    cels are pixels (by.., x, y, layer, z, mode, opacity, r, g, b, a) already in the place of the canvas; those of opacity or alpha 0 are
    not drawn. The order is by layer + z, then by z, then by layer. `mode` is any of the separable ones.
    """
    drawn = cels.where("opacity > 0 and a > 0")
    step = F.struct((F.col("layer") + F.col("z")).alias("order"), "z", "layer", "mode", "opacity", "r", "g", "b", "a")
    stacks = drawn.groupBy(*by, "x", "y").agg(F.sort_array(F.collect_list(step)).alias("stack"))
    names = ("normal", "multiply", "screen", "overlay", "darken", "lighten", "dodge", "burn", "hard-light", "difference", "exclusion", "addition", "subtract", "divide", "soft-light")

    def drawn_on(below: Column, layer: Column) -> Column:
        b, s = {c: below[c] for c in "rgba"}, {c: layer[c] for c in "rgba"}
        colour = []
        for c in "rgb":
            value = s[c]
            for m in names[1:]:
                value = F.when(layer["mode"] == m, blended(m, b[c], s[c])).otherwise(value)
            colour.append(F.when(b["a"] == 0, s[c]).otherwise(value).cast("int").alias(c))

        def placed(own: Column) -> Column:
            done = over(layer["opacity"], b, {**{c: own[c] for c in "rgb"}, "a": s["a"]})
            return F.struct(*[done[c].alias(c) for c in "rgba"])

        return let(F.struct(*colour), placed)

    nothing = F.struct(*[F.lit(0).alias(c) for c in "rgba"])
    return stacks.select(*by, "x", "y", F.aggregate("stack", nothing, drawn_on).alias("p")).select(*by, "x", "y", *[f"p.{c}" for c in "rgba"])

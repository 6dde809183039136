"""Per-pixel operators over exploded rasters (by, x, y, r, g, b, a).

Neighbourhoods are windows along x and along y within one raster, so every raster must be dense (no pixel missing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.functions.scalars import distance_sq, luminance, round_half_up, stored_byte

RGB = ("r", "g", "b")


def corner_vote(pixels: DataFrame, by: str) -> DataFrame:
    """(by, r, g, b): the colour of most corners; of equals, that of the first corner in reading order."""
    size = pixels.groupBy(by).agg(F.max("x").alias("w"), F.max("y").alias("h"))
    corners = pixels.join(size, by).where("x in (0, w) and y in (0, h)")
    votes = corners.groupBy(by, *RGB).agg(F.count("*").alias("n"), F.min(F.col("y") * 65536 + F.col("x")).alias("first"))
    return votes.groupBy(by).agg(F.min(F.struct(-F.col("n"), "first", *RGB)).alias("v")).select(by, *[f"v.{c}" for c in RGB])


def soft_key(pixels: DataFrame, target: tuple[Column, Column, Column], similarity: float, softness: float) -> DataFrame:
    """Alpha falls to zero where a colour lies within `similarity` of the target, over a ramp of `softness`."""
    d = F.sqrt(distance_sq(tuple(F.col(c) for c in RGB), target).cast("double"))
    ramp = (d - similarity) / softness if softness > 0 else F.lit(1.0)
    alpha = F.when(d < similarity, 0.0).when(d < similarity + softness, ramp).otherwise(1.0)
    return pixels.withColumn("a", stored_byte(F.least(F.col("a").cast("double"), alpha * 255)))


def _rows(by: str) -> W:
    return W.partitionBy(by, "y").orderBy("x")


def _columns(by: str) -> W:
    return W.partitionBy(by, "x").orderBy("y")


def choked(pixels: DataFrame, by: str, radius: int) -> DataFrame:
    """Alpha becomes the least within a square of the radius; two windows, one along each axis."""
    first = pixels.withColumn("__m", F.min("a").over(_rows(by).rowsBetween(-radius, radius)))
    return first.withColumn("a", F.min("__m").over(_columns(by).rowsBetween(-radius, radius))).drop("__m")


def dilated(pixels: DataFrame, by: str, radius: int, least: int = 0) -> DataFrame:
    """Adds near: whether a pixel of more alpha than `least` lies within the square, and solid: whether this one is such."""
    own = pixels.withColumn("solid", F.col("a") > least)
    first = own.withColumn("__m", F.max("solid").over(_rows(by).rowsBetween(-radius, radius)))
    return first.withColumn("near", F.max("__m").over(_columns(by).rowsBetween(-radius, radius))).drop("__m")


def outlined(pixels: DataFrame, by: str, radius: int, colour: tuple[int, int, int]) -> DataFrame:
    """Transparent pixels near solid ones take the colour of an outline."""
    marked = dilated(pixels, by, radius)
    band = F.col("near") & ~F.col("solid")
    return marked.withColumns({**{c: F.when(band, F.lit(v)).otherwise(F.col(c)) for c, v in zip(RGB, colour, strict=True)}, "a": F.when(band, F.lit(255)).otherwise(F.col("a"))}).drop("near", "solid")


def downscaled(pixels: DataFrame, by: str, block: int) -> DataFrame:
    """Blocks of pixels as one: colours weighted by alpha, alpha as the mean."""
    weighted = lambda c: F.when(F.sum("a") > 0, round_half_up(F.sum(F.col(c) * F.col("a")) / F.sum("a"))).otherwise(0).cast("int").alias(c)
    cell = (F.floor(F.col("x") / block).cast("int").alias("x"), F.floor(F.col("y") / block).cast("int").alias("y"))
    return pixels.groupBy(by, *cell).agg(*[weighted(c) for c in RGB], round_half_up(F.avg("a")).cast("int").alias("a"))


def upscaled(pixels: DataFrame, factor: int) -> DataFrame:
    """Every pixel as a square of `factor`."""
    step = F.sequence(F.lit(0), F.lit(factor - 1))
    wide = pixels.withColumn("__dx", F.explode(step)).withColumn("__dy", F.explode(step))
    return wide.withColumns({"x": F.col("x") * factor + F.col("__dx"), "y": F.col("y") * factor + F.col("__dy")}).drop("__dx", "__dy")


def _around(pixels: DataFrame, by: str) -> DataFrame:
    """Adds n: the three rows of three pixels around each, with those at the border repeated beyond it."""
    key = F.when(F.col("a") == 0, F.lit(0)).otherwise(F.shiftleft(F.col("a"), 24).bitwiseOR(F.shiftleft(F.col("r"), 16)).bitwiseOR(F.shiftleft(F.col("g"), 8)).bitwiseOR(F.col("b")))
    own = pixels.withColumn("__p", F.struct(key.alias("k"), *[F.col(c) for c in (*RGB, "a")]))
    across = _rows(by)
    own = own.withColumn("__row", F.array(F.coalesce(F.lag("__p").over(across), "__p"), "__p", F.coalesce(F.lead("__p").over(across), "__p")))
    down = _columns(by)
    return own.withColumn("n", F.array(F.coalesce(F.lag("__row").over(down), "__row"), "__row", F.coalesce(F.lead("__row").over(down), "__row"))).drop("__p", "__row")


def _at(dx: int, dy: int) -> Column:
    return F.col("n")[dy + 1][dx + 1]


def _spread(around: DataFrame, by: str, factor: int, chosen: list[Column]) -> DataFrame:
    """The chosen pixels of a square, in reading order, as pixels of the larger raster."""
    each = around.select(by, "x", "y", F.posexplode(F.array(*chosen)).alias("i", "p"))
    return each.select(by, (F.col("x") * factor + F.col("i") % factor).alias("x"), (F.col("y") * factor + F.floor(F.col("i") / factor)).cast("int").alias("y"), *[F.col(f"p.{c}").alias(c) for c in (*RGB, "a")])


def scale2x(pixels: DataFrame, by: str) -> DataFrame:
    """Twice the size: a corner takes the neighbour that its two sides share, unless opposite sides are equal."""
    e, up, left, right, down = _at(0, 0), _at(0, -1), _at(-1, 0), _at(1, 0), _at(0, 1)
    same = lambda a, b: a["k"] == b["k"]
    edge = ~same(up, down) & ~same(left, right)
    pick = lambda a, b: F.when(edge & same(a, b), b).otherwise(e)
    return _spread(_around(pixels, by), by, 2, [F.when(edge & same(left, up), left).otherwise(e), pick(up, right), F.when(edge & same(left, down), left).otherwise(e), pick(down, right)])


def eagle2x(pixels: DataFrame, by: str) -> DataFrame:
    """Twice the size: a corner takes the colour of the three pixels around it where they agree."""
    e = _at(0, 0)

    def corner(dx: int, dy: int) -> Column:
        side, tip, end = _at(dx, 0), _at(dx, dy), _at(0, dy)
        return F.when((side["k"] == tip["k"]) & (tip["k"] == end["k"]), tip).otherwise(e)

    return _spread(_around(pixels, by), by, 2, [corner(-1, -1), corner(1, -1), corner(-1, 1), corner(1, 1)])


def scale3x(pixels: DataFrame, by: str) -> DataFrame:
    """Three times the size: corners as in scale2x; a side takes its neighbour where one of its corners does and the far corner differs."""
    a, b, c, d, e, f, g, h, i = (_at(x, y) for y in (-1, 0, 1) for x in (-1, 0, 1))
    same = lambda p, q: p["k"] == q["k"]
    edge = ~same(b, h) & ~same(d, f)
    pick = lambda when, p: F.when(edge & when, p).otherwise(e)
    side = lambda p, q, far, r, t, other, take: pick((same(p, q) & ~same(e, far)) | (same(r, t) & ~same(e, other)), take)
    chosen = [pick(same(d, b), d), side(d, b, c, b, f, a, b), pick(same(b, f), f), side(d, b, g, d, h, a, d), e, side(b, f, i, h, f, c, f), pick(same(d, h), d), side(d, h, i, h, f, g, h), pick(same(h, f), f)]
    return _spread(_around(pixels, by), by, 3, chosen)


def solid_fill(pixels: DataFrame, by: str, colour: tuple[int, int, int], similarity: float, softness: float) -> DataFrame:
    """The background (the mean of the corners' colours) becomes a colour, over a ramp; alpha becomes full."""
    size = pixels.groupBy(by).agg(F.max("x").alias("w"), F.max("y").alias("h"))
    corners = pixels.join(size, by).where("x in (0, w) and y in (0, h)")
    mean = corners.groupBy(by).agg(*[round_half_up(F.avg(c)).alias(f"__{c}") for c in RGB])
    joined = pixels.join(mean, by)
    d = F.sqrt(distance_sq(tuple(F.col(c) for c in RGB), tuple(F.col(f"__{c}") for c in RGB)).cast("double"))
    ramp = round_half_up((d - similarity) / softness * 255) if softness > 0 else F.lit(255)
    keep = F.when(d < similarity, 0).when(d < similarity + softness, ramp).otherwise(255) / 255
    filled = {c: stored_byte(F.col(c) * keep + v * (1 - keep)) for c, v in zip(RGB, colour, strict=True)}
    return joined.withColumns({**filled, "a": F.lit(255)}).drop(*[f"__{c}" for c in RGB])


def blurred(pixels: DataFrame, by: str, value: str, radius: int) -> DataFrame:
    """The mean within a square that is cut off at the border, along one axis after the other."""
    first = pixels.withColumn("__m", F.avg(value).over(_rows(by).rowsBetween(-radius, radius)))
    return first.withColumn(value, F.avg("__m").over(_columns(by).rowsBetween(-radius, radius))).drop("__m")


def normals(pixels: DataFrame, by: str, strength: float = 1.0) -> DataFrame:
    """(by, x, y, nx, ny, nz): slopes of the lightness as a unit vector in 0..255, by central differences."""
    h = pixels.withColumn("h", luminance(*[F.col(c) for c in RGB], F.col("a")))
    across, down = _rows(by), _columns(by)
    slope = lambda w: F.coalesce(F.lag("h").over(w), "h") - F.coalesce(F.lead("h").over(w), "h")
    h = h.withColumn("dx", slope(across) * strength).withColumn("dy", slope(down) * strength)
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + 1)
    byte = lambda v: round_half_up((v * 0.5 + 0.5) * 255).cast("int")
    return h.select(by, "x", "y", byte(F.col("dx") / size).alias("nx"), byte(F.col("dy") / size).alias("ny"), byte(1 / size).alias("nz"))


def stretched(pixels: DataFrame, by: str, width: int, height: int, inset: int, to_w: int, to_h: int) -> DataFrame:
    """Nine-slice: the borders keep their size and the middle is resampled by nearest pixel. The maps of the axes are tiny."""

    def axis(length: int, to: int) -> list[int]:
        inner, wide = length - 2 * inset, to - 2 * inset
        return [i if i < inset else length - (to - i) if i >= to - inset else inset + min(inner - 1, (i - inset) * inner // wide) for i in range(to)]

    spark = pixels.sparkSession
    maps = [spark.createDataFrame(list(enumerate(axis(n, to))), f"to_{c} int, {c} int") for c, n, to in (("x", width, to_w), ("y", height, to_h))]
    wide = pixels.join(F.broadcast(maps[0]), "x").join(F.broadcast(maps[1]), "y")
    return wide.select(by, F.col("to_x").alias("x"), F.col("to_y").alias("y"), *RGB, "a")


def extruded(pixels: DataFrame, width: int, height: int, by_px: int) -> DataFrame:
    """Border pixels repeated outwards."""
    reach = lambda c, n: F.when(F.col(c) == 0, F.sequence(F.lit(-by_px), F.lit(0))).when(F.col(c) == n - 1, F.sequence(F.lit(n - 1), F.lit(n - 1 + by_px))).otherwise(F.array(F.col(c)))
    wide = pixels.withColumn("__x", F.explode(reach("x", width))).withColumn("__y", F.explode(reach("y", height)))
    return wide.withColumns({"x": F.col("__x"), "y": F.col("__y")}).drop("__x", "__y")


def edge_counts(pixels: DataFrame, by: str) -> DataFrame:
    """(by, solid, edge): pixels with alpha, and those of them with a transparent pixel next to them inside the raster."""
    across, down = _rows(by), _columns(by)
    clear = lambda c: F.coalesce(c == 0, F.lit(False))
    marked = pixels.withColumn("__h", clear(F.lag("a").over(across)) | clear(F.lead("a").over(across)))
    marked = marked.withColumn("__e", F.col("__h") | clear(F.lag("a").over(down)) | clear(F.lead("a").over(down)))
    return marked.groupBy(by).agg(F.count_if(F.col("a") > 0).alias("solid"), F.count_if((F.col("a") > 0) & F.col("__e")).alias("edge"))


def boxes(pixels: DataFrame, by: str, least: int = 0) -> DataFrame:
    """(by, x0, y0, x1, y1, pixels): the box of pixels of more alpha."""
    return pixels.where(F.col("a") > least).groupBy(by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("pixels"))


def corner_means(pixels: DataFrame, by: str, width: int, height: int) -> DataFrame:
    """(by, r, g, b, a, clear): the mean of the four corners of rasters of one size, and whether it is rather transparent."""
    corners = pixels.where(F.col("x").isin(0, width - 1) & F.col("y").isin(0, height - 1))
    return corners.groupBy(by).agg(*[F.avg(c).alias(c) for c in "rgba"], (F.avg("a") < 128).alias("clear"))


def suppressed_spill(pixels: DataFrame, by: str, key: tuple[int, int, int], spill: float) -> DataFrame:
    """Takes out of a matte's edge what the strong channels of a key colour have more than the others. An edge is a pixel that is not
    opaque or has one within two pixels; grey keys and a spill of 0 change nothing."""
    strong = [v >= max(key) - 16 for v in key]
    if spill <= 0 or max(key) - min(key) < 32:
        return pixels
    near = choked(pixels, by, 2).select(by, "x", "y", F.col("a").alias("least"))
    own = pixels.join(near, [by, "x", "y"])
    others = [F.col(c) for c, s in zip("rgb", strong, strict=True) if not s]
    neutral = F.greatest(F.lit(0), *others) if others else F.lit(0)
    keyed = [F.col(c) for c, s in zip("rgb", strong, strict=True) if s]
    excess = F.least(F.lit(255), *[c - neutral for c in keyed])
    hit = (F.col("a") > 0) & (excess > 0) & (F.col("least") < 255)
    share = min(1.0, spill / 20)
    changed = {c: F.when(hit, stored_byte(F.col(c) - excess * share)).otherwise(F.col(c)) for c, s in zip("rgb", strong, strict=True) if s}
    return own.select(by, "x", "y", *[changed.get(c, F.col(c)).cast("int").alias(c) for c in "rgba"])


def inner_distances(pixels: DataFrame, by: str, width: int, height: int, most: int, eight: bool = True) -> DataFrame:
    """(by, x, y, distance): steps from each solid pixel to the nearest clear one, or out of the raster; null beyond `most`. Steps go to
    four or eight neighbours. A raster's clear places are one array, which is as large as the raster."""
    clear = pixels.where("a = 0").groupBy(by).agg(F.collect_list(F.struct("x", "y")).alias("clear"))
    out = F.least(F.col("x") + 1, F.col("y") + 1, F.lit(width) - F.col("x"), F.lit(height) - F.col("y"))
    gap = lambda p: F.greatest(F.abs(p["x"] - F.col("x")), F.abs(p["y"] - F.col("y"))) if eight else F.abs(p["x"] - F.col("x")) + F.abs(p["y"] - F.col("y"))
    solid = pixels.where("a > 0").join(clear, by, "left")
    found = F.least(out, F.coalesce(F.array_min(F.transform("clear", gap)), out))
    return solid.select(by, "x", "y", F.when(found <= most, found).cast("int").alias("distance"))


def _chebyshev(colour: tuple[int, int, int]) -> Column:
    return F.greatest(*[F.abs(F.col(c) - v) for c, v in zip("rgb", colour, strict=True)])


def completion_backgrounds(pixels: DataFrame, by: str, colours: list[tuple[int, int, int]], near: int = 90) -> DataFrame:
    """(by, background): the place of the colour that the fewest visible pixels are near to, of equals the first."""
    counts = [F.count_if((F.col("a") > 0) & (_chebyshev(c) < near)).alias("n") for c in colours]
    return pixels.groupBy(by).agg(F.array_min(F.array(*[F.struct(n, F.lit(i).alias("i")) for i, n in enumerate(counts)]))["i"].alias("background"))


def without_background(pixels: DataFrame, colour: tuple[int, int, int], near: int = 80) -> DataFrame:
    """Pixels near a colour become nothing."""
    gone = _chebyshev(colour) < near
    return pixels.withColumns({c: F.when(gone, 0).otherwise(F.col(c)).cast("int") for c in "rgba"})


def comparison_samples(pixels: DataFrame, sheet: str, frame: str, most: int) -> DataFrame:
    """(sheet, frame, x, y, r, g, b, a): rasters of a sheet cut to the box of all that is visible in any, and shrunk by means of areas to
    at most `most` on the longer side. A sheet without a visible pixel gives one clear pixel a raster."""
    seen = pixels.where("a > 0").groupBy(sheet).agg(F.min("x").alias("l"), F.min("y").alias("t"), (F.max("x") + 1).alias("r_"), (F.max("y") + 1).alias("b_"))
    width, height = F.col("r_") - F.col("l"), F.col("b_") - F.col("t")
    scale = F.least(F.lit(1.0), F.lit(float(most)) / width, F.lit(float(most)) / height)
    boxes = seen.select(sheet, "l", "t", width.alias("cw"), height.alias("ch"), F.greatest(F.lit(1), round_half_up(width * scale)).cast("int").alias("ow"), F.greatest(F.lit(1), round_half_up(height * scale)).cast("int").alias("oh"))
    # The part of a line: the last one that begins at or before it.
    part = lambda at, n, out: F.ceil((at + 1) * out / n).cast("int") - 1
    own = pixels.join(boxes, sheet, "left")
    inside = own.where((F.col("x") >= F.col("l")) & (F.col("x") < F.col("l") + F.col("cw")) & (F.col("y") >= F.col("t")) & (F.col("y") < F.col("t") + F.col("ch")))
    placed = inside.withColumns({"u": part(F.col("x") - F.col("l"), F.col("cw"), F.col("ow")), "v": part(F.col("y") - F.col("t"), F.col("ch"), F.col("oh"))})
    mean = lambda c: round_half_up(F.avg(F.when(F.col("a") > 0, F.col(c)).otherwise(0))).cast("int").alias(c)
    means = placed.groupBy(sheet, frame, F.col("u").alias("x"), F.col("v").alias("y")).agg(*[mean(c) for c in "rgba"])
    empty = own.where("cw is null").select(sheet, frame, *[F.lit(0).alias(c) for c in ("x", "y", *"rgba")]).distinct()
    return means.unionByName(empty)


def pixelated(pixels: DataFrame, by: str, size: int, palette: list[tuple[int, int, int]], threshold: int = 0) -> DataFrame:
    """Rasters shrunk by means of blocks, made opaque or clear by a threshold of alpha, and mapped to the nearest of a palette."""
    small = downscaled(pixels, by, size)
    if threshold:
        small = small.withColumn("a", F.when(F.col("a") > threshold, 255).otherwise(0))
    own = tuple(F.col(c) for c in "rgb")
    costs = F.array(*[F.struct(distance_sq(own, tuple(F.lit(v) for v in p)).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(palette)])
    best = F.array_min(costs)["i"]
    channel = lambda k: F.get(F.array(*[F.lit(p[k]) for p in palette]), best)
    return small.select(by, "x", "y", *[F.when(F.col("a") > 0, channel(k)).otherwise(F.col(c)).cast("int").alias(c) for k, c in enumerate("rgb")], F.col("a").cast("int").alias("a"))

"""Outlines, hulls, packing and other kernels that follow one raster step by step; each raster is a row or a group of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scalars import round_half_up

Point = tuple[int, int]


def traced(mask: np.ndarray) -> list[Point]:
    """The border of the first shape in reading order, clockwise, from its first pixel; one pixel is a point."""
    spots = np.argwhere(mask)
    if not len(spots):
        return []
    start = (int(spots[0][1]), int(spots[0][0]))
    solid = lambda x, y: 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and bool(mask[y, x])
    ring = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    at, way, out, first = start, 6, [start], None
    for _ in range(4 * mask.size + 8):
        step = next((d for k in range(8) if solid(at[0] + ring[d := (way + 6 + k) % 8][0], at[1] + ring[d][1])), None)
        if step is None:
            return out
        if (at, step) == first:
            return out[:-1]
        first = first or (at, step)
        at, way = (at[0] + ring[step][0], at[1] + ring[step][1]), step
        out.append(at)
    return out


def simplified(points: list[Point], tolerance: float) -> list[Point]:
    """Ramer-Douglas-Peucker on an open line, without recursion."""
    if len(points) < 3:
        return points
    p = np.array(points, float)
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    todo = [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        along, off = p[b] - p[a], p[a + 1 : b] - p[a]
        size = np.hypot(*along)
        far = np.abs(along[0] * off[:, 1] - along[1] * off[:, 0]) / size if size else np.hypot(off[:, 0], off[:, 1])
        i = int(far.argmax())
        if far[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return [q for q, k in zip(points, keep, strict=True) if k]


def hull(points: list[Point]) -> list[Point]:
    """The convex hull, by two chains over the sorted points, without points on its sides."""
    own = sorted(set(points))
    if len(own) < 3:
        return own

    def chain(order: list[Point]) -> list[Point]:
        out: list[Point] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(own) + chain(own[::-1])


def _masks(pixels: DataFrame, by: str) -> DataFrame:
    return pixels.where("a > 0").groupBy(by).agg(F.sort_array(F.collect_list(F.struct("y", "x"))).alias("spots"))


def _per_shape(pixels: DataFrame, by: str, kernel: Callable[[list[Point]], list[Point]], columns: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, i, *p) for key, spots in batch.itertuples(index=False) for i, p in enumerate(kernel([(s["x"], s["y"]) for s in spots]))]
            yield pd.DataFrame(rows, columns=[by, "i", "x", "y"])

    return _masks(pixels, by).mapInPandas(run, columns)


def outlines(pixels: DataFrame, by: str, tolerance: float = 0.0) -> DataFrame:
    """(by, i, x, y): the border of each raster's first shape, simplified."""

    def kernel(spots: list[Point]) -> list[Point]:
        mask = np.zeros((max(y for _, y in spots) + 1, max(x for x, _ in spots) + 1), bool)
        for x, y in spots:
            mask[y, x] = True
        return simplified(traced(mask), tolerance)

    return _per_shape(pixels, by, kernel, f"{by} long, i int, x int, y int")


def hulls(pixels: DataFrame, by: str) -> DataFrame:
    return _per_shape(pixels, by, hull, f"{by} long, i int, x int, y int")


def packed(sizes: list[tuple[int, int, int]], padding: int = 0, most: tuple[int, int] | None = None, power_of_two: bool = False) -> tuple[int, int, dict[int, Point]]:
    """(width, height, place by id) of rectangles (id, w, h) with padding on all sides: the longest sides first, each into the first place
    of a tree of free places that it fits, right before down. Where none is left the sheet grows to the right or down, whichever keeps
    it nearer a square; ValueError where it may not."""
    order = sorted(range(len(sizes)), key=lambda i: -max(sizes[i][1:]))
    if not order:
        return 0, 0, {}
    pad = max(0, int(padding))
    # A place is [x, y, w, h, right, down]; the last two are None while it is free.
    root = [0, 0, sizes[order[0]][1] + 2 * pad, sizes[order[0]][2] + 2 * pad, None, None]
    places: dict[int, Point] = {}

    def found(w: int, h: int) -> list | None:
        todo = [root]
        while todo:
            place = todo.pop()
            if place[4] is not None:
                todo += [place[5], place[4]]
            elif w <= place[2] and h <= place[3]:
                return place
        return None

    def cut(place: list, w: int, h: int) -> Point:
        x, y, pw, ph = place[:4]
        place[4], place[5] = [x + w, y, pw - w, h, None, None], [x, y + h, pw, ph - h, None, None]
        return x, y

    for i in order:
        name, w, h = sizes[i][0], sizes[i][1] + 2 * pad, sizes[i][2] + 2 * pad
        spot = found(w, h)
        if spot is None:
            width, height = root[2], root[3]
            fits = lambda a, b: most is None or (a <= most[0] and b <= most[1])
            right, down = h <= height and fits(width + w, height), w <= width and fits(width, height + h)
            if right and (height >= width + w or not (down and width >= height + h)):
                spot = [width, 0, w, height, None, None]
                root = [0, 0, width + w, height, spot, root]
            elif down:
                spot = [0, height, width, h, None, None]
                root = [0, 0, width, height + h, root, spot]
            else:
                raise ValueError(f"rectangle {name} does not fit")
        x, y = cut(spot, w, h)
        places[name] = (x + pad, y + pad)
    width, height = root[2], root[3]
    if power_of_two:
        width, height = (1 << (n - 1).bit_length() for n in (width, height))
    return width, height, places


def atlases(rects: DataFrame, by: str, padding: int = 0) -> DataFrame:
    """(by, id, x, y, w, h, width, height) of rectangles (by, id, w, h); an atlas is packed in one task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        width, height, places = packed(list(part[["id", "w", "h"]].itertuples(index=False, name=None)), padding)
        return part.assign(x=[places[i][0] for i in part.id], y=[places[i][1] for i in part.id], width=width, height=height)[[by, "id", "x", "y", "w", "h", "width", "height"]]

    return rects.groupBy(by).applyInPandas(run, f"{by} long, id long, x int, y int, w int, h int, width int, height int")


def chamfer(alpha: np.ndarray, solid: int = 10) -> np.ndarray:
    """Each pixel's distance to one of at most `solid` alpha in steps of 3 and 4, over the largest; 1 everywhere where there is none.

    Whole lines at once: the least cost from the line before is taken column by column, and along a line the steps of 3 are a running
    minimum."""
    d = np.where(alpha > solid, 10**9, 0).astype(np.int64)
    w = d.shape[1]
    far, steps = 2 * 10**9, 3 * np.arange(w)

    def swept(d: np.ndarray) -> np.ndarray:
        before = None
        for y in range(len(d)):
            line = d[y]
            if before is not None:
                edge = np.concatenate(([far], before, [far]))
                line = np.minimum(line, np.minimum(before + 3, np.minimum(edge[:-2], edge[2:]) + 4))
            before = d[y] = np.minimum.accumulate(line - steps) + steps
        return d

    d = swept(d)
    d = swept(d[::-1, ::-1].copy())[::-1, ::-1]
    most = d.max() if d.size else 0
    return np.minimum(d / most, 1.0) if most else d.astype(float)


def depths(pixels: DataFrame, by: str) -> DataFrame:
    """(by, x, y, depth) of dense rasters."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["y", "x"])
        shape = (int(part.y.max()) + 1, int(part.x.max()) + 1)
        return pd.DataFrame({by: part[by].to_numpy(), "x": part.x.to_numpy(), "y": part.y.to_numpy(), "depth": chamfer(part.a.to_numpy().reshape(shape)).ravel()})

    return pixels.groupBy(by).applyInPandas(run, f"{by} long, x int, y int, depth double")


def pivot(preset: str, width: Column, height: Column) -> Column:
    """A point of a cell by name, such as bottom-center; the last pixel is the far edge."""
    y, _, x = preset.partition("-")
    across = {"left": F.lit(0), "right": width - 1, "center": round_half_up((width - 1) / 2)}[x or "center"]
    down = {"top": F.lit(0), "bottom": height - 1, "center": round_half_up((height - 1) / 2)}[y]
    return F.struct(across.cast("int").alias("x"), down.cast("int").alias("y"))


def nine_regions(sizes: DataFrame) -> DataFrame:
    """sizes (id, w, h, l, t, r, b): the nine parts as rows (id, row, col, x, y, w, h)."""
    def axis(n: str, a: str, b: str) -> Column:
        size, lead, trail = F.col(n), F.col(a), F.col(b)
        return F.array(F.struct(F.lit(0).alias("at"), lead.alias("n")), F.struct(lead.alias("at"), (size - lead - trail).alias("n")), F.struct((size - trail).alias("at"), trail.alias("n")))

    rows = sizes.select("id", axis("w", "l", "r").alias("cols"), F.posexplode(axis("h", "t", "b")).alias("row", "v"))
    return rows.select("id", "row", "v", F.posexplode("cols").alias("col", "u")).select("id", "row", "col", F.col("u.at").alias("x"), F.col("v.at").alias("y"), F.col("u.n").alias("w"), F.col("v.n").alias("h"))


def owned(pixels: DataFrame, parts: list[tuple[int, list[tuple[float, float]]]]) -> DataFrame:
    """Adds part: the last polygon (order, points) that holds the middle of a pixel, by even-odd crossings. Polygons are literals."""
    x, y = F.col("x") + 0.5, F.col("y") + 0.5
    best = F.lit(None).cast("int")
    for order, points in sorted(parts):
        crossings = F.lit(0)
        for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
            if ay != by:
                crossings = crossings + F.when(((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0)
        best = F.when(crossings % 2 == 1, order).otherwise(best)
    return pixels.withColumn("part", best)


def variance_profiles(pixels: DataFrame, by: str, solid: int = 8) -> DataFrame:
    """(by, axis, line, change): the mean difference, 0..1, of each column or row from the one after it; two clear pixels differ by nothing."""
    parts = []
    for axis, other in (("x", "y"), ("y", "x")):
        from pyspark.sql import Window as W

        after = W.partitionBy(by, other).orderBy(axis)
        own = pixels.select(by, F.lit(axis).alias("axis"), F.col(axis).alias("line"), *[F.col(c) for c in "rgba"], *[F.lead(c).over(after).alias(f"n{c}") for c in "rgba"]).where("na is not null")
        gap = sum((F.abs(F.col(c) - F.col(f"n{c}")) for c in "rgb"), F.abs(F.col("a") - F.col("na")))
        clear = (F.col("a") < solid) & (F.col("na") < solid)
        parts.append(own.groupBy(by, "axis", "line").agg(F.avg(F.when(clear, 0.0).otherwise(gap / F.lit(1020.0))).alias("change")))
    return parts[0].unionByName(parts[1])


def flat_runs(profiles: DataFrame, by: str, tolerance: float = 0.02) -> DataFrame:
    """(by, axis, start, end): the longest run of lines that change by no more than a tolerance; of equal ones the first."""
    from pyspark.sql import Window as W

    flat = profiles.where(F.col("change") <= tolerance).withColumn("run", F.col("line") - F.row_number().over(W.partitionBy(by, "axis").orderBy("line")))
    runs = flat.groupBy(by, "axis", "run").agg(F.min("line").alias("start"), F.max("line").alias("end"))
    return runs.groupBy(by, "axis").agg(F.max_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("r")).select(by, "axis", "r.start", "r.end")


def detected_insets(pixels: DataFrame, by: str, width: int, height: int, tolerance: float = 0.02) -> DataFrame:
    """(by, left, right, top, bottom, confidence): the nine-slice insets around the flat middle of dense rasters of one size; confidence
    is the share of the smaller middle."""
    from rasterloom.functions.layout import clamped_insets

    runs = flat_runs(variance_profiles(pixels, by), by, tolerance)
    of = lambda axis, c: F.max(F.when(F.col("axis") == axis, F.col(c)))
    both = runs.groupBy(by).agg(of("x", "start").alias("xs"), of("x", "end").alias("xe"), of("y", "start").alias("ys"), of("y", "end").alias("ye"))
    found = pixels.select(by).distinct().join(both, by, "left")
    covered = lambda s, e, n: F.coalesce((F.col(e) - F.col(s) + 2) / n, F.lit(1.0 if n < 2 else 0.0))
    insets = clamped_insets(F.col("xs"), F.lit(width) - F.col("xe") - 2, F.col("ys"), F.lit(height) - F.col("ye") - 2, F.lit(width), F.lit(height))
    sure = F.least(F.lit(1.0), covered("xs", "xe", width), covered("ys", "ye", height))
    return found.select(by, insets.alias("i"), sure.alias("confidence")).select(by, "i.left", "i.right", "i.top", "i.bottom", "confidence")


def exploded(layers: list[tuple[int, int, int, int, int]], width: int, height: int) -> tuple[int, int, list[tuple[int, int, int]]]:
    """(width, height, (id, dx, dy) of each) of boxes (id, x, y, w, h) moved apart onto shelves, with a line for a label above each."""
    gap = max(12, int(max(width, height) * 0.035 + 0.5))
    label = max(18, int(gap * 0.8 + 0.5))
    own = [b for b in layers if b[3] > 0 and b[4] > 0]
    slot = lambda w: max(w, 4 * gap)
    area = sum((slot(w) + gap) * (h + gap + label) for _, _, _, w, h in own)
    shelf = max([width, (1.5 * area) ** 0.5, *(w + 2 * gap for _, _, _, w, _ in own)])
    at, top, high, wide, out = gap, gap, 0, gap, []
    for name, x, y, w, h in own:
        if at > gap and at + slot(w) + gap > shelf:
            at, top, high = gap, top + high + gap, 0
        out.append((name, at - x, top + label - y))
        at += slot(w) + gap
        high, wide = max(high, h + label), max(wide, at)
    return wide, top + high + gap, out


def exploded_layouts(boxes: DataFrame, by: str, width: int, height: int) -> DataFrame:
    """(by, id, dx, dy, width, height) of boxes (by, id, x, y, w, h) in the order of their ids; a drawing is laid out in one task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        w, h, moves = exploded(list(part[["id", "x", "y", "w", "h"]].itertuples(index=False, name=None)), width, height)
        return pd.DataFrame([(part[by].iloc[0], *m, w, h) for m in moves], columns=[by, "id", "dx", "dy", "width", "height"])

    return boxes.groupBy(by).applyInPandas(run, f"{by} long, id long, dx int, dy int, width int, height int")


def closure(level: DataFrame, parent: Callable[[Column], Column]) -> DataFrame:
    """(part, ancestor, depth): every part with all that it lies in, itself at depth 0; parent gives null at the top.

    The parents of a chain are an expression, so the closure is one pass over the rows: a chain is followed in an array that grows until
    no parent is left, by as many steps as the longest chain of 64-bit numbers that at least halve can have."""
    chain = F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.array("ancestor"), lambda found, _: F.when(parent(F.element_at(found, -1)).isNull(), found).otherwise(F.concat(found, F.array(parent(F.element_at(found, -1))))))
    return level.select("part", F.posexplode(chain).alias("depth", "ancestor")).select("part", "ancestor", "depth")

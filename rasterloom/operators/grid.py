"""Cells of a sheet: geometry, slicing and detection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scalars import round_half_up


def padding(side: Column, axis: Column, uniform: Column) -> Column:
    """The side's own, else the axis', else the uniform one, else none."""
    return F.coalesce(side, axis, uniform, F.lit(0))


def fitted(length: Column, count: Column, lead: Column, trail: Column, spacing: Column) -> Column:
    """The size of a cell where the cells divide the length exactly, else null. Without padding the rest is cut off."""
    inner = length - lead - trail - (count - 1) * spacing
    flush = (lead == 0) & (trail == 0) & (spacing == 0)
    return F.when(flush, F.floor(length / count)).when((inner > 0) & (inner % count == 0), F.floor(inner / count)).cast("int")


def divisors(length: Column, most: int = 5) -> Column:
    """Up to five counts from 2 to 32 that divide a length."""
    return F.slice(F.filter(F.sequence(F.lit(2), F.lit(32)), lambda d: length % d == 0), 1, most)


def sliced(pixels: DataFrame, cols: int, cell_w: int, cell_h: int, left: int = 0, top: int = 0, space_x: int = 0, space_y: int = 0, rows: int | None = None) -> DataFrame:
    """Pixels of a sheet (x, y) as pixels of cells (cell, x, y); those in gutters and outside go."""
    x, y = F.col("x") - left, F.col("y") - top
    col, row = F.floor(x / (cell_w + space_x)), F.floor(y / (cell_h + space_y))
    inside = (x >= 0) & (y >= 0) & (F.pmod(x, F.lit(cell_w + space_x)) < cell_w) & (F.pmod(y, F.lit(cell_h + space_y)) < cell_h) & (col < cols)
    if rows:
        inside &= row < rows
    return pixels.where(inside).withColumns({"cell": (row * cols + col).cast("int"), "x": F.pmod(x, F.lit(cell_w + space_x)).cast("int"), "y": F.pmod(y, F.lit(cell_h + space_y)).cast("int")})


def stitched(pixels: DataFrame, frame: str, cols: int, cell_w: int, cell_h: int, gap: int = 0) -> DataFrame:
    """Pixels of frames laid out on a sheet, row by row."""
    n = F.col(frame)
    return pixels.withColumns({"x": (F.col("x") + (n % cols) * (cell_w + gap)).cast("int"), "y": (F.col("y") + F.floor(n / cols) * (cell_h + gap)).cast("int")})


def is_empty(pixels: DataFrame, by: str, step: int = 1, share: float = 0.98) -> DataFrame:
    """(by, empty): whether over `share` of the sampled pixels are transparent."""
    seen = pixels.where((F.col("x") % step == 0) & (F.col("y") % step == 0))
    return seen.groupBy(by).agg((F.avg((F.col("a") == 0).cast("double")) > share).alias("empty"))


def profile(pixels: DataFrame, by: str, axis: str) -> DataFrame:
    """The share of opaque pixels of each line along an axis."""
    return pixels.groupBy(by, axis).agg(F.avg((F.col("a") >= 32).cast("double")).alias("activity"))


def _period(profile_: np.ndarray) -> tuple[int, float]:
    """(lag, strength) of the regular repeat of a profile, by autocorrelation: the strongest peak, or a fraction of it (2 to 8) that has
    four fifths of its strength within a line; (0, 0) without one, or under 32 lines."""
    n = len(profile_)
    centred = profile_ - profile_.mean() if n else profile_
    power = (centred**2).mean() if n else 0.0
    if n < 32 or power < 1e-8:
        return 0, 0.0
    least = 8
    by_lag = np.array([(centred[k:] * centred[: n - k]).sum() / ((n - k) * power) for k in range(least, n // 2 + 1)])
    inner = np.arange(1, len(by_lag) - 1)
    peaks = inner[(by_lag[inner] > by_lag[inner - 1]) & (by_lag[inner] >= by_lag[inner + 1]) & (by_lag[inner] > 0.2)]
    if not len(peaks):
        return 0, 0.0
    best = int(peaks[by_lag[peaks].argmax()])
    lag, strength = best + least, float(by_lag[best])
    for parts in range(2, 9):
        shorter = int(np.floor(lag / parts + 0.5))
        if shorter < least:
            break
        around = by_lag[max(0, shorter - least - 1) : shorter - least + 2]
        if len(around) and around.max() >= 0.8 * strength:
            lag, strength = shorter, float(around.max())
    return lag, strength


def _blocks(empty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (~empty).astype(int), [0]))))
    return edges[::2], edges[1::2]


def _cells(empty: np.ndarray) -> int:
    """Blocks of lines between gaps of at least half the widest gap; 0 where all lines are empty."""
    starts, ends = _blocks(empty)
    gaps = starts[1:] - ends[:-1]
    return 0 if not len(starts) else 1 + int((gaps >= max(1, gaps.max() // 2)).sum()) if len(gaps) else 1


def inferred_padding(profile_: np.ndarray, count: int) -> tuple[int, int, int]:
    """(lead, trail, gap) of an axis where its lines are exactly `count` equal blocks between equal gaps; no padding where that says no
    more than a flush grid does, or is wider than a cell."""
    n = len(profile_)
    starts, ends = _blocks(profile_ < 0.01) if n else (np.empty(0, int), np.empty(0, int))
    if count < 2 or len(starts) != count:
        return 0, 0, 0
    sizes, gaps = ends - starts, starts[1:] - ends[:-1]
    cell, gap, lead, trail = int(sizes[0]), int(gaps[0]), int(starts[0]), int(n - ends[-1])
    flush = n % count == 0 and cell + gap == n // count
    if (sizes != cell).any() or (gaps != gap).any() or flush or max(gap, lead, trail) > cell:
        return 0, 0, 0
    return lead, trail, gap


def _profiles(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of each column and row that is not background: the mean of the corners, or transparency; and the latter too where no
    line is empty otherwise."""
    corner = image[[0, 0, -1, -1], [0, -1, 0, -1]].astype(float).mean(0)
    clear = image[..., 3] < 32
    back = clear if corner[3] < 128 else (np.abs(image[..., :3] - corner[:3]) < 20).all(-1)
    of = lambda own: ((~own).mean(0), (~own).mean(1))
    found, by_alpha = of(back), of(clear)
    if corner[3] >= 128 and not any((p < 0.01).any() for p in found) and any((p < 0.01).any() for p in by_alpha):
        return by_alpha
    return found


def grid_of(image: np.ndarray) -> dict[str, float | int | str]:
    """The grid of one sheet (height, width, 4): by the repeat of its profiles, else by gaps, else by common sizes of cells."""
    h, w = image.shape[:2]
    cols_, rows_ = _profiles(image)
    periods = _period(cols_), _period(rows_)
    counts, sure, method = None, 0.0, "none"
    if all(p[0] for p in periods):
        counts = [max(1, int(np.floor(n / p[0] + 0.5))) for n, p in zip((w, h), periods, strict=True)]
        sure, method = 0.5 + 0.4 * min(p[1] for p in periods), "period"
    if counts is None or max(counts) > 32:
        counts, sure, method = [_cells(p < 0.01) for p in (cols_, rows_)], 0.6, "gaps"
    if not 1 <= min(counts) <= max(counts) <= 32:
        size = next((s for s in (16, 24, 32, 48, 64, 96, 128, 192, 256) if w % s == 0 and h % s == 0), None)
        counts, sure, method = ([w // size, h // size], 0.4, "size") if size else ([1, 1], 0.0, "none")
    across, down = inferred_padding(cols_, counts[0]), inferred_padding(rows_, counts[1])
    return {"cols": counts[0], "rows": counts[1], "confidence": sure, "method": method, "left": across[0], "right": across[1], "top": down[0], "bottom": down[1], "space_x": across[2], "space_y": down[2]}


_GRID = "cols int, rows int, confidence double, method string, left int, right int, top int, bottom int, space_x int, space_y int"


def detected(rasters: DataFrame) -> DataFrame:
    """sheet, cols, rows, confidence, method and padding of rasters (sheet, width, height, rgba as bytes, row by row): a sheet at a time.
    In place of rgba there may be a column alpha, one byte a pixel."""
    pixels_ = "rgba" if "rgba" in rasters.columns else "alpha"

    def image(data: bytes, h: int, w: int) -> np.ndarray:
        own = np.frombuffer(data, np.uint8).reshape(h, w, -1)
        return own if pixels_ == "rgba" else np.concatenate((np.zeros((h, w, 3), np.uint8), own), axis=2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"sheet": sheet, **grid_of(image(data, h, w))} for sheet, w, h, data in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["sheet", *(c.split()[0] for c in _GRID.split(", "))])

    return rasters.select("sheet", "width", "height", pixels_).mapInPandas(run, f"sheet long, {_GRID}")


def resolved(found: DataFrame, cols: Column, rows: Column, stated: dict[str, Column]) -> DataFrame:
    """The grid that is used (sheet, width, height and `detected`'s columns): stated counts and paddings win; of detected paddings all go
    where the cells would then not divide the sheet."""
    sides = ("left", "right", "top", "bottom", "space_x", "space_y")
    both = found.withColumns({"cols": F.coalesce(cols, F.col("cols")).cast("int"), "rows": F.coalesce(rows, F.col("rows")).cast("int")})
    own = {s: F.coalesce(stated.get(s, F.lit(None).cast("int")), F.col(s)) for s in sides}
    fits = fitted(F.col("width"), F.col("cols"), own["left"], own["right"], own["space_x"]).isNotNull() & fitted(F.col("height"), F.col("rows"), own["top"], own["bottom"], own["space_y"]).isNotNull()
    return both.withColumns({s: F.when(fits, own[s]).otherwise(F.coalesce(stated.get(s, F.lit(None).cast("int")), F.lit(0))).cast("int") for s in sides})


def cropped(pixels: DataFrame, by: str, pad: int = 0, sheet: str | None = None) -> DataFrame:
    """Every raster of `by` cut to the box of all opaque pixels, or all of its sheet, and moved to the origin; a row a sheet is joined."""
    box = pixels.where("a > 0").groupBy(*([F.col(sheet).alias("__sheet")] if sheet else [])).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    inside = (F.col("x") >= F.col("x0") - pad) & (F.col("x") <= F.col("x1") + pad) & (F.col("y") >= F.col("y0") - pad) & (F.col("y") <= F.col("y1") + pad)
    joined = pixels.join(box, inside & F.col(sheet).eqNullSafe(F.col("__sheet"))) if sheet else pixels.join(F.broadcast(box), inside)
    return joined.withColumns({"x": F.col("x") - F.col("x0") + pad, "y": F.col("y") - F.col("y0") + pad}).drop("x0", "x1", "y0", "y1", "__sheet")


def crop_box(width: Column, height: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Whole pixels of a crop given as shares of the raster."""
    x, y = round_half_up(left * width), round_half_up(top * height)
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.greatest(F.lit(1), round_half_up(width * (1 - left - right))).cast("int").alias("w"), F.greatest(F.lit(1), round_half_up(height * (1 - top - bottom))).cast("int").alias("h"))

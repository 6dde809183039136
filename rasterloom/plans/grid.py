"""Queries of grids, cells and crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import grid
from rasterloom.plans.registry import plan
from rasterloom.plans.relations import CANVAS, CELL, COLS, KEYED, SHEET, canvas, keyed, table


@plan("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_size END, CASE WHEN p_partkey % 3 = 0 THEN 7 END, CASE WHEN p_partkey % 5 = 0 THEN 3 END, 0)::INT AS pad FROM part")
def grid_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", grid.padding(F.when(k % 2 == 0, F.col("p_size")), F.when(k % 3 == 0, F.lit(7)), F.when(k % 5 == 0, F.lit(3))).cast("int").alias("pad"))


@plan("""WITH p AS (SELECT p_partkey, (64 + p_size * 8)::INT AS len, (1 + p_partkey % 9)::INT AS n, (p_partkey % 3)::INT AS lead, (p_partkey % 4)::INT AS gap FROM part), q AS (SELECT *, len - lead * 2 - (n - 1) * gap AS inner_ FROM p)
 SELECT p_partkey, (CASE WHEN lead = 0 AND gap = 0 THEN len // n WHEN inner_ > 0 AND inner_ % n = 0 THEN inner_ // n END)::INT AS cell, list_filter(range(2, 33), lambda d: len % d = 0)[1:5]::INT[] AS suggestions FROM q""")
def grid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.lit(64) + F.col("p_size") * 8).cast("int").alias("len"), (F.col("p_partkey") % 9 + 1).cast("int").alias("n"), (F.col("p_partkey") % 3).cast("int").alias("lead"), (F.col("p_partkey") % 4).cast("int").alias("gap"))
    return p.select("p_partkey", grid.fitted(F.col("len"), F.col("n"), F.col("lead"), F.col("lead"), F.col("gap")).alias("cell"), grid.divisors(F.col("len")).alias("suggestions"))


@plan(f"""WITH {CANVAS}, s AS (SELECT frame, (x - 1) AS u, (y - 2) AS v, n FROM canvas)
 SELECT frame, ((v // 9) * 4 + u // 5)::INT AS cell, (u % 5)::INT AS x, (v % 9)::INT AS y, n FROM s WHERE u >= 0 AND v >= 0 AND u % 5 < 4 AND v % 9 < 8 AND u // 5 < 4""")
def sheet_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.sliced(canvas(spark, sf_dir), 4, 4, 8, 1, 2, 1, 1).select("frame", "cell", "x", "y", "n")


@plan(f"""WITH {KEYED} SELECT frame // {SHEET} AS sheet, (x + (frame % {SHEET}) % {COLS} * {CELL + 1})::INT AS x, (y + (frame % {SHEET}) // {COLS} * {CELL + 1})::INT AS y, r, a FROM keyed""")
def stitched_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = keyed(spark, sf_dir).withColumns({"sheet": F.floor(F.col("frame") / SHEET), "cell": F.col("frame") % SHEET})
    return grid.stitched(p, "cell", COLS, CELL, CELL, 1).select("sheet", "x", "y", "r", "a")


@plan(f"WITH {KEYED} SELECT frame, avg((a = 0)::INT) > 0.5 AS empty FROM keyed WHERE x % 2 = 0 AND y % 2 = 0 GROUP BY 1")
def empty_cells_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.is_empty(keyed(spark, sf_dir), "frame", 2, 0.5)


@plan(f"WITH {KEYED}, c AS (SELECT frame, x, avg((a >= 32)::INT) AS activity FROM keyed GROUP BY 1, 2), d AS (SELECT frame, y, avg((a >= 32)::INT) AS activity FROM keyed GROUP BY 1, 2) SELECT frame, 'x' AS axis, x AS line, activity FROM c UNION ALL SELECT frame, 'y', y, activity FROM d")
def activity_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = keyed(spark, sf_dir)
    parts = [grid.profile(p, "frame", axis).select("frame", F.lit(axis).alias("axis"), F.col(axis).alias("line"), "activity") for axis in "xy"]
    return parts[0].unionByName(parts[1])


@plan(f"WITH {CANVAS}, b AS (SELECT frame % 7 AS sheet, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM canvas GROUP BY 1) SELECT sheet, frame, x - x0 + 1 AS x, y - y0 + 1 AS y, n FROM canvas JOIN b ON frame % 7 = sheet")
def auto_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame cut to the common box of its sheet; the residues of seven are the sheets."""
    p = canvas(spark, sf_dir).withColumns({"sheet": F.col("frame") % 7, "a": F.lit(255)})
    return grid.cropped(p, "frame", 1, "sheet").select("sheet", "frame", "x", "y", "n")


@plan("SELECT p_partkey, floor(p_size * 10 * 0.125 + 0.5)::INT AS x, floor(480 * 0.1 + 0.5)::INT AS y, greatest(1, floor(p_size * 10 * 0.625 + 0.5))::INT AS w, greatest(1, floor(480 * 0.8 + 0.5))::INT AS h FROM part")
def manual_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = grid.crop_box(F.col("p_size") * 10, F.lit(480), F.lit(0.125), F.lit(0.1), F.lit(0.25), F.lit(0.1))
    return table(spark, sf_dir, "part").select("p_partkey", box.alias("b")).select("p_partkey", "b.x", "b.y", "b.w", "b.h")


@plan()
def detected_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of users' canvases: each has 8 x 1 blocks of three hours with a gap of one; detection runs over one raster a row."""
    width = 24 + 8 - 1
    p = canvas(spark, sf_dir).withColumn("x", F.col("x") + F.floor(F.col("x") / 3))
    spots = p.groupBy(F.col("frame").alias("sheet")).agg(F.sort_array(F.collect_set((F.col("y") * width + F.col("x")).cast("int"))).alias("spots"))
    grid_ = F.transform(F.sequence(F.lit(0), F.lit(width * 31 - 1)), lambda i: F.when(F.array_contains("spots", i), F.lit("FF" * 4)).otherwise("00" * 4))
    return grid.detected(spots.select("sheet", F.lit(width).alias("width"), F.lit(31).alias("height"), F.unhex(F.array_join(grid_, "")).alias("rgba")))


@plan()
def resolved_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detected grids where every second sheet states its columns and every third its left margin."""
    found = detected_grids(spark, sf_dir).withColumns({"width": F.lit(31), "height": F.lit(31)})
    k = F.col("sheet")
    return grid.resolved(found, F.when(k % 2 == 0, F.lit(8)), F.lit(None).cast("int"), {"left": F.when(k % 3 == 0, F.lit(0))})

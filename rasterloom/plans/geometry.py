"""Queries of outlines, packing, pivots and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import geometry as op
from rasterloom.plans.registry import plan
from rasterloom.plans.relations import CANVAS, CELL, PIXELS, canvas, keyed, pixels, table


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvas(spark, sf_dir).withColumn("a", F.lit(255))


@plan()
def collision_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.outlines(_shapes(spark, sf_dir), "frame", 1.0)


@plan()
def convex_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.hulls(_shapes(spark, sf_dir), "frame")


@plan()
def packed_atlases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atlases of 50 parts each."""
    k = F.col("p_partkey")
    rects = table(spark, sf_dir, "part").select(F.floor(k / 50).alias("atlas"), k.alias("id"), F.col("p_size").alias("w"), (k % 50 + 1).cast("int").alias("h"))
    return op.atlases(rects, "atlas", 1)


@plan()
def alpha_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.depths(keyed(spark, sf_dir), "frame")


@plan("""SELECT p_partkey, 0 AS tl_x, 0 AS tl_y, floor((p_size - 1) / 2 + 0.5)::INT AS bc_x, (p_partkey % 64)::INT AS bc_y, floor((p_size - 1) / 2 + 0.5)::INT AS c_x, floor((p_partkey % 64) / 2 + 0.5)::INT AS c_y FROM part""")
def pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size"), F.col("p_partkey") % 64 + 1
    points = table(spark, sf_dir, "part").select("p_partkey", *[op.pivot(p, w, h).alias(n) for p, n in (("top-left", "tl"), ("bottom-center", "bc"), ("center", "c"))])
    return points.select("p_partkey", *[F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in ("tl", "bc", "c") for c in "xy"])


@plan("""WITH s AS (SELECT p_partkey AS id, (p_size + 20)::INT AS w, (30 + p_partkey % 7)::INT AS h, (p_partkey % 5)::INT AS l, 2 AS t, 3 AS r, (p_partkey % 3)::INT AS b FROM part),
 ax AS (SELECT id, unnest([0, 1, 2]) AS col, unnest([0, l, w - r]) AS x, unnest([l, w - l - r, r]) AS cw FROM s), ay AS (SELECT id, unnest([0, 1, 2]) AS row, unnest([0, t, h - b]) AS y, unnest([t, h - t - b, b]) AS ch FROM s)
 SELECT id, row, col, x, y, cw AS w, ch AS h FROM ax JOIN ay USING (id)""")
def nine_slice_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    sizes = table(spark, sf_dir, "part").select(k.alias("id"), (F.col("p_size") + 20).alias("w"), (k % 7 + 30).cast("int").alias("h"), (k % 5).cast("int").alias("l"), F.lit(2).alias("t"), F.lit(3).alias("r"), (k % 3).cast("int").alias("b"))
    return op.nine_regions(sizes)


_PARTS = [(0, [(0.0, 0.0), (24.0, 0.0), (24.0, 31.0), (0.0, 31.0)]), (1, [(2.0, 3.0), (14.0, 3.0), (14.0, 20.0), (2.0, 20.0)]), (2, [(8.0, 0.0), (20.0, 16.0), (4.0, 28.0)])]
_TRI = "((0 > v) <> (16 > v) AND u < 12.0 * v / 16 + 8)::INT + ((16 > v) <> (28 > v) AND u < (4 - 20) * (v - 16) / 12.0 + 20)::INT + ((28 > v) <> (0 > v) AND u < (8 - 4) * (v - 28) / -28.0 + 4)::INT"


@plan(f"WITH {CANVAS}, p AS (SELECT *, x + 0.5::DOUBLE AS u, y + 0.5::DOUBLE AS v FROM canvas) SELECT frame, x, y, CASE WHEN ({_TRI}) % 2 = 1 THEN 2 WHEN x >= 2 AND x < 14 AND y >= 3 AND y < 20 THEN 1 ELSE 0 END AS part FROM p")
def character_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.owned(canvas(spark, sf_dir), _PARTS).select("frame", "x", "y", "part")


@plan("""WITH RECURSIVE t(part, ancestor, depth) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION ALL SELECT t.part, t.ancestor // 3, t.depth + 1 FROM t WHERE t.ancestor // 3 >= 1) SELECT part, ancestor, depth FROM t""")
def layer_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of a layer tree (the parent of n is n // 3), level by level until no layer has a parent left."""
    level = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("part"), F.col("s_suppkey").cast("long").alias("ancestor"), F.lit(0).alias("depth"))
    return op.closure(level, lambda a: F.when(a >= 3, F.floor(a / 3)))


@plan(f"""WITH {PIXELS}, d AS (SELECT p.frame, 'x' AS axis, p.x AS line, p.*, q.r AS nr, q.g AS ng, q.b AS nb, q.a AS na FROM pixels p JOIN pixels q ON p.frame = q.frame AND p.y = q.y AND q.x = p.x + 1
 UNION ALL SELECT p.frame, 'y', p.y, p.*, q.r, q.g, q.b, q.a FROM pixels p JOIN pixels q ON p.frame = q.frame AND p.x = q.x AND q.y = p.y + 1)
 SELECT frame, axis, line, round(avg(CASE WHEN a < 8 AND na < 8 THEN 0 ELSE (abs(r - nr) + abs(g - ng) + abs(b - nb) + abs(a - na)) / 1020.0::DOUBLE END), 9) AS change FROM d GROUP BY 1, 2, 3""")
def variance_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.variance_profiles(pixels(spark, sf_dir), "frame").withColumn("change", F.round("change", 9))


@plan(f"""WITH {PIXELS}, d AS (SELECT p.frame AS f, 'x' AS axis, p.x AS line, p.r, p.g, p.b, p.a, q.r AS nr, q.g AS ng, q.b AS nb, q.a AS na FROM pixels p JOIN pixels q ON p.frame = q.frame AND p.y = q.y AND q.x = p.x + 1
 UNION ALL SELECT p.frame, 'y', p.y, p.r, p.g, p.b, p.a, q.r, q.g, q.b, q.a FROM pixels p JOIN pixels q ON p.frame = q.frame AND p.x = q.x AND q.y = p.y + 1),
 v AS (SELECT f, axis, line, avg(CASE WHEN a < 8 AND na < 8 THEN 0 ELSE (abs(r - nr) + abs(g - ng) + abs(b - nb) + abs(a - na)) / 1020.0::DOUBLE END) AS change FROM d GROUP BY 1, 2, 3),
 u AS (SELECT *, line - row_number() OVER (PARTITION BY f, axis ORDER BY line) AS run FROM v WHERE change <= 0.16), w AS (SELECT f, axis, min(line) AS s, max(line) AS e FROM u GROUP BY f, axis, run),
 z AS (SELECT f, axis, arg_max(s, (e - s) * 100 - s) AS s, arg_max(e, (e - s) * 100 - s) AS e FROM w GROUP BY 1, 2),
 o AS (SELECT DISTINCT frame AS f FROM pixels), j AS (SELECT o.f, x.s AS xs, x.e AS xe, y.s AS ys, y.e AS ye FROM o LEFT JOIN (SELECT * FROM z WHERE axis = 'x') x ON x.f = o.f LEFT JOIN (SELECT * FROM z WHERE axis = 'y') y ON y.f = o.f)
 SELECT f AS frame, CASE WHEN xs IS NULL THEN 0 WHEN xe - xs = 2 AND xs > 0 THEN xs ELSE xs END::INT AS "left", CASE WHEN xs IS NULL THEN 0 ELSE 2 - xe END::INT AS "right", coalesce(ys, 0)::INT AS top, CASE WHEN ys IS NULL THEN 0 ELSE 2 - ye END::INT AS bottom,
 least(coalesce((xe - xs + 2) / 4.0::DOUBLE, 0), coalesce((ye - ys + 2) / 4.0::DOUBLE, 0)) AS confidence FROM j""")
def nine_slice_insets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insets around what changes by no more than 16 % of all channels' range."""
    return op.detected_insets(pixels(spark, sf_dir), "frame", CELL, CELL, 0.16)


@plan()
def exploded_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings of 12 parts each."""
    k = F.col("p_partkey")
    boxes = table(spark, sf_dir, "part").select(F.floor(k / 12).alias("drawing"), k.alias("id"), (k % 40).cast("int").alias("x"), (k % 30).cast("int").alias("y"), F.col("p_size").alias("w"), (k % 50 + 1).cast("int").alias("h"))
    return op.exploded_layouts(boxes, "drawing", 200, 160)

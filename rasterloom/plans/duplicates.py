"""Queries of duplicate frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import duplicates as op
from rasterloom.plans.registry import plan
from rasterloom.plans.relations import PIXELS, SHEET, TAG_ROWS, TAGS, pixels, tags

_SIG = f"""{PIXELS}, quarter AS (SELECT frame, y // 2 * 2 + x // 2 AS q, sum(r) AS r, sum(g) AS g FROM pixels GROUP BY 1, 2),
 sig AS (SELECT frame, frame // {SHEET * 10} AS sheet, sum(((r >= 512)::INT + (g >= 512)::INT * 2) << (2 * q::INT)) AS s FROM quarter GROUP BY 1, 2),
 rep AS (SELECT sheet, frame, min(frame) OVER (PARTITION BY sheet, s) AS rep FROM sig),
 map AS (SELECT sheet, frame, rep, (dense_rank() OVER (PARTITION BY sheet ORDER BY rep) - 1)::INT AS new_index FROM rep)"""


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 2 x 2 pixels, each the mean of four in one bit of red and of green, by all of their pixels; sheets of 250 frames."""
    quarter = pixels(spark, sf_dir).groupBy("frame", F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(*[(F.sum(c) >= 512).cast("int").alias(c) for c in "rg"])
    coarse = quarter.withColumns({"b": F.lit(0), "a": F.lit(255), "sheet": F.floor(F.col("frame") / (SHEET * 10))})
    signed = op.signatures(coarse, "sheet", "frame")
    return op.renumbered(op.exact(signed, "sheet", "frame"), "sheet", "frame")


@plan(f"WITH {_SIG} SELECT sheet, frame, rep, new_index FROM map")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("sheet", "frame", "rep", "new_index")


@plan(f"WITH {_SIG} SELECT sheet, rep AS keep, list(frame ORDER BY frame) FILTER (frame <> rep) AS gone, count(*) AS frames FROM map GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mapped(spark, sf_dir)
    gone = F.sort_array(F.collect_list(F.when(F.col("frame") != F.col("rep"), F.col("frame"))))
    return m.groupBy("sheet", F.col("rep").alias("keep")).agg(gone.alias("gone"), F.count("*").alias("frames")).where("frames > 1")


@plan(f"""WITH {PIXELS}, p AS (SELECT frame // {SHEET} AS sheet, frame, x, y, CASE WHEN a = 0 THEN 0 ELSE r END AS r, CASE WHEN a = 0 THEN 0 ELSE g END AS g, CASE WHEN a = 0 THEN 0 ELSE b END AS b, a FROM pixels)
 SELECT p.sheet, p.frame AS a, q.frame AS b, (sum(abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b) + abs(p.a - q.a)) / 64)::DOUBLE AS distance FROM p JOIN p q ON p.sheet = q.sheet AND p.frame < q.frame AND p.x = q.x AND p.y = q.y GROUP BY 1, 2, 3 HAVING distance <= 30""")
def frame_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).withColumn("sheet", F.floor(F.col("frame") / SHEET))
    return op.distances(p, "sheet", "frame", 30.0)


@plan()
def greedy_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).withColumn("sheet", F.floor(F.col("frame") / SHEET))
    return op.greedy(p.select("sheet", "frame").distinct(), op.distances(p, "sheet", "frame", 30.0), "sheet", "frame")


@plan(f"WITH {TAGS} SELECT e.vec_id AS frame, coalesce(min(t.ord), 6)::INT AS owner FROM embeddings e LEFT JOIN tags t ON e.vec_id BETWEEN greatest(0, least(from_f, to_f)) AND greatest(from_f, to_f) GROUP BY 1")
def tag_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("frame"))
    return op.tag_partitions(frames, tags(spark), "frame", 6).select(F.col("frame").cast("long").alias("frame"), "owner")


_REMAP = f"""{_SIG}, {TAGS}, old AS (SELECT sheet, ord, name, greatest(0, least(from_f, to_f)) AS lo, least(249, greatest(from_f, to_f)) AS hi FROM tags, (SELECT DISTINCT sheet FROM map)),
 w AS (SELECT o.sheet, o.ord, m.frame, m.new_index, lag(m.new_index) OVER (PARTITION BY o.sheet, o.ord ORDER BY m.frame) AS before FROM old o JOIN map m ON m.sheet = o.sheet AND m.frame - m.sheet * 250 BETWEEN lo AND hi),
 k AS (SELECT sheet, ord, list(new_index ORDER BY frame) AS frames FROM w WHERE before IS NULL OR before <> new_index GROUP BY 1, 2)"""


@plan(f"""WITH {_REMAP} SELECT o.sheet, o.ord, o.name, coalesce(k.frames, []::INT[]) AS frames, coalesce(list_min(k.frames), 0)::INT AS from_f, coalesce(list_max(k.frames), 0)::INT AS to_f,
 coalesce(k.frames = range(list_min(k.frames), list_max(k.frames) + 1)::INT[], false) AS contiguous FROM old o LEFT JOIN k USING (sheet, ord)""")
def remapped_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of every sheet, over its own frames from 0."""
    mapping = _mapped(spark, sf_dir).select("sheet", (F.col("frame") - F.col("sheet") * SHEET * 10).cast("int").alias("frame"), "new_index")
    each = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("ord", "name", "from_f", "to_f"), row, strict=False)]) for row in TAG_ROWS])
    per_sheet = mapping.select("sheet").distinct().select("sheet", F.inline(each))
    return op.remapped_tags(per_sheet, mapping, SHEET * 10, "sheet")


@plan(f"""WITH {_SIG} SELECT sheet, new_index, arg_min(CASE WHEN frame % 3 = 0 THEN frame * 10 END, frame) AS hold FROM map GROUP BY 1, 2""")
def remapped_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mapped(spark, sf_dir)
    holds = m.select("frame", F.when(F.col("frame") % 3 == 0, F.col("frame") * 10).alias("hold"))
    per_sheet = m.withColumn("new_index", F.struct("sheet", "new_index")).select("frame", "new_index")
    return op.remapped_durations(holds, per_sheet).select("new_index.sheet", "new_index.new_index", "hold")


@plan(f"WITH {_SIG} SELECT m.sheet, m.frame FROM map m WHERE m.frame = m.rep")
def kept_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that stay: a semi-join with the representatives."""
    m = _mapped(spark, sf_dir)
    frames = m.select("sheet", "frame")
    return frames.join(m.select("sheet", F.col("rep").alias("frame")).distinct(), ["sheet", "frame"], "left_semi")

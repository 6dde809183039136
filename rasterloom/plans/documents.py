"""Queries of sheet documents and engine exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.scalars import slug
from rasterloom.operators import documents as op
from rasterloom.plans.registry import plan
from rasterloom.plans.relations import table, tags

_FRAMES = """fr AS (SELECT p_partkey // 12 AS sheet, p_partkey AS frame, (p_partkey % 12 % 4 * 18 + 1)::INT AS x, (p_partkey % 12 // 4 * 34 + 2)::INT AS y, 16 AS w, 32 AS h, floor(p_retailprice)::INT AS ms FROM part),
 pv AS (SELECT l_partkey AS frame, arg_max(struct_pack(x := CASE WHEN l_returnflag <> 'R' THEN (l_quantity % 16)::INT END, y := CASE WHEN l_returnflag <> 'R' THEN (l_quantity % 32)::INT END), l_orderkey * 1000000 + l_linenumber * 10000 + l_suppkey + l_extendedprice / 1000000 ) AS p FROM lineitem GROUP BY 1),
 doc AS (SELECT fr.*, CASE WHEN p.x = 15 THEN 16 ELSE p.x END AS px, CASE WHEN p.y = 31 THEN 32 ELSE p.y END AS py FROM fr LEFT JOIN pv USING (frame))"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as frames with the pivot of their last line; a returned line says none."""
    k = F.col("p_partkey")
    frames = table(spark, sf_dir, "part").select(
        F.floor(k / 12).alias("sheet"), k.alias("frame"), (k % 12 % 4 * 18 + 1).cast("int").alias("x"), (F.floor(k % 12 / 4) * 34 + 2).cast("int").alias("y"), F.lit(16).alias("w"), F.lit(32).alias("h"), F.floor("p_retailprice").cast("int").alias("ms")
    )
    li = table(spark, sf_dir, "lineitem")
    given = lambda c: F.when(F.col("l_returnflag") != "R", c)
    order = F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber") * 10_000 + F.col("l_suppkey") + F.col("l_extendedprice") / 1_000_000
    pivots = li.select(order.alias("ord"), F.col("l_partkey").alias("frame"), given((F.col("l_quantity") % 16).cast("int")).alias("x"), given((F.col("l_quantity") % 32).cast("int")).alias("y"))
    return op.attached(frames, pivots)


@plan(f"WITH {_FRAMES} SELECT * FROM doc")
def normalized_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir)


@plan(f"WITH {_FRAMES} SELECT sheet, frame, x, 104 - y - h AS y, w, h, coalesce(px / w, 0.5)::DOUBLE AS pivot_x, coalesce(1 - py / h, 0.5)::DOUBLE AS pivot_y FROM doc")
def unity_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.unity_rects(_frames(spark, sf_dir), F.lit(104))


_RECT = """'"frame":{"x":' || x || ',"y":' || y || ',"w":' || w || ',"h":' || h || '}'"""


@plan(f"""WITH {_FRAMES} SELECT sheet, '{{"frames":[' || string_agg('{{"filename":"' || sheet || '_' || lpad(frame::VARCHAR, greatest(3, length(frame::VARCHAR))::INT, '0') || '",' || {_RECT} || ',"rotated":false,"trimmed":false,"spriteSourceSize":{{"x":0,"y":0,"w":' || w || ',"h":' || h || '}},"sourceSize":{{"w":' || w || ',"h":' || h || '}},"duration":' || ms || '}}', ',' ORDER BY frame)
 || '],"meta":{{"version":"1.0","format":"RGBA8888","size":{{"w":' || max(x + w) || ',"h":' || max(y + h) || '}},"scale":"1"}}}}' AS document FROM doc GROUP BY 1""")
def aseprite_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.aseprite_json(_frames(spark, sf_dir))


@plan()
def phaser_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tags(spark).where("from_f <= to_f")
    return op.phaser_json(_frames(spark, sf_dir), own)


@plan()
def unity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.unity_meta(op.unity_rects(_frames(spark, sf_dir), F.lit(104)))


@plan(f"""WITH {_FRAMES}, t(name, lo, hi, fps) AS (VALUES ('a', 0, 30, 10.0::DOUBLE), ('b', 20, 60, 24.0::DOUBLE))
 SELECT sheet, name, max(fps) AS speed, count(*) AS n FROM doc JOIN t ON frame BETWEEN lo AND hi GROUP BY 1, 2""")
def godot_animations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = spark.createDataFrame([("a", 0, 30, 10.0), ("b", 20, 60, 24.0)], "name string, from_f int, to_f int, fps double")
    found = op.godot_frames(_frames(spark, sf_dir), tags)
    return found.select("sheet", "name", "speed", F.size(F.from_json("holds", "array<double>")).cast("long").alias("n"))


@plan("WITH n AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_partkey // 12, p_type ORDER BY p_partkey) AS k FROM part) SELECT p_partkey, CASE WHEN k = 1 THEN p_type ELSE p_type || '_' || k END AS unique_name FROM n")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of sheets of twelve by their types; no type ends in a number."""
    parts = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 12).alias("sheet"), "p_partkey", "p_type")
    return op.resolved_names(parts, "sheet", "p_type", "p_partkey").select("p_partkey", "unique_name")


@plan(r"SELECT page_id, regexp_replace(regexp_replace(url, '^.*[/\\]', ''), '\.[^.]+$', '') AS stem, regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def names_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", op.stem(F.col("url")).alias("stem"), slug(F.col("url")).alias("slug"))

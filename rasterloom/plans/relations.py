"""Relations that the queries run over, derived from the driver's tables, and the same relations as SQL text for the oracle.

Every one is a projection (no exchange) unless its docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frames of a sheet: 5 x 5 cells of 4 x 4 pixels.
SHEET, COLS, CELL = 25, 5, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day (null for each 97th event), provider, model, status, requests, completed, cost_micros, unknown_costs, event_id, owner, ts."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.when(F.col("event_id") % 97 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("provider"),
        kind.alias("model"),
        F.when(kind == "purchase", "done").when(kind == "error", "failed").otherwise("reserved").alias("status"),
        F.lit(1).cast("long").alias("requests"),
        (kind == "purchase").cast("long").alias("completed"),
        F.floor(F.col("value") * 1_000_000 + 0.5).cast("long").alias("cost_micros"),
        ((kind == "error") & (F.col("event_id") % 3 == 0)).cast("long").alias("unknown_costs"),
        "event_id",
        F.col("user_id").alias("owner"),
        "ts",
    )


ACTIVITY = """act AS (
  SELECT CASE WHEN event_id % 97 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS day,
    CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS provider, event_type AS model,
    CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'reserved' END AS status,
    1::BIGINT AS requests, (event_type = 'purchase')::BIGINT AS completed,
    floor(value * 1000000 + 0.5)::BIGINT AS cost_micros,
    (event_type = 'error' AND event_id % 3 = 0)::BIGINT AS unknown_costs, event_id, user_id AS owner, ts
  FROM events)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, x, y, r, g, b, a: each embedding as a dense raster of 4 x 4 pixels."""
    e = table(spark, sf_dir, "embeddings")
    level = lambda i: F.least(F.greatest(F.floor((F.get("embedding", i).cast("double") + 0.5) * 256), F.lit(0)), F.lit(255)).cast("int")
    at = e.select(F.col("vec_id").alias("frame"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    return at.select("frame", (F.col("p") % 4).cast("int").alias("x"), F.floor(F.col("p") / 4).cast("int").alias("y"), *[level(F.col("p") * 4 + c).alias(n) for c, n in enumerate("rgba")])


PIXELS = """lv AS (SELECT vec_id AS frame, embedding AS v, unnest(range(0, 16)) AS p FROM embeddings),
pixels AS (
  SELECT frame, (p % 4)::INT AS x, (p // 4)::INT AS y,
    least(greatest(floor((v[p * 4 + 1]::DOUBLE + 0.5) * 256), 0), 255)::INT AS r,
    least(greatest(floor((v[p * 4 + 2]::DOUBLE + 0.5) * 256), 0), 255)::INT AS g,
    least(greatest(floor((v[p * 4 + 3]::DOUBLE + 0.5) * 256), 0), 255)::INT AS b,
    least(greatest(floor((v[p * 4 + 4]::DOUBLE + 0.5) * 256), 0), 255)::INT AS a
  FROM lv)"""


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pixels` with alpha 0 below 128, else 255."""
    return pixels(spark, sf_dir).withColumn("a", F.when(F.col("a") < 128, 0).otherwise(255))


KEYED = PIXELS + ", keyed AS (SELECT frame, x, y, r, g, b, CASE WHEN a < 128 THEN 0 ELSE 255 END::INT AS a FROM pixels)"


def canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, x, y, n: events of a user by hour (x of 24) and day of month (y of 31); absent pixels are transparent. One aggregate."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("frame"), F.hour("ts").alias("x"), (F.dayofmonth("ts") - 1).alias("y")).agg(F.count("*").alias("n"))


CANVAS = "canvas AS (SELECT user_id AS frame, hour(ts)::INT AS x, (day(ts) - 1)::INT AS y, count(*) AS n FROM events GROUP BY ALL)"

#: Animation tags over frames 0..: (order, name, from, to, direction, fps). Some overlap, one is inverted, one lies outside.
TAG_ROWS = [
    (0, "idle", 0, 3, "forward", 10.0), (1, "walk", 4, 11, "pingpong", 12.0), (2, "run", 16, 9, "reverse", 24.0),
    (3, "jump", 20, 24, "pingpong-reverse", 8.0), (4, "far", 900000, 900010, "forward", 5.0), (5, "blink", 30, 30, "pingpong", 0.0),
]


def tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAG_ROWS, "ord int, name string, from_f int, to_f int, direction string, fps double")


TAGS = "tags(ord, name, from_f, to_f, direction, fps) AS (VALUES " + ", ".join(f"({o}, '{n}', {a}, {b}, '{d}', {f}::DOUBLE)" for o, n, a, b, d, f in TAG_ROWS) + ")"

"""Queries of loops and held frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import loops as op
from rasterloom.plans.registry import plan
from rasterloom.plans.relations import table

_CLIPS = """li AS (SELECT l_orderkey // 40 AS clip, l_orderkey % 40 AS i, sum(l_quantity)::BIGINT AS q, count(*) AS k FROM lineitem GROUP BY 1, 2),
 fr AS (SELECT clip, i, [q % 7 * 6, k * 5 % 20, i % 5 * 9] AS v FROM li),
 ds AS (SELECT x.clip, x.i AS a, y.i AS b, (abs(x.v[1] - y.v[1]) + abs(x.v[2] - y.v[2]) + abs(x.v[3] - y.v[3])) / 3 AS d FROM fr x JOIN fr y ON x.clip = y.clip AND x.i < y.i)"""


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of up to 40 frames with three numbers each."""
    key = F.col("l_orderkey")
    sums = table(spark, sf_dir, "lineitem").groupBy(F.floor(key / 40).alias("clip"), (key % 40).cast("int").alias("i")).agg(F.sum("l_quantity").cast("long").alias("q"), F.count("*").alias("k"))
    return sums.select("clip", "i", F.array(F.col("q") % 7 * 6, F.col("k") * 5 % 20, F.col("i").cast("long") % 5 * 9).alias("v"))


@plan(f"""WITH {_CLIPS}, n AS (SELECT clip, max(i) AS n FROM fr GROUP BY 1), m AS (SELECT *, max(d) OVER (PARTITION BY clip, a ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS motion FROM ds),
 c AS (SELECT m.clip, m.a, m.b, (m.d + e.d) / 2 AS score, (m.b - m.a) * 0.1::DOUBLE AS seconds, motion FROM m JOIN ds e ON e.clip = m.clip AND e.a = m.a + 1 AND e.b = m.b + 1 JOIN n ON n.clip = m.clip
  WHERE m.b >= m.a + 2 AND m.a < n.n - 2 AND m.b - m.a BETWEEN 3 AND 20),
 g AS (SELECT * FROM c WHERE score <= 8 AND motion >= greatest(2, score * 2.5)), best AS (SELECT clip, min(score) AS best FROM g GROUP BY 1),
 k AS (SELECT g.*, row_number() OVER (PARTITION BY g.clip ORDER BY seconds, score, a, b) AS r FROM g JOIN best USING (clip) WHERE score <= best + greatest(0.5, best * 0.15))
 SELECT clip, a::INT AS first, b::INT AS last, round(score, 6) AS score, round(seconds, 6) AS seconds FROM k WHERE r = 1""")
def suggested_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _clips(spark, sf_dir)
    found = op.suggested(op.all_distances(frames), frames, 0.1, 0.3, 2.0)
    return found.select("clip", "first", "last", F.round("score", 6).alias("score"), F.round("seconds", 6).alias("seconds"))


@plan()
def merged_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.merged(_clips(spark, sf_dir), 6.0)


_HELD = "held AS (SELECT l_orderkey // 40 AS clip, (l_orderkey % 40)::INT AS i, l_orderkey % 40 * 100 AS start_ms, l_orderkey % 40 * 100 + 100 AS end_ms FROM lineitem GROUP BY l_orderkey)"


@plan(f"""WITH {_HELD}, f AS (SELECT clip, min(start_ms) AS t0, max(start_ms) AS t1, max(end_ms) AS e, count(*) AS n FROM held GROUP BY 1),
 q AS (SELECT clip, t0 + (t1 - t0) * k / 7 AS t FROM f, (SELECT unnest(range(0, 8)) AS k) WHERE n > 8),
 s AS (SELECT DISTINCT q.clip, max(h.start_ms) AS start_ms FROM q JOIN held h ON h.clip = q.clip AND h.start_ms <= q.t GROUP BY q.clip, q.t),
 k AS (SELECT clip, start_ms FROM s UNION ALL SELECT clip, start_ms FROM held JOIN f USING (clip) WHERE n <= 8)
 SELECT clip, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY clip ORDER BY start_ms), e) AS end_ms FROM k JOIN f USING (clip)""")
def thinned_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey")
    held = table(spark, sf_dir, "lineitem").select(F.floor(key / 40).alias("clip"), (key % 40).cast("int").alias("i"), (key % 40 * 100).alias("start_ms"), (key % 40 * 100 + 100).alias("end_ms")).distinct()
    return op.thinned(held, 8)

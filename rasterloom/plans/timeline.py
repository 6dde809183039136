"""Queries of timing, tags and keyframes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.scalars import fps_to_ms, gif_delay
from rasterloom.operators import timeline
from rasterloom.plans.registry import plan
from rasterloom.plans.relations import TAGS, table, tags

_HOLDS = "holds AS (SELECT o_orderkey AS frame, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 1000 END AS hold FROM orders)"


def holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice") / 1000).alias("hold"))


@plan(f"WITH {_HOLDS} SELECT frame, coalesce(CASE WHEN hold > 0 THEN hold END, 83) AS ms FROM holds")
def frame_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.resolve_durations(holds(spark, sf_dir), 12)


@plan("SELECT l_orderkey, l_linenumber, floor(1000 / greatest(l_quantity, 1) + 0.5)::INT AS ms, greatest(20, floor(floor(1000 / greatest(l_quantity, 1) + 0.5) / 10 + 0.5) * 10)::INT AS gif_ms FROM lineitem")
def fps_and_gif_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = fps_to_ms(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ms.alias("ms"), gif_delay(ms).alias("gif_ms"))


_SPECS = [(0, "3=250"), (1, "2-5=120"), (2, "900-7=40"), (3, "x=5"), (4, "4=0"), (5, "-3=90")]


@plan("SELECT * FROM (VALUES (0, '3=250', 3, 3, 250), (1, '2-5=120', 2, 5, 120), (2, '900-7=40', 7, 99, 40), (3, 'x=5', NULL, NULL, NULL), (4, '4=0', NULL, NULL, NULL), (5, '-3=90', 0, 0, 90)) t(ord, spec, from_f, to_f, ms)")
def duration_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.parse_duration_specs(spark.createDataFrame(_SPECS, "ord int, spec string"), 100)
    ok = F.col("ms").isNotNull()
    return found.select("ord", "spec", F.when(ok, F.col("from_f")).alias("from_f"), F.when(ok, F.col("to_f")).alias("to_f"), "ms")


@plan(f"""WITH {_HOLDS} SELECT frame, CASE WHEN frame = 0 THEN 90 WHEN frame BETWEEN 7 AND 99 THEN 40 WHEN frame BETWEEN 2 AND 5 THEN 120 ELSE hold END::DOUBLE AS hold FROM holds""")
def duration_specs_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = timeline.parse_duration_specs(spark.createDataFrame(_SPECS, "ord int, spec string"), 100)
    return timeline.apply_duration_specs(holds(spark, sf_dir), specs)


_NORM = f"""WITH {TAGS}, norm AS (SELECT ord, name, greatest(0, least(from_f, to_f)) AS from_f, least(499, greatest(from_f, to_f)) AS to_f, direction, CASE WHEN fps > 0 THEN fps ELSE 12 END AS fps
 FROM tags WHERE greatest(from_f, to_f) >= 0 AND least(from_f, to_f) <= 499)"""


@plan(_NORM + " SELECT * FROM norm")
def normalized_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.normalized_tags(tags(spark), 500)


@plan(_NORM + """, f AS (SELECT name, direction, range(from_f, to_f + 1) AS fw FROM norm),
 p AS (SELECT name, CASE WHEN direction = 'reverse' THEN list_reverse(fw) WHEN direction = 'pingpong' AND len(fw) > 2 THEN fw || list_reverse(fw[2:-2])
  WHEN direction = 'pingpong-reverse' AND len(fw) > 2 THEN list_reverse(fw) || fw[2:-2] WHEN direction = 'pingpong-reverse' THEN list_reverse(fw) ELSE fw END AS s FROM f)
 SELECT name, unnest(range(0, len(s)))::INT AS step, unnest(s)::INT AS frame FROM p""")
def tag_playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.playback(timeline.normalized_tags(tags(spark), 500))


@plan(_NORM + f""", {_HOLDS}, c AS (SELECT h.frame, h.hold, arg_min(n.fps, n.ord) AS fps FROM holds h LEFT JOIN norm n ON h.frame BETWEEN n.from_f AND n.to_f GROUP BY 1, 2)
 SELECT frame, coalesce(CASE WHEN hold > 0 THEN greatest(1, floor(hold + 0.5)) END, greatest(1, floor(1000 / fps + 0.5)), 83)::INT AS ms FROM c""")
def attached_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.attached_durations(holds(spark, sf_dir), timeline.normalized_tags(tags(spark), 500))


_LINES = "li AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2)"
_SEQ = _LINES + """, seq AS (SELECT l_orderkey AS clip, l_linenumber AS step, (20 + l_quantity)::BIGINT AS ms FROM li),
 iv AS (SELECT *, sum(ms) OVER (PARTITION BY clip ORDER BY step ROWS UNBOUNDED PRECEDING)::BIGINT AS end_ms FROM seq)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with one row for each order and number."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_extendedprice").alias("l_extendedprice"))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").alias("step"), (F.col("l_quantity") + 20).cast("long").alias("ms"))
    return timeline.intervals(rows, "clip", "step")


@plan(f"WITH {_SEQ} SELECT clip, step, end_ms - ms AS start_ms, end_ms FROM iv")
def frame_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).select("clip", "step", "start_ms", "end_ms")


@plan(f"""WITH {_SEQ}, tot AS (SELECT clip, max(end_ms) AS total FROM iv GROUP BY 1), q AS (SELECT o_orderkey AS clip, floor(o_totalprice)::BIGINT AS t FROM orders),
 a AS (SELECT clip, t, t % total AS tt FROM q JOIN tot USING (clip)) SELECT a.clip, a.t, iv.step FROM a JOIN iv ON a.clip = iv.clip AND tt >= end_ms - ms AND tt < end_ms""")
def frame_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip"), F.floor("o_totalprice").cast("long").alias("t"))
    return timeline.frame_at(_sequences(spark, sf_dir), times, "clip", 100).select("clip", "t", "step")


@plan(f"""WITH {_LINES}, k AS (SELECT l_orderkey AS clip, l_linenumber::DOUBLE AS t, l_extendedprice AS v FROM li),
 p AS (SELECT o_orderkey AS clip, unnest([0.5, 1.5, 2.25, 9.0])::DOUBLE AS t FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)),
 b AS (SELECT p.clip, p.t, arg_max(k.t, k.t) FILTER (k.t <= p.t) AS t0, arg_max(k.v, k.t) FILTER (k.t <= p.t) AS v0, arg_min(k.t, k.t) FILTER (k.t >= p.t) AS t1, arg_min(k.v, k.t) FILTER (k.t >= p.t) AS v1 FROM p JOIN k USING (clip) GROUP BY 1, 2)
 SELECT clip, t, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t1 > t0 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) ELSE v0 END, 6) AS v FROM b""")
def sampled_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").cast("double").alias("t"), F.col("l_extendedprice").alias("v"))
    points = keys.select("clip").distinct().select("clip", F.explode(F.array(*[F.lit(t) for t in (0.5, 1.5, 2.25, 9.0)])).alias("t"))
    return timeline.sampled(keys, points, "clip", 7.0).select("clip", "t", F.round("v", 6).alias("v"))


@plan(f"""WITH {_SEQ} SELECT clip, step, greatest(end_ms - ms, 30) AS start_ms, least(end_ms, 120) AS end_ms FROM iv WHERE least(end_ms, 120) > greatest(end_ms - ms, 30)""")
def trimmed_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.trimmed(_sequences(spark, sf_dir).select("clip", "step", "start_ms", "end_ms"), 30, 120).select("clip", "step", F.col("start_ms").cast("long"), F.col("end_ms").cast("long"))


@plan(f"""WITH {_LINES}, s AS (SELECT l_orderkey AS clip, l_linenumber AS step, l_quantity / 3 AS ms FROM li), t AS (SELECT clip, step, floor(sum(ms) OVER (PARTITION BY clip ORDER BY step ROWS UNBOUNDED PRECEDING) + 0.5)::BIGINT AS u FROM s)
 SELECT clip, step, u - coalesce(lag(u) OVER (PARTITION BY clip ORDER BY step), 0) AS whole_ms FROM t""")
def inbetween_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").alias("step"), (F.col("l_quantity") / 3).alias("ms"))
    return timeline.spread_rounding(rows, "clip", "step", "ms").select("clip", "step", "whole_ms")


@plan("""WITH r AS (SELECT l_orderkey AS clip, l_linenumber AS step, l_returnflag AS f, l_linenumber - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS run FROM lineitem)
 SELECT clip, f, min(step) AS first, max(step) AS last, count(*) AS length FROM r GROUP BY clip, f, run""")
def runs_of_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").alias("step"), F.col("l_returnflag").alias("f"))
    return timeline.runs(rows, ["clip"], "step", "f")


@plan("SELECT o_orderkey AS clip, unnest(range(0, 8))::INT AS i, unnest(range(0, 8)) / (CASE WHEN o_orderkey % 2 = 0 THEN 8 ELSE 7 END) AS phase FROM orders")
def export_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An even grid of phases: a loop leaves out its end."""
    n = F.when(F.col("o_orderkey") % 2 == 0, 8).otherwise(7)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"), n.alias("n")).select("clip", "i", (F.col("i") / F.col("n")).alias("phase"))


@plan("""WITH c AS (SELECT s_suppkey AS clip, unnest(range(0, 12)) AS f FROM supplier), d AS (SELECT clip, f, (f - clip % 12 + 24) % 12 AS a FROM c), e AS (SELECT clip, f, least(a, 12 - a) AS cost FROM d WHERE f % 5 = 0)
 SELECT clip, min(struct_pack(cost := cost, f := f)).f::INT AS frame FROM e GROUP BY 1""")
def idle_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the frames 0, 5 and 10 of a cycle of 12, the one nearest to where a clip stands, either way round; the first of equals."""
    clips = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("clip"), F.explode(F.array(F.lit(0), F.lit(5), F.lit(10))).alias("f"))
    ahead = F.pmod(F.col("f") - F.col("clip"), F.lit(12))
    return clips.groupBy("clip").agg(F.min(F.struct(F.least(ahead, 12 - ahead).alias("cost"), F.col("f"))).getField("f").alias("frame"))

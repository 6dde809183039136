"""Queries of poses and motion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.scalars import wrapped_angle
from rasterloom.operators import motion as op
from rasterloom.plans.registry import plan
from rasterloom.plans.relations import table

#: Keys of the clips walk and run: (clip, joint, t, angle).
_KEYS = [(c, j, t, float((i * 97 + k * 53) % 359 - 179)) for i, (c, j) in enumerate([("walk", "torso"), ("walk", "front-thigh"), ("run", "torso"), ("run", "front-thigh")]) for k, t in enumerate([0.0, 0.25, 0.5, 1.0])]
_KEYS_SQL = "keys(clip, joint, t, angle) AS (VALUES " + ", ".join(f"('{c}', '{j}', {t}::DOUBLE, {a}::DOUBLE)" for c, j, t, a in _KEYS) + ")"
_WRAP = lambda x: f"((({x}) + 180) - floor((({x}) + 180) / 360) * 360 - 180)"
_SAMPLES = f"""{_KEYS_SQL}, w AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'walk' ELSE 'run' END AS clip, (p_size / 20.0 - 0.5)::DOUBLE AS phase, p_partkey % 3 = 0 AS lp FROM part),
 tm AS (SELECT id, clip, CASE WHEN lp AND (phase < 0 OR phase > 1) THEN phase - floor(phase) ELSE greatest(0, least(1, phase)) END::DOUBLE AS s FROM w),
 seg AS (SELECT clip, joint, t AS t0, angle AS a0, lead(t) OVER v AS t1, lead(angle) OVER v AS a1 FROM keys WINDOW v AS (PARTITION BY clip, joint ORDER BY t)),
 sam AS (SELECT id, joint, a0 + {_WRAP('a1 - a0')} * ((s - t0) / (t1 - t0)) AS angle FROM tm JOIN seg USING (clip) WHERE t1 IS NOT NULL AND ((s > t0 AND s <= t1) OR (t0 = 0 AND s = 0)))"""


def _keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_KEYS, "clip string, joint string, t double, angle double")


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    wanted = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 2 == 0, "walk").otherwise("run").alias("clip"), (F.col("p_size") / F.lit(20.0) - 0.5).alias("phase"), (k % 3 == 0).alias("loop"))
    return op.sampled(_keys(spark), wanted)


@plan(f"WITH {_SAMPLES} SELECT id, joint, round(angle, 7) AS angle FROM sam")
def motion_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joints of each part's clip at its phase."""
    return _sampled(spark, sf_dir).withColumn("angle", F.round("angle", 7))


@plan(f"""WITH {_SAMPLES}, o AS (SELECT id, joint, angle, CASE joint WHEN 'torso' THEN 100.0 ELSE -60.0 END::DOUBLE AS y, least(1, greatest(0, id % 5 / 3.0))::DOUBLE AS w FROM sam)
 SELECT id, joint, round(CASE WHEN joint = 'torso' THEN angle + {_WRAP('y - angle')} * w ELSE angle END, 7) AS angle FROM o""")
def blended_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples mixed with one pose of the upper body, by weights of which some are above 1."""
    a = _sampled(spark, sf_dir)
    b = a.select("id", "joint", F.when(F.col("joint") == "torso", 100.0).otherwise(-60.0).alias("angle"))
    return op.blended(a, b, F.col("id") % 5 / F.lit(3.0), upper=True).withColumn("angle", F.round("angle", 7))


@plan(f"SELECT p_partkey, {_WRAP('p_partkey * 37.5 - 4000')}::DOUBLE AS angle, CASE WHEN least(p, 1 - p) / 0.12 >= 1 THEN 1 ELSE round(pow(least(p, 1 - p) / 0.12, 2) * (3 - 2 * least(p, 1 - p) / 0.12), 9) END::DOUBLE AS envelope FROM (SELECT p_partkey, (p_size / 50.0)::DOUBLE AS p FROM part)")
def wrapped_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles in one turn, and how much an action counts at a phase."""
    return table(spark, sf_dir, "part").select("p_partkey", wrapped_angle(F.col("p_partkey") * F.lit(37.5) - 4000).alias("angle"), F.round(op.action_envelope(F.col("p_size") / F.lit(50.0)), 9).alias("envelope"))


_NAMES = ["body", "head", "coat-torso", "sword", "needle", "tail", "hat", "front-leg", "hand"]


@plan(f"""WITH s AS (SELECT p_partkey // 10 AS character, p_partkey AS ord, ({_NAMES!r})[(p_partkey % 9 + 1)::INT] AS part FROM part),
 j AS (SELECT *, CASE part WHEN 'body' THEN 'torso' WHEN 'coat-torso' THEN 'torso' WHEN 'head' THEN 'head' WHEN 'sword' THEN 'weapon' WHEN 'needle' THEN 'weapon' WHEN 'tail' THEN 'tail' WHEN 'front-leg' THEN 'front-thigh' WHEN 'hand' THEN 'front-hand' END AS joint FROM s)
 SELECT character, joint, arg_min(part, ord) AS part FROM j WHERE joint IS NOT NULL GROUP BY 1, 2""")
def bound_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joints that the parts of characters stand for by their names."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(F.floor(k / 10).alias("character"), k.alias("ord"), F.get(F.array(*map(F.lit, _NAMES)), (k % 9).cast("int")).alias("part"))
    return op.bound(parts)


@plan("""WITH s AS (SELECT p_partkey, (p_partkey % 40 - 20)::DOUBLE AS gx, (p_size + 1)::DOUBLE AS gy FROM part), d AS (SELECT *, greatest(4.001::DOUBLE, least(27.999::DOUBLE, sqrt(gx * gx + gy * gy))) AS reach, atan2(gy, gx) AS way FROM s),
 u AS (SELECT *, way - acos(greatest(-1, least(1, (144 + reach * reach - 256) / (24 * reach)))) AS first FROM d)
 SELECT p_partkey, round(degrees(first), 6) AS "upper", round(degrees(atan2(sin(way) * reach - sin(first) * 12, cos(way) * reach - cos(first) * 12)), 6) AS "lower", round(reach, 6) AS reach FROM u""")
def leg_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs of 12 and 16 that reach for points below the hip."""
    goal = (F.col("p_partkey") % 40 - 20).cast("double"), (F.col("p_size") + 1).cast("double")
    found = table(spark, sf_dir, "part").select("p_partkey", op.two_bone((F.lit(0.0), F.lit(0.0)), goal, F.lit(12.0), F.lit(16.0)).alias("t"))
    return found.select("p_partkey", *[F.round(f"t.{c}", 6).alias(c) for c in ("upper", "lower", "reach")])


@plan()
def posed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of ten parts, each part in the one of half its number."""
    k, n = F.col("p_partkey"), F.col("p_partkey") % 10
    parts = table(spark, sf_dir, "part").select(F.floor(k / 10).alias("character"), n.cast("string").alias("part"), F.when(n > 0, F.floor(n / 2)).cast("string").alias("parent"), (k % 7).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"), (k * 31 % 360).cast("double").alias("angle"))
    return op.pose_transforms(parts)

"""Frame timing, tag playback, keyframe sampling and loop selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.functions.scalars import fps_to_ms, round_half_up


def resolve_durations(frames: DataFrame, fps: float) -> DataFrame:
    """frames (frame, hold): the hold where it is positive and finite, else the time of a frame at fps."""
    hold = F.col("hold")
    own = F.when((hold > 0) & ~F.isnan(hold) & (hold != float("inf")), hold)
    return frames.select("frame", F.coalesce(own, fps_to_ms(F.lit(float(fps))).cast("double")).alias("ms"))


def parse_duration_specs(specs: DataFrame, frames: int) -> DataFrame:
    """specs (ord, spec) such as "3=250" or "2-5=250": from_f, to_f clamped to the frames, and ms. Others are errors (null ms)."""
    span = r"^\s*(-?\d+)(?:-(-?\d+))?\s*=\s*(\d+)\s*$"
    part = lambda i: F.expr(f"try_cast(nullif(regexp_extract(spec, r'{span}', {i}), '') as int)")
    clamp = lambda c: F.greatest(F.lit(0), F.least(c, F.lit(max(0, frames - 1))))
    a, b = clamp(part(1)), clamp(F.coalesce(part(2), part(1)))
    return specs.select("ord", "spec", F.least(a, b).alias("from_f"), F.greatest(a, b).alias("to_f"), F.when(part(3) > 0, part(3)).alias("ms"))


def apply_duration_specs(frames: DataFrame, specs: DataFrame) -> DataFrame:
    """frames (frame, hold) with the last spec that covers each; specs are a handful of ranges, exploded to equal keys."""
    each = specs.where("ms is not null").select(F.explode(F.sequence("from_f", "to_f")).alias("frame"), "ord", "ms")
    last = each.groupBy("frame").agg(F.max_by("ms", "ord").alias("ms"))
    return frames.join(last, "frame", "left").select("frame", F.coalesce(F.col("ms").cast("double"), "hold").alias("hold"))


def expanded_tag(start: Column, end: Column, direction: Column) -> Column:
    """The frames that a tag plays, in order. Ping-pong does not repeat its ends; with up to two frames it is the first pass alone."""
    forward = F.sequence(start, end)
    back = F.reverse(forward)
    inner = F.slice(forward, 2, F.greatest(F.size(forward) - 2, F.lit(0)))
    return (
        F.when(direction == "reverse", back)
        .when((direction == "pingpong") & (F.size(forward) > 2), F.concat(forward, F.reverse(inner)))
        .when((direction == "pingpong-reverse") & (F.size(forward) > 2), F.concat(back, inner))
        .when(direction == "pingpong-reverse", back)
        .otherwise(forward)
    )


def normalized_tags(tags: DataFrame, frames: int, fps: float = 12.0) -> DataFrame:
    """Ends in order and clamped, tags outside the sheet dropped, rates of null or below zero replaced."""
    lo, hi = F.least("from_f", "to_f"), F.greatest("from_f", "to_f")
    last = frames - 1
    known = F.when(F.col("direction").isin("reverse", "pingpong", "pingpong-reverse"), F.col("direction")).when(F.col("direction") == "pingpong_reverse", "pingpong-reverse").otherwise("forward")
    return tags.where((hi >= 0) & (lo <= last)).select("ord", "name", F.greatest(F.lit(0), lo).alias("from_f"), F.least(F.lit(last), hi).alias("to_f"), known.alias("direction"), F.when(F.col("fps") > 0, F.col("fps")).otherwise(fps).alias("fps"))


def playback(tags: DataFrame) -> DataFrame:
    """name, step, frame in playing order."""
    return tags.select("name", F.posexplode(expanded_tag(F.col("from_f"), F.col("to_f"), F.col("direction"))).alias("step", "frame"))


def attached_durations(frames: DataFrame, tags: DataFrame, fps: float = 12.0) -> DataFrame:
    """frames (frame, hold): the hold, else the time of the first tag that covers the frame, else the default."""
    ms = lambda rate: F.greatest(F.lit(1), round_half_up(1000 / rate).cast("int"))
    each = tags.select(F.explode(F.sequence("from_f", "to_f")).alias("frame"), "ord", "fps")
    first = each.groupBy("frame").agg(F.min_by("fps", "ord").alias("fps"))
    own = F.when(F.col("hold") > 0, F.greatest(F.lit(1), round_half_up(F.col("hold")).cast("int")))
    return frames.join(first, "frame", "left").select("frame", F.coalesce(own, ms(F.col("fps")), ms(F.lit(fps))).alias("ms"))


def intervals(frames: DataFrame, by: str, order: str, ms: str = "ms") -> DataFrame:
    """Adds start_ms and end_ms of each frame within its sequence."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(ms).over(w)
    return frames.withColumn("end_ms", end).withColumn("start_ms", F.col("end_ms") - F.col(ms))


def frame_at(sequences: DataFrame, times: DataFrame, by: str, most_ms: int) -> DataFrame:
    """The frame that shows at each (by, t), where time wraps at the sequence's end.

    The range join is an equi-join on (by, slice of time), as intervals are cut at multiples of most_ms.
    """
    total = sequences.groupBy(by).agg(F.max("end_ms").alias("total"))
    asked = times.join(total, by).withColumn("at", F.pmod("t", "total")).withColumn("slot", F.floor(F.col("at") / most_ms))
    cut = sequences.withColumn("slot", F.explode(F.sequence(F.floor(F.col("start_ms") / most_ms), F.floor((F.col("end_ms") - 1) / most_ms))))
    return asked.join(cut, [by, "slot"]).where("at >= start_ms and at < end_ms").drop("slot", "total")


def sampled(keys: DataFrame, points: DataFrame, by: str, most: float) -> DataFrame:
    """Linear interpolation of keyframes (by, t, v) at (by, t): the ends hold. An as-of join by one window over both."""
    rows = keys.select(by, "t", F.col("v"), F.lit(0).alias("kind")).unionByName(points.select(by, "t", F.lit(None).cast("double").alias("v"), F.lit(1).alias("kind")))
    before = W.partitionBy(by).orderBy("t", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy(by).orderBy("t", F.desc("kind")).rowsBetween(W.currentRow, W.unboundedFollowing)
    key = F.when(F.col("kind") == 0, F.struct("t", "v"))
    rows = rows.withColumn("p", F.last(key, True).over(before)).withColumn("n", F.first(key, True).over(after)).where("kind = 1")
    span = F.col("n.t") - F.col("p.t")
    mid = F.when(span > 0, F.col("p.v") + (F.col("n.v") - F.col("p.v")) * (F.col("t") - F.col("p.t")) / span).otherwise(F.col("p.v"))
    return rows.select(by, "t", F.when(F.col("p").isNull(), F.col("n.v")).when(F.col("n").isNull(), F.col("p.v")).otherwise(mid).alias("v"))


def trimmed(samples: DataFrame, start: int, end: int) -> DataFrame:
    """Sample intervals (start_ms, end_ms) cut to a trim; empty ones go."""
    return samples.withColumn("start_ms", F.greatest("start_ms", F.lit(start))).withColumn("end_ms", F.least("end_ms", F.lit(end))).where("end_ms > start_ms")


def spread_rounding(frames: DataFrame, by: str, order: str, ms: str) -> DataFrame:
    """Whole milliseconds of real ones so that no rounding adds up: differences of the rounded running sum."""
    w = W.partitionBy(by).orderBy(order)
    total = round_half_up(F.sum(ms).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return frames.withColumn("__total", total).withColumn("whole_ms", (F.col("__total") - F.coalesce(F.lag("__total").over(w), F.lit(0))).cast("long")).drop("__total")


def runs(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Gaps and islands: (by, value, first, last, length) of runs of equal values at consecutive places."""
    w = W.partitionBy(*by, value).orderBy(order)
    keyed = rows.withColumn("__run", F.col(order) - F.row_number().over(w))
    return keyed.groupBy(*by, value, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("__run")

"""Loops in clips, and merging of frames that hardly change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def all_distances(frames: DataFrame) -> DataFrame:
    """(clip, a, b, d) of frames (clip, i, v): mean absolute differences of all frames a < b of a clip, which has at most 120."""
    one, other = frames.select("clip", F.col("i").alias("a"), F.col("v").alias("va")), frames.select("clip", F.col("i").alias("b"), F.col("v").alias("vb"))
    total = F.aggregate(F.zip_with("va", "vb", lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x)
    return one.join(other, "clip").where("a < b").select("clip", "a", "b", (total / F.size("va")).alias("d"))


def suggested(distances: DataFrame, frames: DataFrame, step_s: float, least_s: float, most_s: float, most_score: float = 8.0) -> DataFrame:
    """(clip, first, last, score, seconds): where a clip may loop, if it may.

    A candidate's score is the mean of the distances of its ends and of the frames after them. It must be small, and the motion inside
    (the largest distance from its first frame) must exceed it. Of the candidates near the best score the shortest is taken.
    """
    inside = F.max("d").over(W.partitionBy("clip", "a").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    moved = distances.withColumn("motion", inside)
    after = distances.select("clip", (F.col("a") - 1).alias("a"), (F.col("b") - 1).alias("b"), F.col("d").alias("d2"))
    last = frames.groupBy("clip").agg(F.max("i").alias("n"))
    found = moved.join(after, ["clip", "a", "b"]).join(last, "clip").withColumn("score", (F.col("d") + F.col("d2")) / 2).withColumn("seconds", (F.col("b") - F.col("a")) * step_s)
    found = found.where((F.col("b") >= F.col("a") + 2) & (F.col("a") < F.col("n") - 2) & F.col("seconds").between(least_s - 1e-9, most_s + 1e-9) & (F.col("score") <= most_score))
    found = found.where(F.col("motion") >= F.greatest(F.lit(2.0), F.col("score") * 2.5))
    best = found.groupBy("clip").agg(F.min("score").alias("best"))
    near = found.join(best, "clip").where(F.col("score") <= F.col("best") + F.greatest(F.lit(0.5), F.col("best") * 0.15))
    pick = F.min(F.struct("seconds", "score", "a", "b"))
    return near.groupBy("clip").agg(pick.alias("p")).select("clip", F.col("p.a").alias("first"), F.col("p.b").alias("last"), "p.score", "p.seconds")


def merged(frames: DataFrame, most: float) -> DataFrame:
    """(clip, i, rep): each frame joins the frame kept last if it differs by at most `most` from it, else it is kept. One clip at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for clip, rows in batch.itertuples(index=False):
                kept = None
                for row in rows:
                    v = np.asarray(row["v"], float)
                    if kept is None or np.abs(v - kept[1]).mean() > most:
                        kept = (row["i"], v)
                    out.append((clip, row["i"], kept[0]))
            yield pd.DataFrame(out, columns=["clip", "i", "rep"])

    whole = frames.groupBy("clip").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("rows"))
    return whole.mapInPandas(run, "clip long, i int, rep int")


def thinned(held: DataFrame, most: int) -> DataFrame:
    """Held frames (clip, i, start_ms, end_ms), at most `most` of a clip: those that show at even times, the last one too; their times reach
    to the next one that stays. Counts are literals, so the times are exploded and matched by one window."""
    facts = held.groupBy("clip").agg(F.min("start_ms").alias("t0"), F.max("start_ms").alias("t1"), F.max("end_ms").alias("end"), F.count("*").alias("n"))
    long = facts.where(F.col("n") > most)
    times = long.select("clip", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("k"), "t0", "t1").select("clip", (F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("k") / (most - 1)).alias("t"))
    both = held.select("clip", F.col("start_ms").cast("double").alias("t"), "start_ms", F.lit(0).alias("kind")).unionByName(times.select("clip", "t", F.lit(None).cast("long").alias("start_ms"), F.lit(1).alias("kind")))
    shown = both.withColumn("s", F.last("start_ms", True).over(W.partitionBy("clip").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)))
    chosen = shown.where("kind = 1").select("clip", F.col("s").alias("start_ms")).distinct().join(facts, "clip")
    short = held.join(facts.where(F.col("n") <= most), "clip").select("clip", "start_ms", "end")
    kept = chosen.select("clip", "start_ms", "end").unionByName(short)
    return kept.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(W.partitionBy("clip").orderBy("start_ms")), "end")).drop("end")

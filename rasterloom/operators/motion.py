"""Poses of jointed characters: sampling of clips, blending, transforms down a tree of parts, and two-bone targets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scalars import wrapped_angle

# Joints that an action of the upper body moves, and names of parts that stand for a joint.
UPPER = "torso head front-arm front-forearm front-hand rear-arm rear-forearm rear-hand weapon cape".split()
ALIASES = {
    "torso": "torso body coat-torso", "head": "head", "front-arm": "upper-arm sword-upper-arm front-arm", "front-forearm": "forearm sword-forearm front-forearm",
    "front-hand": "hand sword-hand front-hand", "rear-arm": "rear-arm rear-upper-arm free-upper-arm", "rear-forearm": "rear-forearm free-forearm", "rear-hand": "rear-hand free-hand",
    "front-thigh": "front-thigh front-leg", "front-shin": "front-shin", "front-foot": "front-foot", "rear-thigh": "rear-thigh rear-leg", "rear-shin": "rear-shin", "rear-foot": "rear-foot",
    "tail": "tail", "cape": "cape", "weapon": "weapon sword needle",
}


def lerp(a: Column, b: Column, weight: Column) -> Column:
    return a + (b - a) * weight


def angle_lerp(a: Column, b: Column, weight: Column) -> Column:
    """Between two angles, the shorter way."""
    return a + wrapped_angle(b - a) * weight


def clip_time(phase: Column, loop: Column) -> Column:
    """The time in a clip, 0..1: a loop begins again, others stay at their ends."""
    return F.when(loop & ((phase < 0) | (phase > 1)), F.pmod(phase, F.lit(1.0))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), phase)))


def sampled(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, joint, angle) of wanted (id, clip, phase, loop) from keys (clip, joint, t, angle), by the keys around the time; a clip's keys of
    a joint are one array."""
    tracks = keys.groupBy("clip", "joint").agg(F.sort_array(F.collect_list(F.struct("t", "angle"))).alias("track"))
    own = wanted.withColumn("at", clip_time(F.col("phase"), F.col("loop"))).join(tracks, "clip")
    # The first key after the first that is not before the time, else the last.
    place = F.size(F.filter(F.slice("track", 2, F.size("track")), lambda k: k["t"] < F.col("at")))
    high = F.least(place + 1, F.size("track") - 1)
    found = own.select("id", "joint", "at", F.get("track", F.greatest(F.lit(0), high - 1)).alias("a"), F.get("track", high).alias("b"))
    weight = F.when(F.col("a.t") == F.col("b.t"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("at") - F.col("a.t")) / (F.col("b.t") - F.col("a.t")))))
    return found.select("id", "joint", angle_lerp(F.col("a.angle"), F.col("b.angle"), weight).alias("angle"))


def blended(a: DataFrame, b: DataFrame, weight: Column, upper: bool = False) -> DataFrame:
    """Poses a and b (id, joint, angle) mixed by a weight of 0 to 1; a joint that one of them lacks is at 0 there. upper: only joints above the hips take part."""
    both = a.select("id", "joint", F.col("angle").alias("x")).join(b.select("id", "joint", F.col("angle").alias("y")), ["id", "joint"], "full")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))
    zero = F.lit(0.0)
    mixed = angle_lerp(F.coalesce("x", zero), F.coalesce("y", zero), share)
    return both.select("id", "joint", F.when(F.col("joint").isin(UPPER) if upper else F.lit(True), mixed).otherwise(F.coalesce("x", zero)).alias("angle"))


def action_envelope(phase: Column) -> Column:
    """How much an action counts at its phase: in and out over 12 hundredths, smoothly."""
    edge = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(phase, 1 - phase) / 0.12))
    return edge * edge * (3 - 2 * edge)


def bound(parts: DataFrame) -> DataFrame:
    """(character, joint, part) of parts (character, ord, part): the first part whose name stands for a joint."""
    rows = F.array(*[F.struct(F.lit(alias).alias("part"), F.lit(joint).alias("joint")) for joint, names in ALIASES.items() for alias in names.split()])
    table = parts.sparkSession.range(1).select(F.inline(rows))
    return parts.join(F.broadcast(table), "part").groupBy("character", "joint").agg(F.min_by("part", "ord").alias("part"))


def two_bone(hip: tuple[Column, Column], goal: tuple[Column, Column], upper: Column, lower: Column) -> Column:
    """(upper, lower, reach): directions in degrees of two bones from a hip to a goal, bent back, and the distance they reach."""
    dx, dy = goal[0] - hip[0], goal[1] - hip[1]
    reach = F.greatest(F.abs(upper - lower) + 0.001, F.least(upper + lower - 0.001, F.sqrt(dx * dx + dy * dy)))
    way = F.atan2(dy, dx)
    cosine = (upper * upper + reach * reach - lower * lower) / (upper * reach * 2)
    first = way - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    second = F.atan2(F.sin(way) * reach - F.sin(first) * upper, F.cos(way) * reach - F.cos(first) * upper)
    return F.struct(F.degrees(first).alias("upper"), F.degrees(second).alias("lower"), reach.alias("reach"))


def pose_transforms(parts: DataFrame) -> DataFrame:
    """(character, part, a, b, c, d, e, f): the matrix of each part (character, part, parent, x, y, angle), turned about its pivot by its
    angle after all that its parents do. A character is one task's group; parts whose parent is missing stand alone."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = {r.part: r for r in group.itertuples(index=False)}
        done: dict[str, np.ndarray] = {}

        def matrix(name: str) -> np.ndarray:
            chain = []
            while name in own and name not in done:
                chain.append(name)
                name = own[name].parent
                if name in chain:
                    raise ValueError("parts lie in each other")
            at = done.get(name, np.eye(3))
            for part in reversed(chain):
                r = own[part]
                cos, sin = np.cos(np.radians(r.angle)), np.sin(np.radians(r.angle))
                at = done[part] = at @ np.array([[cos, -sin, r.x - cos * r.x + sin * r.y], [sin, cos, r.y - sin * r.x - cos * r.y], [0, 0, 1]])
            return at

        rows = [(r.character, r.part, *matrix(r.part)[[0, 1, 0, 1, 0, 1], [0, 0, 1, 1, 2, 2]]) for r in group.itertuples(index=False)]
        return pd.DataFrame(rows, columns=["character", "part", *"abcdef"])

    return parts.groupBy("character").applyInPandas(run, "character long, part string, " + ", ".join(f"{c} double" for c in "abcdef"))

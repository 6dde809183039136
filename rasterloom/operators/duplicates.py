"""Duplicate frames, and what follows from them for tags and timing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signatures(pixels: DataFrame, part: str, frame: str) -> DataFrame:
    """(part, frame, sig): two 64-bit hashes of a frame's pixels, summed in any order on the map side; colours under no alpha are black."""
    value = lambda c: F.when(F.col("a") == 0, 0).otherwise(F.col(c))
    own = [F.col("x"), F.col("y"), value("r"), value("g"), value("b"), F.col("a")]
    sums = [F.bit_xor(F.xxhash64(*own)), F.bit_xor(F.xxhash64(F.lit("second"), *reversed(own))), F.count("*")]
    return pixels.groupBy(part, frame).agg(F.struct(*[s.alias(n) for s, n in zip(sums, ("one", "two", "n"), strict=True)]).alias("sig"))


def exact(signed: DataFrame, part: str, frame: str) -> DataFrame:
    """Adds rep: the first frame of the same part with the same signature.

    An aggregate with map-side minima and a join of one row a signature, so a signature of very many frames is no single task.
    """
    first = signed.groupBy(part, "sig").agg(F.min(frame).alias("rep"))
    return signed.join(first, [part, "sig"])


def renumbered(mapped: DataFrame, sheet: str, frame: str) -> DataFrame:
    """Adds new_index: the place of a frame's representative among those that stay."""
    kept = mapped.where(F.col(frame) == F.col("rep")).groupBy(sheet).agg(F.sort_array(F.collect_list("rep")).alias("kept"))
    return mapped.join(kept, sheet).withColumn("new_index", (F.array_position("kept", F.col("rep")) - 1).cast("int")).drop("kept")


def distances(pixels: DataFrame, part: str, frame: str, most: float) -> DataFrame:
    """(part, a, b, distance): mean absolute channel difference of frames a < b of a part, at most `most`.

    Frames are first sorted into slots by their sum of channels; only frames in equal or neighbouring slots can be that near,
    as the mean difference is at least the difference of the sums over their number. So pairs come from an equi-join on slots.
    """
    value = lambda c: F.when(F.col("a") == 0, 0).otherwise(F.col(c))
    row = F.array(value("r"), value("g"), value("b"), F.col("a"))
    frames = pixels.groupBy(part, frame).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", row.alias("v")))), lambda p: p["v"])).alias("v"))
    frames = frames.withColumn("total", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x)).withColumn("n", F.size("v"))
    slot = F.floor(F.col("total") / (F.col("n") * max(most, 1e-9)))
    one = frames.select(part, F.col(frame).alias("a"), F.col("v").alias("va"), "n", F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    other = frames.select(part, F.col(frame).alias("b"), F.col("v").alias("vb"), "n", slot.alias("slot"))
    pairs = one.join(other, [part, "slot", "n"]).where("a < b")
    gap = F.aggregate(F.zip_with("va", "vb", lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x) / F.col("n")
    return pairs.select(part, "a", "b", gap.alias("distance")).where(F.col("distance") <= most)


def greedy(frames: DataFrame, near: DataFrame, part: str, frame: str) -> DataFrame:
    """(part, frame, rep): in order of frames, each joins the first representative near it, or becomes one. One part at a time."""
    of = frames.groupBy(part).agg(F.sort_array(F.collect_list(frame)).alias("frames"))
    pairs = near.groupBy(part).agg(F.collect_list(F.struct("a", "b")).alias("pairs"))

    def walk(batches):
        for batch in batches:
            out = []
            for key, own, linked in batch.itertuples(index=False):
                before: dict[int, set[int]] = {}
                for p in linked if linked is not None else ():
                    before.setdefault(p["b"], set()).add(p["a"])
                reps: list[int] = []
                for f in own:
                    close = before.get(f, ())
                    rep = next((r for r in reps if r in close), f)
                    if rep == f:
                        reps.append(f)
                    out.append((key, f, rep))
            yield pd.DataFrame(out, columns=[part, frame, "rep"])

    return of.join(pairs, part, "left").select(part, "frames", "pairs").mapInPandas(walk, f"{part} long, {frame} long, rep long")


def tag_partitions(frames: DataFrame, tags: DataFrame, frame: str, none: int, block: int = 4096) -> DataFrame:
    """Adds owner: the order of the first tag that covers a frame, else `none`. Tags are exploded to the blocks of frames that they
    touch, so that a tag of any length is an equi-join on blocks."""
    lo, hi = F.greatest(F.lit(0), F.least("from_f", "to_f")), F.greatest("from_f", "to_f")
    each = tags.where(hi >= lo).select(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), "ord", F.explode(F.sequence(F.floor(lo / block), F.floor(hi / block))).alias("__block"))
    placed = frames.select(F.col(frame).alias("__frame"), F.floor(F.col(frame) / block).alias("__block")).distinct().join(each, "__block").where("__frame between lo and hi")
    first = placed.groupBy("__frame").agg(F.min("ord").alias("owner"))
    return frames.join(first, F.col(frame) == F.col("__frame"), "left").drop("__frame").withColumn("owner", F.coalesce("owner", F.lit(none)))


def remapped_tags(tags: DataFrame, mapping: DataFrame, frames: int, *by: str) -> DataFrame:
    """(by.., ord, name, frames, from_f, to_f, contiguous): tags over renumbered frames (by.., frame, new_index), with repeats in a row merged."""
    lo, hi = F.least("from_f", "to_f"), F.greatest("from_f", "to_f")
    inside = (hi >= 0) & (lo < frames)
    clamped = tags.select(*by, "ord", "name", F.when(inside, F.sequence(F.greatest(F.lit(0), lo), F.least(F.lit(frames - 1), hi))).alias("old"))
    each = clamped.select(*by, "ord", F.explode("old").alias("frame")).join(mapping, [*by, "frame"])
    walked = each.groupBy(*by, "ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame", "new_index"))), lambda p: p["new_index"]).alias("all"))
    merged = F.filter("all", lambda x, i: (i == 0) | (x != F.get(F.col("all"), i - 1)))
    out = clamped.join(walked, [*by, "ord"], "left").select(*by, "ord", "name", F.coalesce(merged, F.array().cast("array<int>")).alias("frames"))
    steps = F.forall(F.sequence(F.lit(1), F.size("frames")), lambda i: (i == F.size("frames")) | (F.get("frames", i) == F.get("frames", i - 1) + 1))
    some = F.size("frames") > 0
    return out.select(*by, "ord", "name", "frames", F.when(some, F.array_min("frames")).otherwise(0).alias("from_f"), F.when(some, F.array_max("frames")).otherwise(0).alias("to_f"), (some & steps).alias("contiguous"))


def remapped_durations(holds: DataFrame, mapping: DataFrame) -> DataFrame:
    """(new_index, hold): the first hold that is set among the frames of an index, in order."""
    first = F.min_by("hold", F.when(F.col("hold").isNotNull(), F.col("frame")))
    return mapping.join(holds, "frame").groupBy("new_index").agg(first.alias("hold"))

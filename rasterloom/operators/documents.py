"""Normalised sheet documents and their forms for engines.

A frame is a row (sheet, frame, x, y, w, h, ms, px, py); frames without a pivot have null px and py.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.functions.scalars import round_half_up


def attached(frames: DataFrame, pivots: DataFrame) -> DataFrame:
    """Left-joins the last pivot (ord, frame, x, y) of each frame; a pivot on the last pixel means the far edge."""
    last = pivots.groupBy("frame").agg(F.max_by(F.struct("x", "y"), "ord").alias("p"))
    edge = lambda v, size: F.when((size > 1) & (v == size - 1), size).otherwise(v)
    joined = frames.join(last, "frame", "left")
    return joined.select(*frames.columns, edge(F.col("p.x"), F.col("w")).alias("px"), edge(F.col("p.y"), F.col("h")).alias("py"))


def name_of(sheet: Column, frame: Column) -> Column:
    return F.format_string("%s_%03d", sheet.cast("string"), frame)


def aseprite_json(frames: DataFrame) -> DataFrame:
    """(sheet, document): a JSON document with an array of frames in order."""
    rect = F.struct("x", "y", "w", "h")
    whole = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), "w", "h")
    each = F.struct(F.col("frame").alias("i"), F.struct(name_of(F.col("sheet"), F.col("frame")).alias("filename"), rect.alias("frame"), F.lit(False).alias("rotated"), F.lit(False).alias("trimmed"), whole.alias("spriteSourceSize"), F.struct("w", "h").alias("sourceSize"), F.col("ms").alias("duration")).alias("f"))
    ordered = frames.groupBy("sheet").agg(F.transform(F.sort_array(F.collect_list(each)), lambda e: e["f"]).alias("frames"), F.max(F.col("x") + F.col("w")).alias("w"), F.max(F.col("y") + F.col("h")).alias("h"))
    meta = F.struct(F.lit("1.0").alias("version"), F.lit("RGBA8888").alias("format"), F.struct("w", "h").alias("size"), F.lit("1").alias("scale"))
    return ordered.select("sheet", F.to_json(F.struct("frames", meta.alias("meta"))).alias("document"))


def phaser_json(frames: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """(sheet, document): frames by name with all that a reader asks for, animations (tags: name, from_f, to_f, direction) and facts of the
    sheet. Frames are neither turned nor trimmed, which is said, as a missing flag is read as trimmed; anchors are shares of the frame."""
    from rasterloom.operators.timeline import expanded_tag

    anchor = F.when(F.col("px").isNotNull(), F.struct((F.col("px") / F.col("w")).alias("x"), (F.col("py") / F.col("h")).alias("y")))
    whole = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), "w", "h")
    value = F.struct(F.struct("x", "y", "w", "h").alias("frame"), F.lit(False).alias("rotated"), F.lit(False).alias("trimmed"), whole.alias("spriteSourceSize"), F.struct("w", "h").alias("sourceSize"), F.col("ms").alias("duration"), anchor.alias("anchor"))
    each = F.struct(F.col("frame").alias("i"), name_of(F.col("sheet"), F.col("frame")).alias("k"), value.alias("v"))
    ordered = frames.groupBy("sheet").agg(F.sort_array(F.collect_list(each)).alias("e"), F.max(F.col("x") + F.col("w")).alias("w"), F.max(F.col("y") + F.col("h")).alias("h"))
    entries = F.map_from_entries(F.transform("e", lambda e: F.struct(e["k"], e["v"])))
    meta = F.struct(F.lit("rasterloom").alias("app"), F.lit("1.0").alias("version"), F.concat(F.col("sheet").cast("string"), F.lit(".png")).alias("image"), F.lit("RGBA8888").alias("format"), F.struct("w", "h").alias("size"), F.lit("1").alias("scale"))
    animations = F.lit(None).cast("map<string,array<string>>")
    if tags is not None:
        steps = tags.select("name", F.posexplode(expanded_tag(F.col("from_f"), F.col("to_f"), F.col("direction"))).alias("step", "frame"))
        own = frames.join(steps, "frame").groupBy("sheet", "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", name_of(F.col("sheet"), F.col("frame")).alias("k")))), lambda s: s["k"]).alias("names"))
        by_sheet = own.groupBy("sheet").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "names")))).alias("m"))
        ordered, animations = ordered.join(by_sheet, "sheet", "left"), F.col("m")
    return ordered.select("sheet", F.to_json(F.struct(entries.alias("frames"), animations.alias("animations"), meta.alias("meta")), {"ignoreNullFields": "true"}).alias("document"))


def unity_rects(frames: DataFrame, sheet_height: Column) -> DataFrame:
    """Rectangles from the lower left, and pivots as shares from there."""
    return frames.select("sheet", "frame", "x", (sheet_height - F.col("y") - F.col("h")).alias("y"), "w", "h", F.coalesce(F.col("px") / F.col("w"), F.lit(0.5)).alias("pivot_x"), F.coalesce(1 - F.col("py") / F.col("h"), F.lit(0.5)).alias("pivot_y"))


def godot_frames(frames: DataFrame, tags: DataFrame) -> DataFrame:
    """(sheet, name, speed, frames): an animation for each tag (name, from_f, to_f, fps) with its frames and how long each holds."""
    step = tags.select("name", "fps", F.explode(F.sequence("from_f", "to_f")).alias("frame"))
    joined = frames.join(step, "frame")
    hold = F.round(F.col("ms") * F.col("fps") / 1000, 6)
    return joined.groupBy("sheet", "name").agg(F.max("fps").alias("speed"), F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("frame", hold.alias("hold")))), lambda s: s["hold"])).alias("holds"))


def unity_meta(rects: DataFrame) -> DataFrame:
    """(sheet, document): the sprite entries of an import file as text, in order."""
    entry = F.format_string("    - name: %s\n      rect: {x: %d, y: %d, width: %d, height: %d}\n      pivot: {x: %s, y: %s}\n", name_of(F.col("sheet"), F.col("frame")), F.col("x").cast("long"), F.col("y").cast("long"), F.col("w").cast("long"), F.col("h").cast("long"), F.round("pivot_x", 6).cast("string"), F.round("pivot_y", 6).cast("string"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("frame", entry.alias("t")))), lambda s: s["t"]), "")
    return rects.groupBy("sheet").agg(F.concat(F.lit("  spriteSheet:\n    sprites:\n"), body).alias("document"))


def resolved_names(rows: DataFrame, by: str, name: str, order: str) -> DataFrame:
    """Names made unique within `by`, in order: one that is taken gets _2, or the next number that is free. A group (a sheet) is a task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        out = []
        for own in part.sort_values(order)[name]:
            base = own or "frame"
            found, n = base, 2
            while found in used:
                found, n = f"{base}_{n}", n + 1
            used.add(found)
            out.append(found)
        return part.sort_values(order).assign(unique_name=out)

    schema = T.StructType([*rows.schema.fields, T.StructField("unique_name", T.StringType())])
    return rows.groupBy(by).applyInPandas(run, schema)


def stem(path: Column) -> Column:
    """The file's name without folders (of either slash) and without its last extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]+$", "")


def held(ms: Column) -> Column:
    return F.greatest(F.lit(1), round_half_up(ms).cast("int"))

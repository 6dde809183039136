"""Rules that examine the frames of sheets. Each gives findings (sheet, rule, severity, frame, detail) with a map of numbers as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.functions.scalars import distance_sq, is_power_of_two, round_half_up
from rasterloom.operators import colour, pixels as px

# Default thresholds of the rules.
FRINGE = {"opaque": 250, "distance": 60, "pixels": 24, "share": 0.02}
DRIFT = {"frames": 3, "deviation": 0.25, "step": 0.15}
EMPTY = {"near": 0.005, "contrast": 10}
OPAQUE = {"frames": 1, "share": 0.5}
SEVERITY = {"alpha-fringe": "warning", "frame-bleed": "error", "pivot-drift": "info", "duplicate-frames": "info", "empty-cell": "warning", "opaque-frame": "warning", "non-power-of-two": "info", "palette-bloat": "info", "palette-near-duplicates": "info"}


def _findings(rows: DataFrame, rule: str, detail: dict[str, Column], severity: Column | None = None, frame: Column | None = None) -> DataFrame:
    pairs = [x for k, v in detail.items() for x in (F.lit(k), v.cast("string"))]
    return rows.select("sheet", F.lit(rule).alias("rule"), (severity if severity is not None else F.lit(SEVERITY[rule])).alias("severity"), (frame if frame is not None else F.col("frame")).cast("long").alias("frame"), F.to_json(F.create_map(*pairs)).alias("detail"))


def alpha_fringe(pixels: DataFrame, least: int = FRINGE["pixels"]) -> DataFrame:
    """Half-transparent pixels at a frame's edge whose colour is near that of the frame's corners."""
    across, down = W.partitionBy("frame", "y").orderBy("x"), W.partitionBy("frame", "x").orderBy("y")
    clear = lambda c: F.coalesce(c == 0, F.lit(False))
    rows = pixels.withColumn("__h", clear(F.lag("a").over(across)) | clear(F.lead("a").over(across)))
    rows = rows.withColumn("__e", F.col("__h") | clear(F.lag("a").over(down)) | clear(F.lead("a").over(down)))
    corners = px.corner_vote(pixels, "frame").select("frame", *[F.col(c).alias(f"t{c}") for c in "rgb"])
    near = distance_sq(tuple(F.col(c) for c in "rgb"), tuple(F.col(f"t{c}") for c in "rgb")) <= FRINGE["distance"] ** 2
    ring = (F.col("a") > 0) & (F.col("a") < FRINGE["opaque"]) & F.col("__e") & near
    counts = rows.join(corners, "frame").groupBy("sheet", "frame").agg(F.count_if(ring).alias("fringe"), F.count_if((F.col("a") > 0) & F.col("__e")).alias("edge"))
    found = counts.where((F.col("fringe") >= least) & (F.col("fringe") >= F.col("edge") * FRINGE["share"]))
    return _findings(found, "alpha-fringe", {"fringe": F.col("fringe"), "edge": F.col("edge")})


def pivot_drift(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Frames whose content's foot lies far from the sheet's median and from the frame before, on the same axis."""
    box = px.boxes(pixels, "frame").join(pixels.select("sheet", "frame").distinct(), "frame")
    foot = box.select("sheet", "frame", round_half_up((F.col("x0") + F.col("x1")) / 2).cast("int").alias("x"), F.col("y1").alias("y"))
    middle = foot.groupBy("sheet").agg(F.median("x").alias("mx"), F.median("y").alias("my"), F.count("*").alias("n")).where(F.col("n") >= DRIFT["frames"])
    w = W.partitionBy("sheet").orderBy("frame")
    step = lambda c: F.abs(F.col(c) - F.coalesce(F.lag(c).over(w), F.lead(c).over(w)))
    moved = foot.withColumn("sx", step("x")).withColumn("sy", step("y")).join(middle, "sheet")
    off = lambda c, size: (F.abs(F.col(c) - F.col(f"m{c}")) > DRIFT["deviation"] * size) & (F.col(f"s{c}") > DRIFT["step"] * size)
    axis = F.when(off("x", width) & off("y", height), "both").when(off("x", width), "x").when(off("y", height), "y")
    return _findings(moved.withColumn("axis", axis).where("axis is not null"), "pivot-drift", {"axis": F.col("axis"), "x": F.col("x"), "y": F.col("y")})


def empty_cell(coverage: DataFrame) -> DataFrame:
    """coverage (sheet, frame, coverage): blank frames, those after the last drawn one as padding, and nearly blank ones."""
    facts = coverage.groupBy("sheet").agg(F.max(F.when(F.col("coverage") > 0, F.col("frame"))).alias("last"), F.avg(F.when(F.col("coverage") > 0, F.col("coverage"))).alias("mean"), F.count("*").alias("n")).where("n >= 2")
    rows = coverage.join(facts, "sheet")
    blank = F.col("coverage") == 0
    kind = F.when(F.col("last").isNull(), "all").when(blank & (F.col("frame") > F.col("last")), "padding").when(blank, "hole").when((F.col("coverage") < EMPTY["near"]) & (F.col("mean") / F.col("coverage") >= EMPTY["contrast"]), "near")
    found = rows.withColumn("kind", kind).where("kind is not null and kind <> 'all'")
    each = _findings(found, "empty-cell", {"kind": F.col("kind")}, F.when(F.col("kind") == "hole", "warning").otherwise("info"))
    whole = _findings(facts.where("last is null"), "empty-cell", {"kind": F.lit("all")}, frame=F.lit(None))
    return each.unionByName(whole)


def opaque_frame(pixels: DataFrame) -> DataFrame:
    """Frames without transparent pixels on sheets where at least half of the frames have some."""
    frames = pixels.groupBy("sheet", "frame").agg(F.bool_or(F.col("a") == 0).alias("clear"))
    facts = frames.groupBy("sheet").agg(F.count_if("clear").alias("keyed"), F.count("*").alias("n")).where((F.col("n") >= 2) & (F.col("keyed") >= OPAQUE["frames"]) & (F.col("keyed") >= F.col("n") * OPAQUE["share"]))
    return _findings(frames.where("not clear").join(facts, "sheet"), "opaque-frame", {"keyed": F.col("keyed"), "frames": F.col("n")})


def duplicate_frames(mapped: DataFrame, most: int = 20) -> DataFrame:
    """mapped (sheet, frame, rep): the largest groups of a sheet. The limit is the feature."""
    groups = mapped.groupBy("sheet", "rep").agg(F.count("*").alias("n")).where("n > 1")
    ranked = groups.withColumn("__k", F.row_number().over(W.partitionBy("sheet").orderBy(F.desc("n"), "rep"))).where(F.col("__k") <= most)
    return _findings(ranked, "duplicate-frames", {"frames": F.col("n")}, frame=F.col("rep"))


def non_power_of_two(sizes: DataFrame) -> DataFrame:
    """sizes (sheet, width, height): sheets with a side that is no power of two."""
    return _findings(sizes.where(~(is_power_of_two(F.col("width")) & is_power_of_two(F.col("height")))), "non-power-of-two", {"width": F.col("width"), "height": F.col("height")}, frame=F.lit(None))


def near_duplicate_colours(pixels: DataFrame, distance: float = 2.0, least: int = 8) -> DataFrame:
    """Pairs of colours of a sheet that hardly differ and each fill some pixels."""
    counts = colour.populations(pixels, "sheet").where(F.col("n") >= least).select("sheet", "rgb", "n")
    near = colour.near_duplicates(counts.select("rgb").distinct(), distance)
    both = near.join(counts.select("sheet", F.col("rgb").alias("a"), F.col("n").alias("na")), "a").join(counts.select("sheet", F.col("rgb").alias("b"), F.col("n").alias("nb")), ["sheet", "b"])
    return _findings(both, "palette-near-duplicates", {"a": F.col("a"), "b": F.col("b"), "pixels": F.col("na") + F.col("nb")}, frame=F.lit(None))


def palette_bloat(pixels: DataFrame, least: int = 256, target: int = 32, error: float = 4.0, stride: int = 7) -> DataFrame:
    """Sheets of very many colours that a small palette, cut from them, hardly changes. pixels has (sheet, x, y, r, g, b, a)."""
    many = colour.populations(pixels, "sheet").groupBy("sheet").agg(F.count("*").alias("distinct")).where(F.col("distinct") >= least)
    there = pixels.join(many.select("sheet"), "sheet", "left_semi")
    off = colour.palette_error(there, "sheet", colour.median_cut(there, "sheet", target), stride).where(F.col("error") < error)
    return _findings(off.join(many, "sheet"), "palette-bloat", {"distinct": F.col("distinct"), "error": F.round("error", 3)}, frame=F.lit(None))


def frame_bleed(pixels: DataFrame, cols: int, width: int, height: int, least: int = 3, share: float = 0.05) -> DataFrame:
    """Runs of opaque pixels that cross the seam between neighbouring cells, of which one at least has transparent pixels."""
    keyed = pixels.groupBy("sheet", "frame").agg(F.bool_or(F.col("a") <= 8).alias("keyed"))
    solid = pixels.where("a > 8")
    out = []
    for seam, last, first, line, step, size in (("vertical", F.col("x") == width - 1, F.col("x") == 0, "y", 1, height), ("horizontal", F.col("y") == height - 1, F.col("y") == 0, "x", cols, width)):
        one = solid.where(last).select("sheet", "frame", F.col(line).alias("i"))
        if step == 1:
            one = one.where(F.col("frame") % cols != cols - 1)
        two = solid.where(first).select("sheet", (F.col("frame") - step).alias("frame"), F.col(line).alias("i"))
        crossed = one.join(two, ["sheet", "frame", "i"])
        pair = keyed.join(keyed.select("sheet", (F.col("frame") - step).alias("frame"), F.col("keyed").alias("other")), ["sheet", "frame"]).where("keyed or other").select("sheet", "frame")
        w = W.partitionBy("sheet", "frame").orderBy("i")
        runs = crossed.withColumn("__g", F.col("i") - F.row_number().over(w)).groupBy("sheet", "frame", "__g").agg(F.count("*").alias("n"), F.min("i").alias("at"))
        longest = runs.groupBy("sheet", "frame").agg(F.min(F.struct((-F.col("n")).alias("m"), "at")).alias("r")).select("sheet", "frame", (-F.col("r.m")).alias("n"), "r.at")
        found = longest.join(pair, ["sheet", "frame"]).where((F.col("n") >= least) & (F.col("n") >= share * size))
        out.append(_findings(found, "frame-bleed", {"seam": F.lit(seam), "length": F.col("n"), "at": F.col("at")}))
    return out[0].unionByName(out[1])


def ordered(findings: DataFrame) -> DataFrame:
    """By severity, rule and frame; findings of whole sheets come first."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return findings.orderBy(rank, "rule", F.coalesce("frame", F.lit(-1)), "detail")


def counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("sheet").agg(*[F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "infos"))])

"""Queries of the lint rules over sheets of 5 x 5 frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import lint
from rasterloom.plans.duplicates import _SIG, _mapped
from rasterloom.plans.registry import plan
from rasterloom.plans.relations import CANVAS, KEYED, PIXELS, SHEET, canvas, keyed, pixels, table

_KEYED = KEYED + f", s AS (SELECT frame // {SHEET} AS sheet, frame % {SHEET} AS cell, * FROM keyed)"


def _sheets(spark: SparkSession, sf_dir: str, binary: bool = True) -> DataFrame:
    return (keyed if binary else pixels)(spark, sf_dir).withColumn("sheet", F.floor(F.col("frame") / SHEET))


@plan(f"""WITH {PIXELS}, keyed AS (SELECT * FROM pixels), {'v AS (SELECT frame, r, g, b, count(*) AS n, min(y * 65536 + x) AS first FROM keyed WHERE x IN (0, 3) AND y IN (0, 3) GROUP BY 1, 2, 3, 4), bg AS (SELECT frame, min(struct_pack(m := -n, f := first, r := r, g := g, b := b)) AS s FROM v GROUP BY 1)'},
 p AS (SELECT frame, x, y, r, g, b, CASE WHEN a < 100 THEN 0 ELSE a END AS a FROM pixels),
 e AS (SELECT p.*, EXISTS (SELECT 1 FROM p n WHERE n.frame = p.frame AND abs(n.x - p.x) + abs(n.y - p.y) = 1 AND n.a = 0) AS edge FROM p),
 c AS (SELECT frame // {SHEET} AS sheet, frame, count(*) FILTER (a > 0 AND a < 250 AND edge AND (r - s.r) ** 2 + (g - s.g) ** 2 + (b - s.b) ** 2 <= 3600) AS fringe, count(*) FILTER (a > 0 AND edge) AS edge FROM e JOIN bg USING (frame) GROUP BY 1, 2)
 SELECT sheet, 'alpha-fringe' AS rule, 'warning' AS severity, frame, '{{"fringe":"' || fringe || '","edge":"' || edge || '"}}' AS detail FROM c WHERE fringe >= 2 AND fringe >= edge * 0.02""")
def lint_alpha_fringe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames are 4 x 4 here, so two pixels count as many."""
    p = _sheets(spark, sf_dir, binary=False)
    return lint.alpha_fringe(p.withColumn("a", F.when(F.col("a") < 100, 0).otherwise(F.col("a"))), 2)


@plan(f"""WITH {CANVAS}, b AS (SELECT frame // 10 AS sheet, frame, floor((min(x) + max(x)) / 2 + 0.5)::INT AS x, max(y) AS y FROM canvas WHERE n > 1 GROUP BY 1, 2), m AS (SELECT sheet, median(x) AS mx, median(y) AS my FROM b GROUP BY 1 HAVING count(*) >= 3),
 d AS (SELECT b.*, abs(x - mx) AS dx, abs(y - my) AS dy, abs(x - coalesce(lag(x) OVER w, lead(x) OVER w)) AS sx, abs(y - coalesce(lag(y) OVER w, lead(y) OVER w)) AS sy FROM b JOIN m USING (sheet) WINDOW w AS (PARTITION BY b.sheet ORDER BY b.frame)),
 a AS (SELECT *, CASE WHEN dx > 6 AND sx > 3.6 AND dy > 7.75 AND sy > 4.65 THEN 'both' WHEN dx > 6 AND sx > 3.6 THEN 'x' WHEN dy > 7.75 AND sy > 4.65 THEN 'y' END AS axis FROM d)
 SELECT sheet, 'pivot-drift' AS rule, 'info' AS severity, frame, '{{"axis":"' || axis || '","x":"' || x || '","y":"' || y || '"}}' AS detail FROM a WHERE axis IS NOT NULL""")
def lint_pivot_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = canvas(spark, sf_dir).where("n > 1").withColumns({"a": F.lit(255), "sheet": F.floor(F.col("frame") / 10)})
    return lint.pivot_drift(p, 24, 31)


_COVER = "cov AS (SELECT frame // 10 AS sheet, frame, CASE WHEN frame % 10 > 7 OR frame % 13 = 0 THEN 0 WHEN frame % 17 = 0 THEN 0.001 ELSE count(*) / 744.0 END::DOUBLE AS coverage FROM canvas WHERE frame // 10 <> 3 GROUP BY 1, 2 UNION ALL SELECT DISTINCT 3, frame, 0::DOUBLE FROM canvas WHERE frame // 10 = 3)"


@plan(f"""WITH {CANVAS}, {_COVER}, f AS (SELECT sheet, max(frame) FILTER (coverage > 0) AS last, avg(coverage) FILTER (coverage > 0) AS mean FROM cov GROUP BY 1 HAVING count(*) >= 2),
 k AS (SELECT cov.sheet, frame, CASE WHEN last IS NULL THEN NULL WHEN coverage = 0 AND frame > last THEN 'padding' WHEN coverage = 0 THEN 'hole' WHEN coverage < 0.005 AND mean / coverage >= 10 THEN 'near' END AS kind FROM cov JOIN f USING (sheet))
 SELECT sheet, 'empty-cell' AS rule, CASE WHEN kind = 'hole' THEN 'warning' ELSE 'info' END AS severity, frame, '{{"kind":"' || kind || '"}}' AS detail FROM k WHERE kind IS NOT NULL
 UNION ALL SELECT sheet, 'empty-cell', 'warning', NULL, '{{"kind":"all"}}' FROM f WHERE last IS NULL""")
def lint_empty_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = canvas(spark, sf_dir).groupBy(F.floor(F.col("frame") / 10).alias("sheet"), "frame").agg(F.count("*").alias("n"))
    f = F.col("frame")
    cover = F.when((F.col("sheet") == 3) | (f % 10 > 7) | (f % 13 == 0), 0.0).when(f % 17 == 0, 0.001).otherwise(F.col("n") / 744)
    return lint.empty_cell(counted.select("sheet", "frame", cover.alias("coverage")))


@plan(f"""WITH {_KEYED}, f AS (SELECT sheet, frame, bool_or(a = 0 AND frame % 4 < 3) AS clear FROM s GROUP BY 1, 2), k AS (SELECT sheet, count(*) FILTER (clear) AS keyed, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (clear) >= 1 AND count(*) FILTER (clear) >= count(*) * 0.5)
 SELECT sheet, 'opaque-frame' AS rule, 'warning' AS severity, frame, '{{"keyed":"' || keyed || '","frames":"' || n || '"}}' AS detail FROM f JOIN k USING (sheet) WHERE NOT clear""")
def lint_opaque_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _sheets(spark, sf_dir)
    return lint.opaque_frame(p.withColumn("a", F.when(F.col("frame") % 4 == 3, 255).otherwise(F.col("a"))))


@plan(f"""WITH {_SIG}, g AS (SELECT sheet, rep, count(*) AS n FROM map GROUP BY 1, 2 HAVING count(*) > 1), r AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY n DESC, rep) AS k FROM g)
 SELECT sheet, 'duplicate-frames' AS rule, 'info' AS severity, rep AS frame, '{{"frames":"' || n || '"}}' AS detail FROM r WHERE k <= 20""")
def lint_duplicate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.duplicate_frames(_mapped(spark, sf_dir))


@plan("""SELECT p_partkey AS sheet, 'non-power-of-two' AS rule, 'info' AS severity, NULL::BIGINT AS frame, '{"width":"' || p_size || '","height":"' || (1 + p_partkey % 64) || '"}' AS detail FROM part WHERE NOT (p_size > 0 AND bit_count(p_size::BIGINT) = 1 AND bit_count((1 + p_partkey % 64)::BIGINT) = 1)""")
def lint_non_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.non_power_of_two(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sheet"), F.col("p_size").alias("width"), (F.col("p_partkey") % 64 + 1).cast("int").alias("height")))


@plan(f"""WITH {_KEYED}, q AS (SELECT sheet, (r // 32 * 32 + (g % 2)) * 65536 + g // 32 * 32 * 256 + b // 32 * 32 AS rgb FROM s WHERE a > 0), c AS (SELECT sheet, rgb, count(*) AS n FROM q GROUP BY 1, 2 HAVING count(*) >= 2)
 SELECT x.sheet, 'palette-near-duplicates' AS rule, 'info' AS severity, NULL::BIGINT AS frame, '{{"a":"' || x.rgb || '","b":"' || y.rgb || '","pixels":"' || (x.n + y.n) || '"}}' AS detail
 FROM c x JOIN c y ON x.sheet = y.sheet AND x.rgb < y.rgb AND ((x.rgb >> 16) - (y.rgb >> 16)) ** 2 + ((x.rgb >> 8 & 255) - (y.rgb >> 8 & 255)) ** 2 + ((x.rgb & 255) - (y.rgb & 255)) ** 2 <= 4""")
def lint_near_duplicate_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _sheets(spark, sf_dir)
    low = lambda c: (F.floor(F.col(c) / 32) * 32).cast("int")
    return lint.near_duplicate_colours(p.withColumns({"r": low("r") + F.col("g") % 2, "g": low("g"), "b": low("b")}), 2.0, 2)


_SEAMS = []
for _name, _last, _first, _line, _step, _cut in (("vertical", "x = 3", "x = 0", "y", 1, "AND cell % 5 <> 4"), ("horizontal", "y = 3", "y = 0", "x", 5, "")):
    _SEAMS.append(f"""SELECT * FROM (SELECT l.sheet, '{_name}' AS seam, l.cell, l.n, l.pos FROM (SELECT sheet, cell, arg_min(n, -n * 100 + pos) AS n, arg_min(pos, -n * 100 + pos) AS pos FROM (
  SELECT sheet, cell, count(*) AS n, min(i) AS pos FROM (SELECT o.sheet, o.cell, o.{_line} AS i, o.{_line} - row_number() OVER (PARTITION BY o.sheet, o.cell ORDER BY o.{_line}) AS g
   FROM (SELECT * FROM s WHERE a > 8 AND {_last} {_cut}) o JOIN (SELECT * FROM s WHERE a > 8 AND {_first}) t ON t.sheet = o.sheet AND t.cell = o.cell + {_step} AND t.{_line} = o.{_line}) GROUP BY sheet, cell, g) GROUP BY 1, 2) l
  JOIN kf a ON a.sheet = l.sheet AND a.cell = l.cell JOIN kf b ON b.sheet = l.sheet AND b.cell = l.cell + {_step} WHERE (a.keyed OR b.keyed) AND l.n >= 3)""")


@plan(f"""WITH {_KEYED}, kf AS (SELECT sheet, cell, bool_or(a <= 8) AS keyed FROM s GROUP BY 1, 2), f AS ({' UNION ALL '.join(_SEAMS)})
 SELECT sheet, 'frame-bleed' AS rule, 'error' AS severity, cell AS frame, '{{"seam":"' || seam || '","length":"' || n || '","at":"' || pos || '"}}' AS detail FROM f""")
def lint_frame_bleed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _sheets(spark, sf_dir)
    return lint.frame_bleed(p.withColumn("frame", F.col("frame") % SHEET), 5, 4, 4)


@plan()
def lint_palette_bloat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of 25 frames side by side."""
    p = _sheets(spark, sf_dir).withColumn("x", ((F.col("frame") % SHEET) * 4 + F.col("x")).cast("int"))
    return lint.palette_bloat(p, 200, 32, 40.0)


@plan()
def lint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules' findings in their order of report."""
    parts = [f(spark, sf_dir) for f in (lint_alpha_fringe, lint_frame_bleed, lint_pivot_drift, lint_duplicate_frames, lint_empty_cell, lint_opaque_frame, lint_non_power_of_two, lint_palette_bloat, lint_near_duplicate_colours)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return lint.ordered(found)

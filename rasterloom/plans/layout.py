"""Queries of sheet geometry, settings, names and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import layout as fn
from rasterloom.plans.registry import plan
from rasterloom.plans.relations import ACTIVITY, TAGS, activity, table, tags

def _k() -> Column:
    return F.col("p_partkey")


@plan("""WITH c AS (SELECT p_partkey, (p_partkey // 7)::INT AS row, (p_partkey % 7)::INT AS col FROM part)
 SELECT p_partkey, row, col, (row * 7 + col)::BIGINT AS back, (2 + col * 17)::INT AS x, (3 + row * 34)::INT AS y, (((3 + row * 34 + 5) * 131 + 2 + col * 17 + 4) * 4)::INT AS byte, (2 + col * 17 + 4)::INT AS px, (3 + row * 34 + 5)::INT AS py FROM c""")
def cell_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, origins and bytes of frames on sheets of seven columns with margins and gutters.

    All is reckoned in 64 bits. A column has SQL's 32 bits as long as the table's values fit; where SQL would overflow, it has 64.
    """
    p = table(spark, sf_dir, "part").select("p_partkey", fn.cell_of(_k(), F.lit(7)).alias("c"))
    p = p.withColumn("o", fn.origin_of(F.col("c.row"), F.col("c.col"), F.lit(16), F.lit(32), F.lit(2), F.lit(3), F.lit(1), F.lit(2)))
    x, y = F.col("o.x") + 4, F.col("o.y") + 5
    row, byte = F.col("c.row"), fn.pixel_offset(x, y, F.lit(131))
    # Lower rows have the larger values, of which the byte's is the largest, then py.
    ends = p.agg(*[f(c) for c in (byte, y) for f in (F.min, F.max)]).first()
    of_byte, of_y = ("int" if all(v is None or abs(v) < 1 << 31 for v in own) else "long" for own in (ends[:2], ends[2:]))
    back = fn.index_of(row, F.col("c.col"), F.lit(7))
    return p.select("p_partkey", row.cast(of_y).alias("row"), F.col("c.col"), back.cast("long").alias("back"), F.col("o.x").cast("int").alias("x"), F.col("o.y").cast(of_y).alias("y"), byte.cast(of_byte).alias("byte"), x.cast("int").alias("px"), y.cast(of_y).alias("py"))


_PAIR = lambda a, b, room: f"""CASE WHEN {a} + {b} <= {room} THEN [{a}, {b}] WHEN {room} <= 0 THEN [0, 0] WHEN {a} + {b} - ({room}) <= abs({a} - {b})
 THEN CASE WHEN {a} >= {b} THEN [({room}) - {b}, {b}] ELSE [{a}, ({room}) - {a}] END
 ELSE CASE WHEN {a} >= {b} THEN [greatest(0, {b} - (2 * {b} - ({room}) + 1) // 2), greatest(0, {b} - (2 * {b} - ({room})) // 2)] ELSE [greatest(0, {a} - (2 * {a} - ({room})) // 2), greatest(0, {a} - (2 * {a} - ({room}) + 1) // 2)] END END"""  # noqa: E731


@plan(f"""WITH s AS (SELECT p_partkey, (p_partkey % 23)::INT AS l, (p_size % 19)::INT AS r, (p_size % 11)::INT AS t, (p_partkey % 13)::INT AS b, (p_partkey % 31)::INT AS w, (p_size % 17)::INT AS h FROM part),
 f AS (SELECT p_partkey, {_PAIR('l', 'r', 'greatest(0, w - 1)')} AS x, {_PAIR('t', 'b', 'greatest(0, h - 1)')} AS y FROM s) SELECT p_partkey, x[1]::INT AS "left", x[2]::INT AS "right", y[1]::INT AS top, y[2]::INT AS bottom FROM f""")
def clamped_insets(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    found = fn.clamped_insets(_k() % 23, size % 19, size % 11, _k() % 13, _k() % 31, size % 17)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("i")).select("p_partkey", "i.left", "i.right", "i.top", "i.bottom")


@plan("""WITH s AS (SELECT p_partkey, (p_partkey % 5) / 16.0::DOUBLE AS a, (p_size % 4) / 16.0::DOUBLE AS b, (p_partkey % 3) / 8.0::DOUBLE AS c, (p_size % 3) / 8.0::DOUBLE AS d FROM part)
 SELECT p_partkey, a + c * (1 - a - b) AS top, b + d * (1 - a - b) AS bottom, b + d * (1 - b - a) AS "left", a + c * (1 - b - a) AS "right" FROM s""")
def composed_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c, d = (_k() % 5) / 16.0, (F.col("p_size") % 4) / 16.0, (_k() % 3) / 8.0, (F.col("p_size") % 3) / 8.0
    found = fn.composed_crop({"top": a, "bottom": b, "left": b, "right": a}, {"top": c, "bottom": d, "left": d, "right": c})
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("f")).select("p_partkey", "f.top", "f.bottom", "f.left", "f.right")


@plan("""WITH s AS (SELECT p_partkey, (p_partkey % 5)::INT AS band, p_partkey % 2 = 0 AS outr, (p_size % 4 + 0.5)::DOUBLE AS blur, (p_partkey % 9 - 4)::INT AS dx, (p_size % 7 - 3)::INT AS dy, p_partkey % 3 <> 0 AS sh FROM part),
 f AS (SELECT *, CASE WHEN outr THEN band ELSE 0 END AS foot FROM s)
 SELECT p_partkey, ceil(CASE WHEN sh THEN greatest(foot, greatest(0, -dx) + blur + foot) ELSE foot END)::INT AS "left", ceil(CASE WHEN sh THEN greatest(foot, greatest(0, -dy) + blur + foot) ELSE foot END)::INT AS top,
  ceil(CASE WHEN sh THEN greatest(foot, greatest(0, dx) + blur + foot) ELSE foot END)::INT AS "right", ceil(CASE WHEN sh THEN greatest(foot, greatest(0, dy) + blur + foot) ELSE foot END)::INT AS bottom FROM f""")
def required_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    found = fn.required_margin((_k() % 5).cast("int"), _k() % 2 == 0, (size % 4) + F.lit(0.5), (_k() % 9 - 4).cast("int"), (size % 7 - 3).cast("int"), _k() % 3 != 0)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("m")).select("p_partkey", "m.left", "m.top", "m.right", "m.bottom")


@plan("SELECT p_partkey, p_partkey % 3 = 0 AND p_partkey % 4 = 0 AND p_size % 2 = 0 AS zero FROM part")
def zero_paddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.when(_k() % 2 == 0, F.lit(0)).otherwise(F.lit(None).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.is_zero(_k() % 3, _k() % 4, F.col("p_size") % 2, none).alias("zero"))


@plan("""WITH s AS (SELECT p_partkey, p_partkey % 3 <> 0 AS atlas, p_partkey % 4 <> 0 AND p_size % 5 <> 0 AS grid FROM part) SELECT p_partkey, CASE WHEN atlas AND grid THEN 'hybrid' WHEN atlas THEN 'atlas' WHEN grid THEN 'grid' ELSE 'unknown' END AS kind FROM s""")
def export_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with and without a map of frames, and with and without a grid of positive counts."""
    frames = F.when(_k() % 3 != 0, F.lit('{"a":{"x":0}}')).when(_k() % 2 == 0, F.lit("{}")).otherwise(F.lit("[1]"))
    grid = F.format_string('"frameWidth":%d,"frameHeight":16,"grid":{"cols":%d,"rows":2}', (F.col("p_size") % 5).cast("int"), (_k() % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.export_kind(F.concat(F.lit('{"frames":'), frames, F.lit(","), grid, F.lit("}"))).alias("kind"))


@plan("""WITH s AS (SELECT p_partkey, p_name || (['.ase', '.ASEPRITE', '.9.png', '.png'])[(p_partkey % 4 + 1)::INT] AS name FROM part)
 SELECT p_partkey, p_partkey % 4 < 2 AS layered, p_partkey % 4 = 2 AS nine_patch, name || '.meta' AS meta, (['normal', 'multiply', 'screen', 'overlay', 'darken', 'lighten', 'color-dodge', 'color-burn', 'hard-light', 'soft-light', 'difference', 'exclusion', 'hue', 'saturation', 'color', 'luminosity', 'addition', 'subtract', 'divide'])[(p_partkey % 22 + 1)::INT] AS mode FROM s""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.get(F.array(*map(F.lit, [".ase", ".ASEPRITE", ".9.png", ".png"])), (_k() % 4).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", fn.is_layered_name(name).alias("layered"), fn.is_nine_patch_name(name).alias("nine_patch"), F.concat(name, F.lit(".meta")).alias("meta"), fn.blend_mode(_k() % 22).alias("mode"))


@plan(f"WITH {TAGS} SELECT ord, replace(direction, '-', '_') AS direction FROM tags")
def tag_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags(spark).select("ord", fn.direction_name(F.col("direction")).alias("direction"))


@plan(f"WITH {ACTIVITY}, m AS (SELECT max(day) AS today FROM act), p(days) AS (VALUES (7), (30), (90)) SELECT days, strftime(today::DATE - days + 1, '%Y-%m-%d') AS since, count(*) AS events, sum(cost_micros)::BIGINT AS cost FROM act, m, p WHERE day >= strftime(today::DATE - days + 1, '%Y-%m-%d') GROUP BY ALL")
def date_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of the last 7, 30 and 90 days; the last day of the table stands for today."""
    act = activity(spark, sf_dir)
    by_day = act.where("day is not null").groupBy("day").agg(F.count("*").alias("n"), F.sum("cost_micros").alias("c"))
    today = by_day.agg(F.max("day").alias("today")).select(F.explode(F.array(F.lit(7), F.lit(30), F.lit(90))).alias("days"), "today")
    spans = today.select("days", F.date_format(F.date_sub(F.to_date("today"), F.col("days") - 1), "yyyy-MM-dd").alias("since"), F.explode(F.sequence(F.date_sub(F.to_date("today"), F.col("days") - 1), F.to_date("today"))).alias("d"))
    return spans.join(by_day, F.date_format("d", "yyyy-MM-dd") == F.col("day")).groupBy("days", "since").agg(F.sum("n").alias("events"), F.sum("c").alias("cost"))


@plan("""WITH s AS (SELECT p_partkey, (p_partkey % 6)::INT AS n, [CASE WHEN p_size % 3 > 0 THEN p_size * 1.25 END, -4.0, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice END, 0.2]::DOUBLE[] AS h FROM part),
 o AS (SELECT p_partkey, n, list_transform(range(1, n + 1), lambda i: CASE WHEN h[i] > 0 AND floor(h[i] + 0.5) > 0 THEN floor(h[i] + 0.5)::INT END) AS holds FROM s)
 SELECT p_partkey, CASE WHEN n > 0 AND len(list_filter(holds, lambda x: x IS NOT NULL)) > 0 THEN holds END AS holds FROM o""")
def normalized_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    holds = F.array(F.when(size % 3 > 0, size * F.lit(1.25)), F.lit(-4.0), F.when(_k() % 5 == 0, F.col("p_retailprice").cast("double")), F.lit(0.2))
    return table(spark, sf_dir, "part").select("p_partkey", fn.normalized_holds(holds, (_k() % 6).cast("int")).alias("holds"))


@plan("""WITH s AS (SELECT p_partkey, ['a', 'b', 'c'] AS ch, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ['a'] WHEN 2 THEN ['b', 'c'] ELSE ['b', 'x'] END AS cur, (['a', 'b', 'z'])[(p_size % 3 + 1)::INT] AS nm FROM part),
 n AS (SELECT *, CASE WHEN list_contains(coalesce(cur, ch), nm) THEN list_filter(coalesce(cur, ch), lambda x: x <> nm) ELSE list_append(coalesce(cur, ch), nm) END AS nx FROM s)
 SELECT p_partkey, CASE WHEN NOT list_contains(ch, nm) OR NOT list_has_any(nx, ch) THEN cur WHEN list_has_all(nx, ch) THEN NULL ELSE nx END AS selection FROM n""")
def layer_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda *v: F.array(*map(F.lit, v))
    current = F.when(_k() % 4 == 1, names("a")).when(_k() % 4 == 2, names("b", "c")).when(_k() % 4 == 3, names("b", "x"))
    clicked = F.get(names("a", "b", "z"), F.col("p_size") % 3)
    return table(spark, sf_dir, "part").select("p_partkey", fn.toggled(current, clicked, names("a", "b", "c")).alias("selection"))


@plan(f"WITH {ACTIVITY} SELECT DISTINCT provider, model FROM act")
def filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models that each provider's filter offers."""
    return activity(spark, sf_dir).select("provider", "model").distinct()


@plan("""WITH s AS (SELECT p_partkey % 50 AS source, 1 AS stage, p_partkey AS ord, p_size AS target FROM part UNION ALL SELECT p_partkey % 20, 2, p_partkey, p_size + 1000 FROM part WHERE p_size > 25)
 SELECT source, arg_max(target, stage * 100000000 + ord)::INT AS target FROM s GROUP BY 1 HAVING arg_max(target, stage * 100000000 + ord) <> source""")
def merged_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swaps of two stages: of those of one source the last of the last stage holds; what maps to itself goes."""
    p = table(spark, sf_dir, "part")
    both = p.select((_k() % 50).alias("source"), F.lit(1).alias("stage"), _k().alias("ord"), F.col("p_size").alias("target")).unionByName(p.where("p_size > 25").select((_k() % 20).alias("source"), F.lit(2).alias("stage"), _k().alias("ord"), (F.col("p_size") + 1000).alias("target")))
    return both.groupBy("source").agg(F.max_by("target", F.struct("stage", "ord")).alias("target")).where("target <> source")


_FNV = lambda text: f"list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length({text}) + 9), lambda i: CASE WHEN i <= length({text}) THEN ascii(substr({text}, i::INT, 1)) ELSE 0 END::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


@plan(f"""WITH h AS (SELECT p_partkey, {_FNV("('sprite:' || p_partkey)")} AS h, {_FNV("('guid:0:' || p_partkey)")} AS a, {_FNV("('guid:1:' || p_partkey)")} AS b FROM part),
 i AS (SELECT *, (((h // 4294967296) % 2097152) * 4294967296 + h % 4294967296 - 4503599627370496)::BIGINT AS id FROM h), j AS (SELECT *, CASE WHEN id = 0 THEN 1 ELSE id END AS internal FROM i)
 SELECT p_partkey, internal AS internal_id, reverse(lower(lpad(to_hex(internal & 4294967295), 8, '0'))) || reverse(lower(lpad(to_hex((internal >> 32) & 4294967295), 8, '0'))) || '0800000000000000' AS sprite_id,
 lower(lpad(to_hex((a // 4294967296)::BIGINT), 8, '0') || lpad(to_hex((a % 4294967296)::BIGINT), 8, '0') || lpad(to_hex((b // 4294967296)::BIGINT), 8, '0') || lpad(to_hex((b % 4294967296)::BIGINT), 8, '0')) AS guid FROM j""")
def asset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable identities of sprites and assets, from hashes of their names."""
    key = _k().cast("string")
    p = table(spark, sf_dir, "part").select("p_partkey", fn.internal_id(F.concat(F.lit("sprite:"), key)).alias("internal_id"), fn.asset_guid(F.concat(F.lit("guid:0:"), key), F.concat(F.lit("guid:1:"), key)).alias("guid"))
    return p.select("p_partkey", "internal_id", fn.sprite_id(F.col("internal_id")).alias("sprite_id"), "guid")


@plan("""WITH s AS (SELECT p_partkey, (p_partkey % 26)::DOUBLE AS fps, (p_size % 33)::DOUBLE AS st, CASE WHEN p_partkey % 3 > 0 THEN (p_size % 7)::DOUBLE END AS en, (0.1 + p_partkey % 4)::DOUBLE AS lo, (0.1 + p_size % 5)::DOUBLE AS hi, (p_size % 34)::INT AS co FROM part)
 SELECT p_partkey, CASE WHEN NOT (fps BETWEEN 1 AND 24 AND st BETWEEN 0 AND 30 AND (en IS NULL OR (en > 0 AND en <= 30)) AND lo BETWEEN 0.1 AND 30 AND hi BETWEEN 0.1 AND 30 AND co BETWEEN 1 AND 32) THEN 'range' WHEN en <= st THEN 'trim' WHEN lo > hi THEN 'loop' END AS error FROM s""")
def settings_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    end = F.when(_k() % 3 > 0, (size % 7).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.settings_error((_k() % 26).cast("double"), (size % 33).cast("double"), end, (_k() % 4) + F.lit(0.1), (size % 5) + F.lit(0.1), size % 34).alias("error"))


@plan("""SELECT p_partkey, len(t) > 0 AND len(t) % 4 = 0 AND regexp_full_match(t, '[A-Za-z0-9+/]*={0,2}') AS base64 FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN base64(p_name::BLOB) WHEN p_partkey % 3 = 1 THEN p_name ELSE base64(p_brand::BLOB) || '=' END AS t FROM part)""")
def base64_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda c: F.base64(F.col(c).cast("binary"))
    text = F.when(_k() % 3 == 0, own("p_name")).when(_k() % 3 == 1, F.col("p_name")).otherwise(F.concat(own("p_brand"), F.lit("=")))
    return table(spark, sf_dir, "part").select("p_partkey", fn.is_base64(text).alias("base64"))


@plan("""SELECT p_partkey, sha256('{"brand":' || to_json(p_brand) || ',"size":' || p_size || '}') AS digest FROM part""")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SHA-256 of each part's settings as JSON with its keys in order and without spaces."""
    text = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")))
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(text.cast("binary"), 256).alias("digest"))


@plan("SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_size < 30) a FULL JOIN (SELECT ps AS k, v FROM (SELECT l_partkey AS ps, max(l_linenumber)::INT AS v FROM lineitem WHERE l_quantity > 40 GROUP BY 1)) b ON a.k = b.k")
def merged_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of headers as one; the second wins."""
    a = table(spark, sf_dir, "part").where("p_size < 30").select(_k().alias("k"), F.col("p_size").alias("v"))
    b = table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_linenumber").cast("int").alias("w"))
    return a.join(b, "k", "full").select("k", F.coalesce("w", "v").alias("v"))


@plan(f"""WITH {ACTIVITY}, b AS (SELECT model, count(*) AS n, sum(cost_micros)::BIGINT AS c FROM act GROUP BY 1) SELECT '"' || replace(model, '"', '""') || '","' || n || '","' || (c // 1000000) || '.' || lpad((c % 1000000)::VARCHAR, 6, '0') || '"' AS line FROM b""")
def usage_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by model as quoted lines, costs with six decimals."""
    b = activity(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n"), F.sum("cost_micros").alias("c"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    cost = F.concat(F.floor(F.col("c") / 1_000_000).cast("string"), F.lit("."), F.lpad((F.col("c") % 1_000_000).cast("string"), 6, "0"))
    return b.select(F.concat_ws(",", quoted(F.col("model")), quoted(F.col("n").cast("string")), quoted(cost)).alias("line"))


@plan("SELECT p_partkey, p_partkey % 8 AS sheet, (row_number() OVER (PARTITION BY p_partkey % 8 ORDER BY p_size % 5 + p_partkey % 3 - 1, p_partkey % 3 - 1, p_partkey) - 1)::INT AS place FROM part")
def cel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which the cels of a frame are drawn: by layer and z together, then by z."""
    from pyspark.sql import Window as W

    z = _k() % 3 - 1
    order = W.partitionBy("sheet").orderBy(F.col("p_size") % 5 + z, z, _k())
    return table(spark, sf_dir, "part").withColumn("sheet", _k() % 8).select("p_partkey", "sheet", (F.row_number().over(order) - 1).cast("int").alias("place"))


@plan(f"""WITH {TAGS}, r AS (SELECT ord, name, greatest(3, least(from_f, to_f)) AS lo, least(18, greatest(from_f, to_f)) AS hi FROM tags) SELECT ord, name, (lo - 3)::INT AS from_f, (hi - 3)::INT AS to_f FROM r WHERE lo <= hi""")
def ranged_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags cut to the frames 3 to 18 and counted from there; those outside go."""
    lo, hi = F.greatest(F.lit(3), F.least("from_f", "to_f")), F.least(F.lit(18), F.greatest("from_f", "to_f"))
    return tags(spark).where(lo <= hi).select("ord", "name", (lo - 3).alias("from_f"), (hi - 3).alias("to_f"))


@plan(f"""WITH {TAGS}, f AS (SELECT p_partkey AS frame, floor(p_retailprice + 0.5)::INT AS hold FROM part), t AS (SELECT f.frame, hold, min(ord) AS ord FROM f LEFT JOIN tags ON frame BETWEEN from_f AND to_f GROUP BY 1, 2)
 SELECT frame, 'hero' || coalesce('-' || name, '') || '-' || lpad(frame::VARCHAR, greatest(4, length(frame::VARCHAR))::INT, '0') || '.png' AS filename, hold FROM t LEFT JOIN tags USING (ord)""")
def planned_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name and a hold for every frame of a layered file; the first tag that covers a frame is in its name."""
    frames = table(spark, sf_dir, "part").select(_k().alias("frame"), fn.normalized_holds(F.array(F.col("p_retailprice").cast("double")), F.lit(1))[0].alias("hold"))
    each = tags(spark).where("from_f <= to_f").select(F.explode(F.sequence("from_f", "to_f")).alias("frame"), "ord", "name")
    first = each.groupBy("frame").agg(F.min_by("name", "ord").alias("name"))
    number = F.format_string("%04d", F.col("frame").cast("long"))
    return frames.join(first, "frame", "left").select("frame", F.concat(F.lit("hero"), F.coalesce(F.concat(F.lit("-"), "name"), F.lit("")), F.lit("-"), number, F.lit(".png")).alias("filename"), "hold")


@plan("""WITH RECURSIVE t(part, ancestor) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION ALL SELECT t.part, t.ancestor // 3 FROM t WHERE t.ancestor // 3 >= 1) SELECT DISTINCT part AS layer FROM t WHERE ancestor IN (5, 7, 40)""")
def selected_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers of three groups and all that lies in them."""
    from rasterloom.plans.geometry import layer_ancestors

    return layer_ancestors(spark, sf_dir).where(F.col("ancestor").isin(5, 7, 40)).select(F.col("part").alias("layer")).distinct()


@plan("""WITH c(role, clip) AS (VALUES ('idle', 1), ('walk', 2), ('roll', NULL), ('run', NULL), ('jump', NULL)), d AS (SELECT p_partkey % 3 AS clip, sum(p_size)::BIGINT AS ms FROM part GROUP BY 1)
 SELECT role, coalesce(c.clip, CASE WHEN role = 'run' THEN 2 END, 1)::INT AS clip, c.clip IS NULL AS fallback, CASE WHEN role = 'roll' AND c.clip IS NULL THEN 0.5 ELSE ms / 1000.0::DOUBLE / CASE WHEN role = 'run' AND c.clip IS NULL THEN 1.65 ELSE 1 END END::DOUBLE AS seconds FROM c JOIN d ON d.clip = coalesce(c.clip, CASE WHEN role = 'run' THEN 2 END, 1)""")
def role_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clip that stands in for each role, and how long it plays: run takes walk's, the others idle's."""
    roles = spark.createDataFrame([("idle", 1), ("walk", 2), ("roll", None), ("run", None), ("jump", None)], "role string, bound int")
    lengths = table(spark, sf_dir, "part").groupBy((_k() % 3).cast("int").alias("clip")).agg(F.sum("p_size").alias("ms"))
    own = roles.withColumn("clip", F.coalesce("bound", F.when(F.col("role") == "run", 2), F.lit(1)))
    faster = F.when((F.col("role") == "run") & F.col("bound").isNull(), 1.65).otherwise(1.0)
    seconds = F.when((F.col("role") == "roll") & F.col("bound").isNull(), 0.5).otherwise(F.col("ms") / F.lit(1000.0) / faster)
    return own.join(lengths, "clip").select("role", "clip", F.col("bound").isNull().alias("fallback"), seconds.alias("seconds"))

"""Line deduplication by overlapping windows of three lines, in DataFrame operations only.

A window is three consecutive lines of a text (split at \\n) of which at least one holds more than spaces. Of all occurrences of the same
three lines, the first in order of (doc_id, text's hash, position) stays; the lines that any later occurrence covers are removed, and the
rest of the text is joined again. A text of fewer than three lines has no window and stays as it is.

Windows are counted by an aggregate that sums on the map side, and only those that occur again are joined with their occurrences. Of these,
the few that make up more than one in HOT of all such occurrences are dealt over SALTS tasks.

Null texts stay null. Rows that repeat a doc_id with the same text count as one document, so neither is the later one; those that repeat it
with other texts are documents of their own. A null doc_id is an id like others, before them. Extra columns pass through, whatever their
names. A table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm._stage import column, written

WINDOW = 3
HOT, SALTS = 4096, 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _windows(lines: Column, size: int) -> Column:
    """(position, two independent 64-bit hashes of the lines there), without windows of blank lines only."""

    def at(i: Column) -> Column:
        own = [F.get(lines, i + k) for k in range(size)]
        return F.struct(i.cast("int").alias("pos"), F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit("second"), *reversed(own)).alias("h2"), (F.trim(F.concat(*own)) == "").alias("blank"))

    n = F.size(lines) - size
    return F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), at), lambda w: ~w["blank"])


_KEY = ("doc_id", "hash", "size")


def _key(doc_id: Column, text: Column) -> list[Column]:
    """What stands for a row: its id, and its text by a hash and a length."""
    return [doc_id.alias("doc_id"), F.xxhash64(text).alias("hash"), F.length(text).alias("size")]


def repeated_positions(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, hash, size (xxhash64 and length of the text), covered: the positions of lines in later occurrences of a window,
    ascending; documents without any have no row."""
    docs = documents.select(*_key(column(doc_id), column(text)), _lines(column(text)).alias("lines")).where(F.size("lines") >= window)
    found = docs.select(*_KEY, F.explode(_windows(F.col("lines"), window)).alias("w")).select("w.h1", "w.h2", F.struct(*_KEY, "w.pos").alias("at"))
    # One row for each window and task reaches the exchange, however often the window occurs.
    first, _ = written(found.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")).where(F.col("first") != F.col("last")).drop("last"), "windows")
    total = first.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > total
    # Fewer than HOT windows can have more than one in HOT of the occurrences.
    dealt = found.join(F.broadcast(first.where(hot).select("h1", "h2", F.lit(1).alias("hot"))), ["h1", "h2"], "left")
    dealt = dealt.select("h1", "h2", "at", F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("at"), F.lit(SALTS))).cast("int").alias("salt"))
    salted = first.select("h1", "h2", "first", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    later = dealt.join(salted, ["h1", "h2", "salt"]).where(F.col("at") != F.col("first"))
    spans = later.groupBy(*[f"at.{k}" for k in _KEY]).agg(F.collect_set("at.pos").alias("starts"))
    reach = F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (window - 1))))
    return spans.select(*_KEY, F.array_sort(F.array_distinct(reach)).alias("covered"))


def dedup_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, removed: str | None = None) -> DataFrame:
    """The documents with later occurrences removed from their texts; removed: a column for the number of lines taken out."""
    columns = documents.columns
    held = documents.select(*_key(column(doc_id), column(text)), F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("held"))
    gone = repeated_positions(documents, doc_id, text, window).select(*[F.col(k).alias(f"g_{k}") for k in _KEY], "covered")
    joined = held.join(gone, (F.col("doc_id").eqNullSafe(F.col("g_doc_id"))) & (F.col("hash") == F.col("g_hash")) & (F.col("size") == F.col("g_size")), "left")
    own = F.col("held").getField(f"c{columns.index(text)}")
    lines = _lines(own)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered"))
    rest = F.when(F.col("covered").isNull(), own).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    out = [rest.alias(c) if c == text else F.col("held").getField(f"c{i}").alias(c) for i, c in enumerate(columns)]
    if removed:
        out.append(F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias(removed))
    return joined.select(*out)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text after the removal, and the lines removed from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, removed="n_removed").select("doc_id", "text", "n_removed")


OP10_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, i::INT AS pos, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] AS win
  FROM (SELECT doc_id, ls, unnest(range(0, greatest(len(ls) - 2, 0))) AS i FROM l)
),
real AS (SELECT * FROM w WHERE trim(replace(win, chr(10), '')) <> ''),
ranked AS (SELECT doc_id, pos, rank() OVER (PARTITION BY win ORDER BY doc_id, pos) AS r FROM real),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE r > 1),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
line AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM l),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM line ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id,
       CASE WHEN n.n_removed IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text,
       coalesce(n.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

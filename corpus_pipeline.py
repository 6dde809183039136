"""From raw documents to packed training windows: five stages, each written as Parquet and read again by the next.

Counted with rasterloom.llm. `run` applies STAGES to the documents of a folder; a stage takes (spark, docs, sf_dir). All stages but the
last return the columns of documents. Every stage first has the executors give back the heap of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from rasterloom.llm._stage import fresh, heaps_emptied, removed, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic; it learns from the labelled documents of the folder."""
    heaps_emptied(spark)
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, chain)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut out. A document of which no text is left is a copy and goes."""
    heaps_emptied(spark)
    gone = fresh(docs, "removed")
    rest = line_dedup.dedup_lines(docs, removed=gone)
    rest = rest.where((F.col(gone) == 0) | (F.trim(F.replace("text", F.lit("\n"), F.lit(""))) != "")).drop(gone)
    if "n_chars" not in docs.columns:
        return rest
    n = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return rest.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at five words and a similarity of 0.8, the one with the smallest id."""
    heaps_emptied(spark)
    return ngram_join.one_of_each(docs, 5, 80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words of a benchmark item."""
    heaps_emptied(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 ids, with the ids."""
    heaps_emptied(spark)
    return packing.pack(docs, packing.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", one_of_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]
#: SQL cannot score texts or pack ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, with a checksum in place of the ids."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, next_path = written(stage(spark, docs, sf_dir), name)
        if path:
            removed(spark, path)
        path = next_path
    return docs.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

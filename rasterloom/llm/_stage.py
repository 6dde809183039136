"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset (tests on one machine) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if (made := getattr(spark, "_rasterloom_dir", None)) is None:
        made = spark._rasterloom_dir = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
    return made


def column(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column has, in any case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch between the JVM and Python while a table is written.
ROWS = 1000

#: Tables that results still read; they go when the driver's Python ends.
_LEFT: dict[str, SparkSession] = {}


@atexit.register
def _clean() -> None:
    for path, spark in list(_LEFT.items()):
        try:
            removed(spark, path)
        except Exception:  # the JVM has ended: the folder's owner must clear it
            return


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same rows read from a new table, and its path. Nothing of what made them is needed any more, so its shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rasterloom/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    # Rows of whole texts go to Python and back in batches; small ones keep the memory beside the heap small.
    had = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(had), ROWS) if int(had) > 0 else ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, had)
    _LEFT[path] = spark
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that `written` made."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _LEFT.pop(path, None)


Batches = Iterator[pa.RecordBatch]


def _released(encoders: bool) -> None:
    """Gives memory that nothing holds back to the system; it would stay with an idle worker."""
    if not encoders and (tokens := sys.modules.get("rasterloom.llm._tokens")):
        tokens.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def lean(run: Callable[[Batches], Batches], encoders: bool = False) -> Callable[[Batches], Batches]:
    """The same function for a worker that keeps little after a task; encoders: whether those of vocabularies stay for the next one."""

    def held(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            _released(encoders)

    return held


def heaps_emptied(spark: SparkSession) -> None:
    """Has the executors collect their garbage, so that a step does not begin with the heap that the one before has filled. A small task
    for each core; an executor that gets none keeps its heap, which does no harm to results."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """many joined with one, which has a row for each key at most: the rows of a key are dealt over `salts` parts by `spread`."""
    left = many.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = one.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")

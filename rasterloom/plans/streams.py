"""Streaming queries. The reference has no streams: these are an extension over the events table."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.plans.registry import plan
from rasterloom.streaming.windows import tumbling_counts


def _folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only where that is unset, on one machine, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
    return f"{found.rstrip('/')}/streams/{uuid.uuid4().hex}"


@plan("SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts)) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2")
def ext_stream_daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling days with a watermark of a day, appended to a table. Its rows are the days that the watermark has closed."""
    source = f"{sf_dir}/event[s].parquet"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(source).select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    out = _folder(spark)
    day = tumbling_counts(rows, "at", ["event_type"], "1 day", "1 day").select(F.col("start").cast("date").alias("day"), "event_type", "n")
    query = day.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    closed = spark.read.schema("day date, event_type string, n long").parquet(f"{out}/rows")
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.date_sub(F.to_date(F.max("ts")), 1).alias("last"))
    return closed.join(F.broadcast(last), F.col("day") < F.col("last")).select("day", "event_type", "n")

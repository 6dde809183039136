"""Event-time windows over streams; the same functions work on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(rows: DataFrame, time: str, by: list[str], every: str, late: str) -> DataFrame:
    """(start, by.., n): rows in each window of `every`; in append mode a window appears once the watermark `late` has passed it."""
    counts = rows.withWatermark(time, late).groupBy(F.window(time, every), *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), *by, "n")


def first_of_each(rows: DataFrame, time: str, key: str, late: str) -> DataFrame:
    """The first row of each key within the watermark: requests that are sent again count once."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])

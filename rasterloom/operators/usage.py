"""Usage analytics over rows of (day, provider, model, status, requests, completed, cost_micros, unknown_costs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MEASURES = ("requests", "completed", "cost_micros", "unknown_costs")
UNKNOWN = "Date unknown"
PAGE = 50
_STEP = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}


def filter_activity(rows: DataFrame, provider: str | None = None, model: str | None = None, status: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Equality filters and an inclusive range of days; rows without a day go only under a range."""
    for name, value in (("provider", provider), ("model", model), ("status", status)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if since:
        rows = rows.where(F.col("day") >= since)
    if until:
        rows = rows.where(F.col("day") <= until)
    return rows


def bucket(day: Column, group: str) -> Column:
    """The day, the Monday of its week, or its month, as text."""
    if group == "month":
        return F.substring(day, 1, 7)
    return F.date_format(F.date_trunc("week", F.to_date(day)), "yyyy-MM-dd") if group == "week" else day


def aggregate_activity(rows: DataFrame, group: str) -> DataFrame:
    """Sums by key. Days, weeks and months between the first and the last get rows of zeros; rows without a day have a key of their own."""
    key = F.col(group) if group in ("provider", "model") else F.coalesce(bucket(F.col("day"), group), F.lit(UNKNOWN))
    sums = rows.groupBy(key.alias("key")).agg(*[F.sum(m).alias(m) for m in MEASURES])
    if group not in _STEP:
        return sums
    first = F.to_date(F.concat("lo", F.lit("-01"))) if group == "month" else F.to_date("lo")
    last = F.to_date(F.concat("hi", F.lit("-01"))) if group == "month" else F.to_date("hi")
    span = sums.where(F.col("key") != UNKNOWN).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo is not null")
    dates = span.select(F.explode(F.sequence(first, last, F.expr(_STEP[group]))).alias("d"))
    calendar = dates.select(F.date_format("d", "yyyy-MM" if group == "month" else "yyyy-MM-dd").alias("key"))
    # Both sides have at most one row for each key: a calendar, not the facts.
    return calendar.join(sums, "key", "full").select("key", *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES])


def usage_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in MEASURES])


def metric_value(metric: str) -> Column:
    return F.col({"cost": "cost_micros", "completed": "completed"}.get(metric, "requests"))


def local_usage(rows: DataFrame) -> DataFrame:
    """Micro-dollars of finished, failed and running requests, and by provider and model."""
    cost = F.col("cost_micros")
    part = lambda c: F.coalesce(F.sum(F.when(c, cost)), F.lit(0)).cast("long")
    done, failed = F.col("status") == "done", F.col("status") == "failed"
    return rows.groupBy("provider", "model").agg(F.count("*").alias("count"), F.sum(cost).alias("micros"), part(done).alias("completed_micros"), part(failed).alias("failed_micros"), part(~done & ~failed).alias("active_micros"))


def billing(rows: DataFrame) -> DataFrame:
    """Adds billing_status: finished requests are charged, failed ones refunded unless their cost is unknown, others open."""
    return rows.withColumn("billing_status", F.when(F.col("status") == "done", "charged").when((F.col("status") == "failed") & (F.col("unknown_costs") == 0), "refunded"))


def usage_groups(jobs: DataFrame) -> DataFrame:
    """owner, model, provider: requests, charged micro-dollars, failures of unknown cost."""
    charged = F.coalesce(F.sum(F.when(F.col("billing_status") == "charged", F.col("cost_micros"))), F.lit(0)).cast("long")
    return jobs.groupBy("owner", "model", "provider").agg(F.count("*").alias("count"), charged.alias("charged"), F.count_if((F.col("status") == "failed") & F.col("billing_status").isNull()).alias("unknown"))


def usage_page(jobs: DataFrame, owner: int, page: int) -> DataFrame:
    """A page of an owner's requests, newest first. The limit is the feature."""
    return jobs.where(F.col("owner") == owner).orderBy(F.desc("ts"), F.desc("event_id")).offset(page * PAGE).limit(PAGE)


def credit_outcome() -> Column:
    failed = F.col("status") == "failed"
    return (
        F.when(F.col("billing_status") == "refunded", "Returned")
        .when(F.col("billing_status") == "charged", F.when(failed, "Charged · uncertain result").otherwise("Charged"))
        .otherwise(F.when(failed, "Historical outcome unknown").otherwise("Reserved"))
    )


def ledger_replay(jobs: DataFrame, grants: DataFrame) -> DataFrame:
    """owner, available, reserved, spent: a request reserves its cost; a charge spends it, a refund gives it back.

    grants has (owner, key, micros); a key counts once.
    """
    granted = grants.dropDuplicates(["owner", "key"]).groupBy("owner").agg(F.sum("micros").alias("granted"))
    by = lambda c: F.coalesce(F.sum(F.when(c, F.col("cost_micros"))), F.lit(0))
    moved = jobs.groupBy("owner").agg(by(F.col("billing_status") == "charged").alias("spent"), by(F.col("billing_status").isNull()).alias("reserved"))
    joined = granted.join(moved, "owner", "left").fillna(0, ["spent", "reserved"])
    return joined.select("owner", (F.col("granted") - F.col("spent") - F.col("reserved")).cast("long").alias("available"), F.col("reserved").cast("long").alias("reserved"), F.col("spent").cast("long").alias("spent"))


def running_balance(jobs: DataFrame) -> DataFrame:
    """The running cost of each owner's requests in order of time; a window within an owner."""
    w = W.partitionBy("owner").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return jobs.withColumn("running_micros", F.sum("cost_micros").over(w))

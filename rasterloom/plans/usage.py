"""Queries of usage analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import scalars
from rasterloom.operators import usage
from rasterloom.plans.registry import plan
from rasterloom.plans.relations import ACTIVITY, activity

_SUMS = "sum(requests)::BIGINT AS requests, sum(completed)::BIGINT AS completed, sum(cost_micros)::BIGINT AS cost_micros, sum(unknown_costs)::BIGINT AS unknown_costs"
_ZERO = "coalesce(requests, 0) AS requests, coalesce(completed, 0) AS completed, coalesce(cost_micros, 0) AS cost_micros, coalesce(unknown_costs, 0) AS unknown_costs"


def _filled(key: str, step: str, form: str, first: str) -> str:
    return f"""WITH {ACTIVITY}, s AS (SELECT coalesce({key}, 'Date unknown') AS key, {_SUMS} FROM act GROUP BY 1),
    m AS (SELECT min(key) AS lo, max(key) AS hi FROM s WHERE key <> 'Date unknown'),
    c AS (SELECT strftime(unnest(generate_series({first.format('lo')}, {first.format('hi')}, INTERVAL {step})), '{form}') AS key FROM m)
    SELECT key, {_ZERO} FROM c FULL JOIN s USING (key)"""


@plan(_filled("strftime(date_trunc('week', day::DATE), '%Y-%m-%d')", "7 DAY", "%Y-%m-%d", "{}::TIMESTAMP"))
def usage_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.aggregate_activity(activity(spark, sf_dir), "week")


@plan(_filled("day", "1 DAY", "%Y-%m-%d", "{}::TIMESTAMP"))
def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.aggregate_activity(activity(spark, sf_dir), "day")


@plan(_filled("day[1:7]", "1 MONTH", "%Y-%m", "({} || '-01')::TIMESTAMP"))
def usage_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.aggregate_activity(activity(spark, sf_dir), "month")


@plan(f"WITH {ACTIVITY} SELECT provider AS key, {_SUMS} FROM act GROUP BY 1")
def usage_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.aggregate_activity(activity(spark, sf_dir), "provider")


@plan(f"WITH {ACTIVITY} SELECT model AS key, {_SUMS} FROM act GROUP BY 1")
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.aggregate_activity(activity(spark, sf_dir), "model")


@plan(f"WITH {ACTIVITY} SELECT model, day, {_SUMS} FROM act WHERE provider = 'even' AND status = 'done' AND day >= '2024-01-05' AND day <= '2024-01-20' GROUP BY 1, 2")
def usage_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage.filter_activity(activity(spark, sf_dir), provider="even", status="done", since="2024-01-05", until="2024-01-20")
    return rows.groupBy("model", "day").agg(*[F.sum(m).alias(m) for m in usage.MEASURES])


@plan(f"WITH {ACTIVITY} SELECT {_SUMS} FROM act")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_totals(activity(spark, sf_dir))


@plan(f"""WITH {ACTIVITY}, s AS (SELECT model AS key, {_SUMS} FROM act GROUP BY 1)
SELECT key, unnest(['cost', 'completed', 'requests']) AS metric, unnest([cost_micros, completed, requests]) AS value FROM s""")
def usage_metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = usage.aggregate_activity(activity(spark, sf_dir), "model")
    values = F.array(*[F.struct(F.lit(m).alias("metric"), usage.metric_value(m).alias("value")) for m in ("cost", "completed", "requests")])
    return sums.select("key", F.inline(values))


@plan(f"""WITH {ACTIVITY} SELECT provider, model, count(*) AS count, sum(cost_micros)::BIGINT AS micros,
 coalesce(sum(cost_micros) FILTER (status = 'done'), 0)::BIGINT AS completed_micros,
 coalesce(sum(cost_micros) FILTER (status = 'failed'), 0)::BIGINT AS failed_micros,
 coalesce(sum(cost_micros) FILTER (status NOT IN ('done', 'failed')), 0)::BIGINT AS active_micros FROM act GROUP BY 1, 2""")
def local_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.local_usage(activity(spark, sf_dir))


_BILLED = ACTIVITY + ", jobs AS (SELECT *, CASE WHEN status = 'done' THEN 'charged' WHEN status = 'failed' AND unknown_costs = 0 THEN 'refunded' END AS billing_status FROM act)"


@plan(f"""WITH {_BILLED} SELECT owner, model, provider, count(*) AS count, coalesce(sum(cost_micros) FILTER (billing_status = 'charged'), 0)::BIGINT AS charged,
 count(*) FILTER (status = 'failed' AND billing_status IS NULL) AS unknown FROM jobs GROUP BY 1, 2, 3""")
def usage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_groups(usage.billing(activity(spark, sf_dir)))


@plan(f"""WITH {_BILLED} SELECT owner, day, model, provider, status, count(*) AS requests, coalesce(sum(cost_micros) FILTER (billing_status = 'charged'), 0)::BIGINT AS cost,
 count(*) FILTER (status = 'failed' AND billing_status IS NULL) AS unknown FROM jobs GROUP BY 1, 2, 3, 4, 5""")
def usage_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    charged = F.coalesce(F.sum(F.when(F.col("billing_status") == "charged", F.col("cost_micros"))), F.lit(0)).cast("long")
    jobs = usage.billing(activity(spark, sf_dir))
    return jobs.groupBy("owner", "day", "model", "provider", "status").agg(F.count("*").alias("requests"), charged.alias("cost"), F.count_if((F.col("status") == "failed") & F.col("billing_status").isNull()).alias("unknown"))


@plan(f"WITH {_BILLED} SELECT event_id, model, status, cost_micros FROM jobs WHERE owner = 7 ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50")
def usage_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_page(usage.billing(activity(spark, sf_dir)), 7, 1).select("event_id", "model", "status", "cost_micros")


@plan(f"""WITH {_BILLED} SELECT status, billing_status, CASE WHEN billing_status = 'refunded' THEN 'Returned'
 WHEN billing_status = 'charged' THEN CASE WHEN status = 'failed' THEN 'Charged · uncertain result' ELSE 'Charged' END
 WHEN status = 'failed' THEN 'Historical outcome unknown' ELSE 'Reserved' END AS outcome, count(*) AS n FROM jobs GROUP BY 1, 2, 3""")
def credit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = usage.billing(activity(spark, sf_dir))
    return jobs.groupBy("status", "billing_status", usage.credit_outcome().alias("outcome")).agg(F.count("*").alias("n"))


@plan(f"""WITH {_BILLED}, g AS (SELECT owner, sum(micros)::BIGINT AS granted FROM (SELECT DISTINCT owner, owner % 3 AS key, 500000000 AS micros FROM jobs) GROUP BY 1),
 m AS (SELECT owner, coalesce(sum(cost_micros) FILTER (billing_status = 'charged'), 0)::BIGINT AS spent, coalesce(sum(cost_micros) FILTER (billing_status IS NULL), 0)::BIGINT AS reserved FROM jobs GROUP BY 1)
 SELECT owner, granted - spent - reserved AS available, reserved, spent FROM g JOIN m USING (owner)""")
def ledger_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = usage.billing(activity(spark, sf_dir))
    grants = jobs.select("owner", (F.col("owner") % 3).alias("key"), F.lit(500_000_000).cast("long").alias("micros"))
    return usage.ledger_replay(jobs, grants)


@plan(f"WITH {_BILLED} SELECT event_id, owner, sum(cost_micros) OVER (PARTITION BY owner ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running_micros FROM jobs")
def ledger_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.running_balance(usage.billing(activity(spark, sf_dir))).select("event_id", "owner", "running_micros")


@plan(f"""WITH {ACTIVITY}, s AS (SELECT owner, sum(cost_micros)::BIGINT AS m FROM act GROUP BY 1), t AS (SELECT owner, m, format('{{:,.6f}}', m / 1000000) AS f FROM s)
SELECT owner, '$' || regexp_replace(f, '(\\.\\d\\d\\d*?)0+$', '\\1') AS money FROM t""")
def usage_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = activity(spark, sf_dir).groupBy("owner").agg(F.sum("cost_micros").alias("m"))
    return sums.select("owner", scalars.money(F.col("m")).alias("money"))


@plan("SELECT count(*) FILTER (value < 0) AS negative, count(*) FILTER (event_id IS NULL) AS no_id, count(*) - count(DISTINCT event_id) AS repeated, count(*) FILTER (event_type NOT IN ('click', 'purchase', 'error', 'signup', 'view')) AS unknown_type FROM events")
def ledger_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraint checks as one aggregate."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.agg(F.count_if(F.col("value") < 0).alias("negative"), F.count_if(F.col("event_id").isNull()).alias("no_id"), (F.count("*") - F.count_distinct("event_id")).alias("repeated"), F.count_if(~F.col("event_type").isin("click", "purchase", "error", "signup", "view")).alias("unknown_type"))


@plan("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents by a fixed schema."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))

"""Costs, trajectories, jobs and feedback over ``events``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import scoring
from lodestone.operators import costs, history
from lodestone.plans.registry import query
from lodestone.sources import table

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
PRICES = {"purchase": ("0.005", "0.015"), "view": ("0.00015", "0.0006"), "click": ("0.0025", "0.01")}
DEFAULT = ("0.001", "0.002")

_CASE = "CASE event_type WHEN 'purchase' THEN {0} WHEN 'view' THEN {1} WHEN 'click' THEN {2} ELSE {3} END"
_IN = _CASE.format(*(f"CAST('{p[0]}' AS DECIMAL(10,6))" for p in (*PRICES.values(), DEFAULT)))
_OUT = _CASE.format(*(f"CAST('{p[1]}' AS DECIMAL(10,6))" for p in (*PRICES.values(), DEFAULT)))
# decimals throughout: x / 1000 is taken as x * 0.001, exact at nine places and then rounded to six
_USAGE = f"""
u AS (
  SELECT *, user_id % 10 AS tenant, CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, event_id % 500 AS completion_tokens FROM events),
p AS (
  SELECT *, CAST(CAST(prompt_tokens AS DECIMAL(12,0)) * {_IN} * CAST('0.001' AS DECIMAL(4,3)) AS DECIMAL(12,6)) AS input_cost,
    CAST(CAST(completion_tokens AS DECIMAL(12,0)) * {_OUT} * CAST('0.001' AS DECIMAL(4,3)) AS DECIMAL(12,6)) AS output_cost FROM u),
c AS (
  SELECT *, CAST(input_cost + output_cost AS DECIMAL(12,6)) AS total_cost,
    CASE WHEN event_id % 3 = 0 THEN CAST('0.001' AS DECIMAL(12,6)) END AS baseline_cost FROM p)"""


def usage(spark, sf_dir):
    """The events as model calls with their cost."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", (F.col("user_id") % 10).alias("tenant"), F.floor(F.col("value") * 10).alias("prompt_tokens"), (F.col("event_id") % 500).alias("completion_tokens")
    )
    return costs.priced(events, "event_type", PRICES, DEFAULT).withColumn("baseline_cost", F.when(F.col("event_id") % 3 == 0, F.lit("0.001").cast(costs.MONEY)))


_TOTALS = """count(*) AS requests, coalesce(CAST(sum(prompt_tokens) AS BIGINT), 0) AS prompt_tokens, coalesce(CAST(sum(completion_tokens) AS BIGINT), 0) AS completion_tokens,
  coalesce(sum(total_cost), 0) AS cost,
  coalesce(sum(CASE WHEN baseline_cost > total_cost THEN baseline_cost - total_cost END), 0) AS savings,
  coalesce(sum(CASE WHEN baseline_cost < total_cost THEN total_cost - baseline_cost END), 0) AS premium"""


@query("cost_by_tenant", f"WITH {_USAGE} SELECT tenant, {_TOTALS} FROM c GROUP BY tenant")
def cost_by_tenant(spark, sf_dir):
    """Totals, savings and premium by tenant."""
    return costs.totals(usage(spark, sf_dir), "tenant")


@query("cost_by_model", f"WITH {_USAGE} SELECT event_type, {_TOTALS} FROM c GROUP BY event_type")
def cost_by_model(spark, sf_dir):
    """The same by model."""
    return costs.totals(usage(spark, sf_dir), "event_type")


@query("cost_trend_hour", f"WITH {_USAGE} SELECT date_trunc('hour', ts) AS bucket, {_TOTALS} FROM c WHERE ts > {AS_OF} - INTERVAL 7 DAY GROUP BY 1")
def cost_trend_hour(spark, sf_dir):
    """Hourly trend of the trailing week."""
    recent = usage(spark, sf_dir).where(f"ts > {AS_OF.replace('TIMESTAMP', 'TIMESTAMP_NTZ')} - INTERVAL 7 DAYS")
    return costs.totals(recent.withColumn("bucket", F.date_trunc("hour", "ts").cast("timestamp_ntz")), "bucket")


@query("cost_trend_day", f"WITH {_USAGE} SELECT tenant, date_trunc('day', ts)::TIMESTAMP AS bucket, {_TOTALS} FROM c GROUP BY 1, 2")
def cost_trend_day(spark, sf_dir):
    """Daily trend by tenant."""
    return costs.totals(usage(spark, sf_dir).withColumn("bucket", F.date_trunc("day", "ts").cast("timestamp_ntz")), "tenant", "bucket")


@query(
    "cost_alerts",
    f"""
WITH {_USAGE},
s AS (SELECT tenant, coalesce(sum(total_cost) FILTER (ts > {AS_OF} - INTERVAL 1 DAY), 0) AS day_cost, coalesce(sum(total_cost), 0) AS month_cost
  FROM c WHERE ts > {AS_OF} - INTERVAL 30 DAY AND ts <= {AS_OF} GROUP BY tenant),
k AS (SELECT t AS tenant, t <> 3 AS enabled, CAST(0.05 * t AS DECIMAL(12,6)) AS day_limit, CAST(0.5 * t AS DECIMAL(12,6)) AS month_limit FROM range(8) r(t))
SELECT tenant, coalesce(enabled, false) AS enabled, day_cost, month_cost,
  coalesce(enabled AND day_cost >= day_limit, false) AS day_alert, coalesce(enabled AND month_cost >= month_limit, false) AS month_alert
FROM s LEFT JOIN k USING (tenant)""",
)
def cost_alerts(spark, sf_dir):
    """Alert state by tenant from a table of limits."""
    t = F.col("tenant")
    config = spark.range(8).select(F.col("id").alias("tenant")).select("tenant", (t != 3).alias("enabled"), (F.lit(0.05) * t).cast(costs.MONEY).alias("day_limit"), (F.lit(0.5) * t).cast(costs.MONEY).alias("month_limit"))
    return costs.alerts(usage(spark, sf_dir), config, F.expr(AS_OF.replace("TIMESTAMP", "TIMESTAMP_NTZ")), "tenant", "ts")


@query(
    "cost_premium",
    f"WITH {_USAGE} SELECT event_id, greatest(total_cost - baseline_cost, 0) AS premium FROM c WHERE baseline_cost IS NOT NULL",
)
def cost_premium(spark, sf_dir):
    """Premium of each call that has a baseline."""
    premium = F.greatest(F.col("total_cost") - F.col("baseline_cost"), F.lit(0).cast(costs.MONEY))
    return usage(spark, sf_dir).where("baseline_cost IS NOT NULL").select("event_id", premium.alias("premium"))


@query("recent_events_page", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def recent_events_page(spark, sf_dir):
    """Third page of twenty of the events, newest first."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").offset(40).limit(20).select("event_id", "user_id", "event_type")


@query("fallback_tokens", r"SELECT doc_id, CAST(ceil(CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS DOUBLE) * CAST(1.3 AS DOUBLE)) AS BIGINT) AS tokens FROM documents")
def fallback_tokens(spark, sf_dir):
    """Estimated tokens of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", costs.fallback_tokens(F.col("text")).alias("tokens"))


@query(
    "trajectories",
    """
SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_events, max(ts) AS last_event_at,
  CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) // 1000 AS duration_ms, bool_or(contains(lower(event_type), 'error')) AS has_error
FROM events GROUP BY 1, 2""",
)
def trajectories(spark, sf_dir):
    """Events, duration and error flag of each user and day."""
    return history.trajectories(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"], "ts", "event_type")


@query(
    "user_event_counts",
    """
SELECT c_custkey, coalesce(n, 0) AS event_count, last_event_at FROM customer
LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) AS last_event_at FROM events GROUP BY 1) ON user_id = c_custkey""",
)
def user_event_counts(spark, sf_dir):
    """Event count and last event of each customer, 0 without events."""
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_event_at"))
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(counts, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("event_count"), "last_event_at")


@query(
    "job_states",
    """
WITH s AS (SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status FROM events)
SELECT job_id, arg_max(status, (ts, event_id)) AS status, min(ts) FILTER (status = 'running') AS started_at,
  max(ts) FILTER (status IN ('completed', 'failed')) AS completed_at FROM s GROUP BY 1""",
)
def job_states(spark, sf_dir):
    """Last state of each job folded from its status events."""
    kind = F.col("event_type")
    status = F.when(kind == "signup", "queued").when(kind.isin("view", "click"), "running").when(kind == "purchase", "completed").otherwise("failed")
    return history.job_states(table(spark, sf_dir, "events").withColumn("status", status).withColumnRenamed("user_id", "job_id"), "job_id", "ts", "event_id")


_FEEDBACK = "f AS (SELECT user_id AS query_id, event_type, ts, (event_id % 21 - 10) / 10.0 AS score FROM events)"


def _feedback(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), "event_type", "ts", ((F.col("event_id") % 21 - 10) / 10.0).alias("score"))


def _faded(rows):
    """``rows`` (ts) with the weight that their age leaves them."""
    as_of = F.expr(AS_OF.replace("TIMESTAMP", "TIMESTAMP_NTZ"))
    age = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400000000)
    return rows.withColumn("decay", scoring.feedback_decay(age, 10))


@query(
    "feedback_stats",
    f"""
WITH {_FEEDBACK}
SELECT query_id, count(*) AS total, count(*) FILTER (score > 0) AS positive, count(*) FILTER (score < 0) AS negative, count(*) FILTER (score = 0) AS neutral,
  round(avg(score), 6) AS mean, count(*) FILTER (event_type = 'error') AS corrections, max(ts) AS last_at FROM f GROUP BY 1""",
)
def feedback_stats(spark, sf_dir):
    """Counts by sign, mean, corrections and last time of each query's feedback."""
    return history.feedback_stats(_feedback(spark, sf_dir), "query_id", "score", "ts", F.col("event_type") == "error")


@query(
    "feedback_boost",
    f"""
WITH {_FEEDBACK},
a AS (SELECT *, CAST(floor((epoch_us({AS_OF}) - epoch_us(ts)) / 86400000000.0) AS BIGINT) AS age FROM f WHERE event_type <> 'error'),
d AS (SELECT *, CASE WHEN age <= 10 THEN 1.0 ELSE exp(-(age - 10) / 10.0) END AS decay FROM a),
g AS (SELECT query_id, count(*) AS n, sum(score * decay) / sum(decay) AS mean FROM d GROUP BY 1)
SELECT query_id, n, round(CASE WHEN n < 10 THEN 1.0 ELSE greatest(0.5, least(1.5, 1 + 0.5 * mean)) END, 6) AS boost,
  round(CASE WHEN n < 10 THEN n / 10.0 ELSE least(1.0, n / 20.0) END, 6) AS confidence FROM g""",
)
def feedback_boost(spark, sf_dir):
    """Ranking boost of each query from feedback that fades after ten days."""
    faded = _faded(_feedback(spark, sf_dir).where("event_type <> 'error'"))
    return history.boost(faded, "query_id", "score", "decay")


@query(
    "bounded_history",
    "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 25",
)
def bounded_history(spark, sf_dir):
    """The 25 newest events of each user; older ones are evicted."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(newest).alias("r")).where("r <= 25").drop("r")

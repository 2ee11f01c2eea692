"""Telemetry over ``events``: event type as strategy, value / 10 as seconds, props.k % 4 as reason."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import telemetry
from lodestone.plans.registry import query
from lodestone.sources import table

_M = "m AS (SELECT event_id, ts, user_id, event_type AS strategy, value / 10 AS latency, CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS reason, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS sec FROM events)"
_LE = ", ".join(f"({b})" for b in telemetry.BOUNDS)
_H = f"""
b AS (SELECT CAST(v AS DOUBLE) AS le FROM (VALUES {_LE}, ('inf'::DOUBLE)) x(v)),
h AS (SELECT strategy, le, count(*) FILTER (latency <= le) AS n FROM m, b GROUP BY 1, 2)"""
_Q = """
r AS (SELECT *, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS low, {q} * max(n) OVER (PARTITION BY strategy) AS want,
  max(CASE WHEN le < 'inf'::DOUBLE THEN le END) OVER (PARTITION BY strategy) AS finite FROM h WINDOW w AS (PARTITION BY strategy ORDER BY le))"""
_V = "round(arg_min(CASE WHEN le = 'inf'::DOUBLE THEN finite ELSE low + (le - low) * (want - below) / (n - below) END, le), 6)"


def metrics(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("strategy"), (F.col("value") / 10).alias("latency"),
        (F.get_json_object("props", "$.k").cast("long") % 4).alias("reason"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("sec"),
    )


@query("telemetry_histogram", f"WITH {_M}, {_H} SELECT strategy, le, n FROM h")
def telemetry_histogram(spark, sf_dir):
    """Cumulative latency buckets by strategy."""
    return telemetry.histogram(metrics(spark, sf_dir), ["strategy"], "latency")


def _quantile(spark, sf_dir, q):
    return telemetry.quantile(telemetry.histogram(metrics(spark, sf_dir), ["strategy"], "latency"), ["strategy"], q)


def _quantile_sql(q, having=""):
    return f"WITH {_M}, {_H}, {_Q.format(q=q)} SELECT strategy, {_V} AS quantile FROM r WHERE n >= want AND below < want GROUP BY strategy {having}"


@query("telemetry_p95", _quantile_sql(0.95))
def telemetry_p95(spark, sf_dir):
    """95th percentile of latency by strategy, from the buckets."""
    return _quantile(spark, sf_dir, 0.95)


@query("telemetry_p95_alert", _quantile_sql(0.95, f"HAVING {_V} > 5"))
def telemetry_p95_alert(spark, sf_dir):
    """Strategies whose 95th percentile is above five seconds."""
    return _quantile(spark, sf_dir, 0.95).where("quantile > 5")


@query("telemetry_median", _quantile_sql(0.5))
def telemetry_median(spark, sf_dir):
    """Median latency by strategy."""
    return _quantile(spark, sf_dir, 0.5)


@query("telemetry_rate", f"WITH {_M} SELECT strategy, sec // 3600 AS hour, count(*) AS increase, round(count(*) / 3600.0, 9) AS rate FROM m GROUP BY 1, 2")
def telemetry_rate(spark, sf_dir):
    """Requests a second by strategy and hour."""
    grouped = metrics(spark, sf_dir).groupBy("strategy", F.floor(F.col("sec") / 3600).alias("hour")).agg(F.count(F.lit(1)).alias("increase"))
    return grouped.withColumn("rate", F.round(F.col("increase") / 3600, 9))


@query("telemetry_error_ratio", f"WITH {_M} SELECT user_id, count(*) AS total, count(*) FILTER (strategy = 'error') AS hits, round(count(*) FILTER (strategy = 'error') / count(*), 6) AS ratio FROM m GROUP BY 1 HAVING count(*) > 30")
def telemetry_error_ratio(spark, sf_dir):
    """Share of errors by tenant with enough traffic."""
    return telemetry.ratio(metrics(spark, sf_dir), ["user_id"], F.col("strategy") == "error", 30)


@query(
    "telemetry_baseline_drop",
    f"""
WITH {_M}, t AS (SELECT sec // 3600 AS hour, count(*) AS n, count(*) FILTER (strategy <> 'error') AS good FROM m GROUP BY 1),
b AS (SELECT x.hour, x.n, x.good, sum(y.n) AS base_n, sum(y.good) AS base_good FROM t x JOIN t y ON y.hour BETWEEN x.hour - 24 AND x.hour - 1 GROUP BY 1, 2, 3)
SELECT hour, round(good / n, 6) AS pass_rate, round(base_good / base_n, 6) AS baseline FROM b WHERE good / n < 0.8 * (base_good / base_n)""",
)
def telemetry_baseline_drop(spark, sf_dir):
    """Hours whose pass rate is below 0.8 of that of the 24 hours before."""
    from pyspark.sql import Window

    hours = metrics(spark, sf_dir).groupBy(F.floor(F.col("sec") / 3600).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("strategy") != "error").alias("good"))
    # one row an hour: days share a partition with the day before, so no window spans all hours
    day = hours.withColumn("part", F.explode(F.array(F.floor(F.col("hour") / 24), F.floor(F.col("hour") / 24) + 1)))
    before = Window.partitionBy("part").orderBy("hour").rangeBetween(-24, -1)
    rated = day.withColumn("base_n", F.sum("n").over(before)).withColumn("base_good", F.sum("good").over(before)).where(F.floor(F.col("hour") / 24) == F.col("part"))
    rate, base = F.col("good") / F.col("n"), F.col("base_good") / F.col("base_n")
    return rated.where(rate < F.lit(0.8) * base).select("hour", F.round(rate, 6).alias("pass_rate"), F.round(base, 6).alias("baseline"))


@query("telemetry_reasons", f"WITH {_M} SELECT reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM m GROUP BY 1")
def telemetry_reasons(spark, sf_dir):
    """Fallbacks by reason and their share."""
    found = metrics(spark, sf_dir)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).join(total).select("reason", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query(
    "telemetry_dashboard",
    f"WITH {_M} SELECT strategy, reason, CAST(to_timestamp(sec // 86400 * 86400) AS DATE) AS day, count(*) AS n, sum(CAST(latency * 10 AS DECIMAL(18,4))) AS total_value FROM m GROUP BY ALL",
)
def telemetry_dashboard(spark, sf_dir):
    """Requests and total value by strategy, reason and day."""
    return metrics(spark, sf_dir).groupBy("strategy", "reason", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("latency") * 10).cast("decimal(18,4)")).alias("total_value"))


@query(
    "telemetry_firing",
    f"""
WITH {_M}, t AS (SELECT strategy, sec // 3600 * 3600 AS tick, count(*) AS n FROM m GROUP BY 1, 2),
i AS (SELECT *, tick / 3600 - row_number() OVER (PARTITION BY strategy ORDER BY tick) AS island FROM t WHERE n >= 2)
SELECT strategy, min(tick) AS first_tick, count(*) AS n_ticks FROM i GROUP BY strategy, island HAVING count(*) >= 3""",
)
def telemetry_firing(spark, sf_dir):
    """Runs of three hours or more with at least two requests in each."""
    ticks = metrics(spark, sf_dir).groupBy("strategy", (F.floor(F.col("sec") / 3600) * 3600).alias("tick")).agg(F.count(F.lit(1)).alias("n"))
    return telemetry.firing(ticks, ["strategy"], "tick", F.col("n") >= 2, 3600, 3)


@query("rate_limit_fixed", f"WITH {_M} SELECT event_id, row_number() OVER (PARTITION BY user_id, sec // 86400 ORDER BY sec, event_id) <= 2 AS allowed FROM m")
def rate_limit_fixed(spark, sf_dir):
    """Two events a day and user are allowed."""
    return telemetry.fixed_window_limit(metrics(spark, sf_dir), "user_id", F.col("sec"), "event_id", 86400, 2).select("event_id", "allowed")


@query(
    "sessions_ttl",
    f"""
WITH {_M}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, no""",
)
def sessions_ttl(spark, sf_dir):
    """Sessions that end after six hours without activity."""
    return telemetry.sessions(metrics(spark, sf_dir), "user_id", "ts", "6 hours")


@query(
    "telemetry_tenant_quality",
    f"""
WITH {_M}, g AS (SELECT user_id, sec // 86400 AS day, count(*) AS total, count(*) FILTER (strategy = 'purchase') AS passed FROM m WHERE strategy IN ('purchase', 'error') GROUP BY 1, 2),
r AS (SELECT user_id, sec // 86400 AS day, count(*) / 86400 AS rate FROM m WHERE strategy IN ('view', 'click') GROUP BY 1, 2)
SELECT g.user_id, g.day, round(passed / total, 6) AS pass_rate, round(rate, 9) AS traffic FROM g JOIN r ON r.user_id = g.user_id AND r.day = g.day WHERE passed / total < 0.5 AND rate > 0.00002""",
)
def telemetry_tenant_quality(spark, sf_dir):
    """Days on which less than half of a tenant's gradings passed, while it asked more than once."""
    rows, keys = metrics(spark, sf_dir).withColumn("day", F.floor(F.col("sec") / 86400)), ["user_id", "day"]
    graded = telemetry.ratio(rows.where(F.col("strategy").isin("purchase", "error")), keys, F.col("strategy") == "purchase")
    low = graded.where(F.col("hits") / F.col("total") < 0.5).select(*keys, F.col("ratio").alias("pass_rate"))
    return telemetry.guarded(low, rows.where(F.col("strategy").isin("view", "click")), keys, 0.00002, 86400)


@query(
    "telemetry_tenant_latency",
    f"""
WITH {_M}, {_H.replace("strategy", "user_id")}, {_Q.format(q=0.95).replace("strategy", "user_id")},
p AS (SELECT user_id, {_V} AS quantile FROM r WHERE n >= want AND below < want GROUP BY user_id),
t AS (SELECT user_id, count(*) / 2592000 AS rate FROM m WHERE strategy IN ('view', 'click') GROUP BY 1)
SELECT p.user_id, quantile, round(rate, 9) AS traffic FROM p JOIN t ON t.user_id = p.user_id WHERE quantile > 10 AND rate > 0.00001""",
)
def telemetry_tenant_latency(spark, sf_dir):
    """Tenants whose 95th percentile is above ten seconds, with traffic enough over the thirty days."""
    rows = metrics(spark, sf_dir)
    slow = telemetry.quantile(telemetry.histogram(rows, ["user_id"], "latency"), ["user_id"], 0.95).where("quantile > 10")
    return telemetry.guarded(slow, rows.where(F.col("strategy").isin("view", "click")), ["user_id"], 0.00001, 2592000)

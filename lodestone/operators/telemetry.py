"""Histogram, rate, ratio and persistence queries over metric events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOUNDS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0)


def histogram(events: DataFrame, keys: list[str], value: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Cumulative buckets: rows (keys, le, n) with n the values up to le; the last le is infinite."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = events.groupBy(*keys).agg(*counts, F.count(value).alias("all"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.le", "c.n")


def quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """(keys, quantile) by linear interpolation in the bucket; the last finite bound above all of them."""
    by = Window.partitionBy(*keys).orderBy("le")
    inf = F.lit(float("inf"))
    finite = F.max(F.when(F.col("le") < inf, F.col("le"))).over(Window.partitionBy(*keys))
    total = F.max("n").over(Window.partitionBy(*keys))
    below, at = F.coalesce(F.lag("n").over(by), F.lit(0)), F.coalesce(F.lag("le").over(by), F.lit(0.0))
    rows = buckets.select(*keys, "le", "n", below.alias("below"), at.alias("low"), (total * F.lit(q)).alias("want"), finite.alias("finite"))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("want") - F.col("below")) / (F.col("n") - F.col("below"))
    value = F.when(F.col("le") == inf, F.col("finite")).otherwise(inside)
    hit = rows.where((F.col("n") >= F.col("want")) & (F.col("below") < F.col("want")))
    return hit.groupBy(*keys).agg(F.round(F.min_by(value, "le"), 6).alias("quantile"))


def ratio(events: DataFrame, keys: list[str], part: Column, floor: int = 0) -> DataFrame:
    """(keys, total, hits, ratio) where there are more than ``floor`` events."""
    out = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(part).alias("hits")).where(F.col("total") > floor)
    return out.withColumn("ratio", F.round(F.col("hits") / F.col("total"), 6))


def guarded(alerts: DataFrame, traffic: DataFrame, keys: list[str], least: float, seconds: int) -> DataFrame:
    """``alerts`` (keys, ...) with traffic, of those keys alone whose requests (rows of ``traffic``, with the keys) exceed ``least`` a second over ``seconds``."""
    rates = traffic.groupBy(*keys).agg((F.count(F.lit(1)) / F.lit(seconds)).alias("rate")).where(F.col("rate") > least)
    return alerts.join(rates.select(*keys, F.round("rate", 9).alias("traffic")), keys)


def improvement(before: DataFrame, after: DataFrame, key: str, score: str) -> DataFrame:
    """(key, pre, post, ratio): best score of ``after`` over that of ``before``, where both have rows of a key and the best before is above 0."""
    best = lambda df, name: df.groupBy(key).agg(F.max(score).alias(name))
    return best(before, "pre").where("pre > 0").join(best(after, "post"), key).withColumn("ratio", F.col("post") / F.col("pre"))


def firing(ticks: DataFrame, keys: list[str], tick: str, condition: Column, step: int, hold: int) -> DataFrame:
    """(keys, first_tick, n_ticks): runs of ``hold`` or more ticks, ``step`` apart, that meet the condition."""
    on = ticks.where(condition)
    order = Window.partitionBy(*keys).orderBy(tick)
    island = F.col(tick) / F.lit(step) - F.row_number().over(order)
    runs = on.withColumn("island", island).groupBy(*keys, "island").agg(F.min(tick).alias("first_tick"), F.count(F.lit(1)).alias("n_ticks"))
    return runs.where(F.col("n_ticks") >= hold).drop("island")


def fixed_window_limit(events: DataFrame, key: str, seconds: Column, tie: str, window: int, most: int) -> DataFrame:
    """``events`` with allowed: whether an event is among the first ``most`` of its key in its fixed window."""
    slot = F.floor(seconds / F.lit(window))
    order = Window.partitionBy(key, "slot").orderBy("seconds", tie)
    return events.withColumn("seconds", seconds).withColumn("slot", slot).withColumn("allowed", F.row_number().over(order) <= most)


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, start, last, n): activity with pauses of less than ``gap``."""
    grouped = events.groupBy(key, F.session_window(F.col(ts), gap)).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))
    return grouped.drop("session_window")

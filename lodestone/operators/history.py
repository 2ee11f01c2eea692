"""Folds over event histories: trajectories, job states and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trajectories(events: DataFrame, keys: list[str], ts: str, content: str) -> DataFrame:
    """(keys, n_events, last_event_at, duration_ms, has_error) by keys."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max(ts).alias("last_event_at"),
        F.floor((F.max(micros) - F.min(micros)) / 1000).alias("duration_ms"),
        F.bool_or(F.contains(F.lower(content), F.lit("error"))).alias("has_error"),
    )


def job_states(events: DataFrame, job: str, ts: str, seq: str) -> DataFrame:
    """(job, status, started_at, completed_at): the newest status, first start and last end."""
    return events.groupBy(job).agg(
        F.max_by("status", F.struct(ts, seq)).alias("status"),
        F.min(F.when(F.col("status") == "running", F.col(ts))).alias("started_at"),
        F.max(F.when(F.col("status").isin("completed", "failed"), F.col(ts))).alias("completed_at"),
    )


def feedback_stats(feedback: DataFrame, key: str, score: str, ts: str, correction: Column) -> DataFrame:
    """Counts by sign, mean score, corrections and last time, by key."""
    s = F.col(score)
    return feedback.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s > 0).alias("positive"),
        F.count_if(s < 0).alias("negative"),
        F.count_if(s == 0).alias("neutral"),
        F.round(F.avg(s), 6).alias("mean"),
        F.count_if(correction).alias("corrections"),
        F.max(ts).alias("last_at"),
    )


def boost(feedback: DataFrame, key: str, score: str, decay: str, enough: int = 10) -> DataFrame:
    """(key, n, boost, confidence): 1 + half the faded mean, within 0.5 and 1.5; 1 below ``enough`` scores."""
    n, mean = F.col("n"), F.col("mean")
    grouped = feedback.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col(score) * F.col(decay)) / F.sum(decay)).alias("mean"))
    return grouped.select(
        key,
        "n",
        F.round(F.when(n < enough, F.lit(1.0)).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(1.5), 1 + F.lit(0.5) * mean))), 6).alias("boost"),
        F.round(F.when(n < enough, n / F.lit(float(enough))).otherwise(F.least(F.lit(1.0), n / F.lit(2.0 * enough))), 6).alias("confidence"),
    )


def similar_boost(similar: DataFrame, feedback: DataFrame, key: str, score: str, decay: str, enough: int = 10) -> DataFrame:
    """(query_id, based_on_queries, n, boost, confidence, decay_applied) of each query from the feedback of past ones like it.

    ``similar`` has rows (query_id, id), a few of each query; ``feedback`` is of the past
    queries (``key``) and added up by them first, so one with much of it is one row. The
    boost is 1 and half the faded mean, within 0.5 and 1.5, and 1 below ``enough`` scores.
    """
    sums = feedback.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col(score) * F.col(decay)).alias("s"), F.sum(decay).alias("w"))
    joined = similar.join(sums, "id", "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("based_on_queries"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")
    )
    n = F.col("n")
    mean = F.when(F.col("w") > 0, F.try_divide("s", "w")).otherwise(0.0)
    boosted = F.greatest(F.lit(0.5), F.least(F.lit(1.5), 1 + F.lit(0.5) * mean))
    return joined.select(
        "query_id",
        "based_on_queries",
        "n",
        F.round(F.when(n < enough, 1.0).otherwise(boosted), 6).alias("boost"),
        F.round(F.when(n < enough, n / F.lit(float(enough))).otherwise(F.least(F.lit(1.0), n / F.lit(2.0 * enough))), 6).alias("confidence"),
        (F.col("w") < n - 1e-9).alias("decay_applied"),
    )

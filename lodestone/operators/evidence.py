"""Reranking, confidence, merging and fallback rules over retrieved evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def graph_rerank(hits: DataFrame, query: str, key: str, score: str, mentions: Column, distance: Column, weights: tuple[float, float, float] = (0.4, 0.3, 0.3), max_distance: int = 3) -> DataFrame:
    """``hits`` with graph_score, combined and new_rank: mentions by ten, and closeness; weights are brought to a sum of one."""
    total = sum(weights)
    own, episode, near = (w / total for w in weights)
    by_mentions = F.least(F.lit(1.0), F.coalesce(mentions, F.lit(0)) / F.lit(10.0))
    by_distance = F.when(distance.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - distance / F.lit(float(max_distance))))
    graph = (by_mentions * episode + by_distance * near) / (episode + near) if episode + near else F.lit(0.5)
    scored = hits.withColumn("graph_score", F.round(graph, 6)).withColumn("combined", F.round(F.col(score) * own + by_mentions * episode + by_distance * near, 6))
    return scored.withColumn("new_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("combined"), key)))


def dual_level_confidence(levels: DataFrame, query: str, level: str, score: str, low_weight: float = 0.6) -> DataFrame:
    """(query, confidence): weighted mean of the levels' mean scores, a tenth more where both have hits, at most 1."""
    is_low = F.col(level) == "low"
    grouped = levels.groupBy(query).agg(F.avg(F.when(is_low, F.col(score))).alias("low"), F.avg(F.when(~is_low, F.col(score))).alias("high"))
    both = F.col("low").isNotNull() & F.col("high").isNotNull()
    mixed = F.coalesce("low", F.lit(0.0)) * low_weight + F.coalesce("high", F.lit(0.0)) * (1 - low_weight)
    return grouped.select(query, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(both, mixed * F.lit(1.1)).otherwise(mixed))), 6).alias("confidence"))


def merge_entities(rows: DataFrame, key: str, order: str, value: str, chunk: str) -> DataFrame:
    """(key, value, chunks, created): the newest value that isn't null, the set of chunks, the first write."""
    return rows.groupBy(key).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value),
        F.array_join(F.array_sort(F.collect_set(F.col(chunk).cast("string"))), ",").alias("chunks"),
        F.min(order).alias("created"),
    )


def first_success(attempts: DataFrame, key: str, priority: str, ok: Column) -> DataFrame:
    """The attempt of best priority that succeeded, for each key."""
    return attempts.where(ok).withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(priority))).where("r = 1").drop("r")


# Status codes and phrases of pages that turn a crawler away.
BLOCKED_STATUS = (403, 429, 503)
BLOCKED_PHRASES = ("captcha", "challenge", "verify you are human", "access denied", "blocked", "rate limit", "too many requests")


def blocked(status: Column, content: Column) -> Column:
    """Whether a response turns the crawler away."""
    said = F.lower(content)
    phrases = [F.contains(said, F.lit(p)) for p in BLOCKED_PHRASES]
    out = F.coalesce(status.isin(*BLOCKED_STATUS), F.lit(False))
    for p in phrases:
        out = out | F.coalesce(p, F.lit(False))
    return out


# Parts of property names whose values are secret.
SENSITIVE = ("password", "secret", "token", "key", "auth", "credential", "api_key")


def redacted(props: Column) -> Column:
    """A map of properties with the values of sensitive names replaced, and a message by the hash of its first hundred characters and its length."""

    def kept(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        pair = lambda k, v: F.struct(k.alias("key"), v.cast("string").alias("value"))
        digest = F.when(value == "", "").otherwise(F.sha2(F.substring(value, 1, 100), 256))
        message = F.array(pair(F.lit("message_hash"), digest), pair(F.lit("message_length"), F.length(value)))
        return F.when(F.lower(key).rlike("|".join(SENSITIVE)), F.array(pair(key, F.lit("[REDACTED]")))).when((key == "message") & value.isNotNull(), message).otherwise(F.array(pair(key, value)))

    return F.map_from_entries(F.flatten(F.transform(F.map_entries(props), kept)))


def baseline_delta(metrics: DataFrame, baseline: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Metrics less those of a baseline; a metric that it lacks counts as 0, a key that it lacks is left out."""
    old = baseline.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    return metrics.join(old, key).select(key, *(F.round(F.col(c) - F.coalesce(f"__{c}", F.lit(0.0)), 6).alias(f"{c}_delta") for c in columns))

"""Usage costs in decimals, and their roll-ups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(12,6)"


def token_cost(tokens: Column, price_per_1k: Column) -> Column:
    """tokens / 1000 at a price, in decimals, to six places."""
    return (tokens.cast("decimal(12,0)") * price_per_1k.cast("decimal(10,6)") / F.lit(1000).cast("decimal(4,0)")).cast(MONEY)


def fallback_tokens(text: Column) -> Column:
    """Tokens of a text for models without a tokenizer here: 1.3 for each word, rounded up."""
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    words = F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " ")))
    return F.ceil(words * F.lit(1.3)).cast("long")


def priced(events: DataFrame, model_col: str, prices: Mapping[str, tuple[str, str]], default: tuple[str, str]) -> DataFrame:
    """``events`` with input_cost, output_cost and total_cost from prompt_tokens and completion_tokens."""

    def price(i: int) -> Column:
        out = F.lit(default[i]).cast("decimal(10,6)")
        for model, pair in prices.items():
            out = F.when(F.col(model_col) == model, F.lit(pair[i]).cast("decimal(10,6)")).otherwise(out)
        return out

    with_cost = events.withColumn("input_cost", token_cost(F.col("prompt_tokens"), price(0))).withColumn("output_cost", token_cost(F.col("completion_tokens"), price(1)))
    return with_cost.withColumn("total_cost", (F.col("input_cost") + F.col("output_cost")).cast(MONEY))


def money(x: Column) -> Column:
    """Sum with 0 for no rows."""
    return F.coalesce(F.sum(x), F.lit(0)).cast("decimal(18,6)")


def totals(events: DataFrame, *keys: str) -> DataFrame:
    """Requests, tokens and cost by keys; savings and premium against ``baseline_cost``."""
    delta = F.col("baseline_cost") - F.col("total_cost")
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        money(F.col("total_cost")).alias("cost"),
        money(F.when(delta > 0, delta)).alias("savings"),
        money(F.when(delta < 0, -delta)).alias("premium"),
    )


def alerts(events: DataFrame, config: DataFrame, as_of: Column, key: str, ts: str) -> DataFrame:
    """Spending of the trailing day and 30 days against thresholds; keys without a config aren't enabled."""
    recent = events.where((F.col(ts) > as_of - F.expr("INTERVAL 30 DAYS")) & (F.col(ts) <= as_of))
    spent = recent.groupBy(key).agg(money(F.when(F.col(ts) > as_of - F.expr("INTERVAL 1 DAY"), F.col("total_cost"))).alias("day_cost"), money(F.col("total_cost")).alias("month_cost"))
    joined = spent.join(config, key, "left")
    on = F.coalesce("enabled", F.lit(False))
    return joined.select(
        key,
        on.alias("enabled"),
        "day_cost",
        "month_cost",
        (on & F.coalesce(F.col("day_cost") >= F.col("day_limit"), F.lit(False))).alias("day_alert"),
        (on & F.coalesce(F.col("month_cost") >= F.col("month_limit"), F.lit(False))).alias("month_alert"),
    )

"""Score normalisation and decay, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

TINY = 1e-10


def min_max(score: Column, over: WindowSpec) -> Column:
    """(s - min) / (max - min); 0.5 where all are equal."""
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(high - low < TINY, 0.5).otherwise((score - low) / (high - low))


def z_sigmoid(score: Column, over: WindowSpec) -> Column:
    """Sigmoid of the z-score by the population's deviation; 0.5 where there is none."""
    spread = F.stddev_pop(score).over(over)
    return F.when(spread < TINY, 0.5).otherwise(1 / (1 + F.exp(-(score - F.avg(score).over(over)) / spread)))


def softmax(score: Column, over: WindowSpec, temperature: float = 1.0) -> Column:
    """exp((s - max) / T) over its sum."""
    raised = F.exp((score - F.max(score).over(over)) / temperature)
    return raised / F.sum(raised).over(over)


def percentile(score: Column, *keys: str) -> Column:
    """Mean 0-based position among n - 1 others, equals sharing theirs; 0.5 for a score alone."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, score))
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(score))
    return F.when(n == 1, 0.5).otherwise((rank - 1 + (ties - 1) / 2) / (n - 1))


STRATEGIES: dict[str, Callable[[Column, WindowSpec], Column]] = {"min_max": min_max, "z_score": z_sigmoid, "softmax": softmax}


def normalised(strategy: str, score: Column, over: WindowSpec) -> Column:
    """By the name of the strategy; min-max for names that aren't known."""
    return STRATEGIES.get(strategy, min_max)(score, over)


def importance_decay(importance: Column, days: Column, access_count: Column, half_life: float) -> Column:
    """importance * 2^(-days / half life) * min(1, 0.5 + 0.1 * accesses), within 0..1."""
    faded = importance * F.pow(F.lit(2.0), -days / half_life) * F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.1) * access_count)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), faded))


def feedback_decay(age_days: Column, grace: int) -> Column:
    """1 up to ``grace`` whole days, then exp(-(age - grace) / grace)."""
    return F.when(age_days <= grace, F.lit(1.0)).otherwise(F.exp(-(age_days - grace) / F.lit(float(grace))))

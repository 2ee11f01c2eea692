"""Chunks as rows: windows of words, without working the words out again for each window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text


def windows(df: DataFrame, keys: list[str], content: Column, size: int, overlap: int) -> DataFrame:
    """Rows (keys, chunk_index, content, tokens): windows of ``size`` words, each ``size - overlap`` after the one before, until one reaches the end.

    Words are split once, below the rows that are made of them; a window then takes
    its slice. A text without words has no window; null is taken as empty.
    """
    step = size - overlap
    split = df.select(*keys, text.words(F.coalesce(content, F.lit(""))).alias("all_words")).where(F.size("all_words") > 0)
    n = F.size("all_words")
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    # a row takes its own words only: the words of the whole text aren't repeated beside each window
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("all_words", i * step + 1, size), " ").alias("said"), F.least(F.lit(size), n - i * step).alias("n")))
    rows = split.select(*keys, F.explode(cut).alias("window"))
    return rows.select(*keys, F.col("window.i").alias("chunk_index"), F.col("window.said").alias("content"), F.col("window.n").alias("tokens"))

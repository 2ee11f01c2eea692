"""Exact vector search: a stated set of queries against all rows, in blocks.

Blocks of vectors are packed into one row each and meet pairwise, so a task holds
two blocks at most and answers with its best ``k`` of each query; a window keeps
the best overall. Nothing is broadcast and no pair of rows is ever a row of Spark's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
#: Queries of a block that a task compares at once.
ASKED = 256


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays in double precision; 0 where a norm is 0, null where the lengths differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))

    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    squares = [total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))) for x in (a, b)]
    norms = F.sqrt(squares[0]) * F.sqrt(squares[1])
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.when(norms == 0, F.lit(0.0)).otherwise(dot / norms))


def _packed(df: DataFrame, side: str, block: int) -> DataFrame:
    """One row per block and group: (grp, block, ids, matrix of unit vectors)."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack(part["vector"].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(rows, axis=1, keepdims=True)
        unit = np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)
        return pd.DataFrame([{"grp": part["grp"].iloc[0], f"{side}_block": int(part["block"].iloc[0]), f"{side}_ids": part["id"].to_numpy(np.int64).tobytes(), f"{side}_unit": unit.tobytes()}])

    # a group of any size is dealt into blocks by a hash of the id; their number comes from one count per group
    sizes = df.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = df.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return dealt.groupBy("grp", "block").applyInPandas(pack, f"grp long, {side}_block int, {side}_ids binary, {side}_unit binary")


def topk(corpus: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, threshold: float, group_col: str | None = None, digits: int = 6) -> DataFrame:
    """Rows (query_id, id, similarity, rank): the ``k`` nearest of each query, itself left out.

    Similarity is the cosine rounded to ``digits``; at least ``threshold``. Equals are
    ranked by id. With ``group_col`` a query only meets rows of its group. Null vectors
    take no part; all others must be of one length.
    """

    def chosen(df: DataFrame) -> DataFrame:
        group = F.col(group_col).cast("long") if group_col else F.lit(0).cast("long")
        return df.where(F.col(vector_col).isNotNull()).select(F.coalesce(group, F.lit(-1)).alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))

    def best(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in part.itertuples():
            q, c = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.c_ids, np.int64)
            asked, held = np.frombuffer(row.q_unit).reshape(len(q), -1), np.frombuffer(row.c_unit).reshape(len(c), -1)
            for at in range(0, len(q), ASKED):
                sims = np.round(asked[at : at + ASKED] @ held.T, digits)
                sims[~(sims >= threshold) | (c[None, :] == q[at : at + ASKED, None])] = -np.inf
                # what reaches the k-th greatest, its equals included, is all that can be among the best
                kth = np.partition(sims, len(c) - k, axis=1)[:, len(c) - k] if k < len(c) else np.full(len(sims), -np.inf)
                i, j = np.nonzero((sims >= kth[:, None]) & (sims > -np.inf))
                order = np.lexsort((c[j], -sims[i, j], i))
                i, j = i[order], j[order]
                first = np.searchsorted(i, i)
                kept = np.arange(len(i)) - first < k
                i, j = i[kept], j[kept]
                out.append(pd.DataFrame({"query_id": q[at + i], "id": c[j], "similarity": sims[i, j]}))
        return pd.concat(out)

    # every block of queries goes to every block of its group's rows under a key of its own, so no key is hot
    rows = chosen(corpus)
    blocks = rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = _packed(chosen(queries), "q", BLOCK).join(blocks, "grp").select("grp", "q_block", "q_ids", "q_unit", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c_block"))
    pairs = asked.join(_packed(rows, "c", BLOCK), ["grp", "c_block"])
    found = pairs.groupBy("grp", "q_block", "c_block").applyInPandas(best, "query_id long, id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def grouped_parents(hits: DataFrame, parent: Column, k: int) -> DataFrame:
    """Small hits gathered into parents: (query_id, parent_id, n_children, score, rank).

    The score is the best child's plus 0.1 for each further child, 0.2 at most, and never above 1.
    It is rounded as SQL does it, the product by 1000 to the nearest whole number and back: rounding
    a score's decimal digits would send 0.5005, just below its half as a double, up instead.
    """
    grouped = hits.groupBy("query_id", parent.alias("parent_id")).agg(F.count(F.lit(1)).alias("n_children"), F.max("similarity").alias("best"))
    raw = F.least(F.lit(1.0), F.col("best") + F.least(F.lit(0.1) * (F.col("n_children") - 1), F.lit(0.2)))
    score = F.round(raw * 1000) / 1000
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "parent_id")
    return grouped.select("query_id", "parent_id", "n_children", score.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

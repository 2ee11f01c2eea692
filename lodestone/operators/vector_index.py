"""A partitioned vector index on disk: lists by nearest centroid, pruned by what queries probe.

``folder/centroids`` has a row for each list; ``folder/blocks/list=n`` holds that list's
vectors, packed into blocks of bounded size. Queries read the folders of the lists they probe
only. New rows are appended to the lists of the centroids that stand. A list of any size is as
many blocks as it needs, and each meets each block of queries under a key of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.multi_vector import unit
from lodestone.operators.vector_search import _packed

BLOCK = 4096
#: Centroids are held by every task that assigns rows or queries, so lists are at most so many.
MOST_LISTS = 65_536


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    some = F.col(vector_col).isNotNull() & F.exists(vector_col, lambda x: x != 0)
    return vectors.where(some).select(F.col(id_col).cast("long").alias("id"), unit(F.col(vector_col)).alias("vector"))


def _nearest(rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """(id, vector, grp): each row with the numbers of its ``n`` nearest centroids, a row for each."""

    def near(batches):
        for part in batches:
            if len(part):
                found = np.argsort(-(np.stack(part["vector"].to_numpy()) @ centres.T), axis=1, kind="stable")[:, :n]
                yield part.assign(lists=found.astype(np.int64).tolist())

    placed = rows.mapInPandas(near, "id long, vector array<double>, lists array<long>")
    return placed.select("id", "vector", F.explode("lists").alias("grp"))


def centroids(spark: SparkSession, folder: str) -> np.ndarray:
    """The centroids of an index by list number, at most ``MOST_LISTS``."""
    found = spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()
    return np.array([r["centre"] for r in found])


def create(vectors: DataFrame, id_col: str, vector_col: str, folder: str, lists: int = 100, sample: int = 20_000, seed: int = 42) -> None:
    """Fit centroids on the ``sample`` rows of smallest id hash, and write an index of all rows below ``folder``.

    Null and zero vectors are left out; all others are of one length. No rows make an empty index.
    """
    if not 0 < lists <= MOST_LISTS:
        raise ValueError(f"an index has 1 to {MOST_LISTS} lists")
    rows = _rows(vectors, id_col, vector_col)
    fitted = rows.orderBy(F.xxhash64("id"), "id").limit(sample)
    few = fitted.select("vector").distinct().limit(lists + 1).collect()
    if len(few) <= lists:  # each different vector is a list
        centres = sorted(r["vector"] for r in few)
    else:
        centres = KMeans(k=lists, seed=seed, maxIter=10).fit(fitted.select(array_to_vector("vector").alias("features"))).clusterCenters()
    made = [(i, (np.array(c) / (np.linalg.norm(c) or 1.0)).tolist()) for i, c in enumerate(centres)]
    rows.sparkSession.createDataFrame(made, "list long, centre array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
    append(vectors, id_col, vector_col, folder)


def append(vectors: DataFrame, id_col: str, vector_col: str, folder: str) -> None:
    """Add rows to the lists of an index; their ids are new to it. The centroids stay as they are."""
    spark = vectors.sparkSession
    centres = centroids(spark, folder)
    placed = _nearest(_rows(vectors, id_col, vector_col), centres, 1) if len(centres) else spark.createDataFrame([], "id long, vector array<double>, grp long")
    packed = _packed(placed, "c", BLOCK).select(F.col("grp").alias("list"), F.expr("uuid()").alias("block"), "c_ids", "c_unit")
    packed.write.mode("append").partitionBy("list").parquet(f"{folder}/blocks")


def blocks(spark: SparkSession, folder: str, lists: list[int]) -> DataFrame:
    """The blocks of some lists; folders of others aren't read."""
    found = spark.read.schema("block string, c_ids binary, c_unit binary, list long").parquet(f"{folder}/blocks")
    return found.where(F.col("list").isin(lists))


def search(queries: DataFrame, id_col: str, vector_col: str, folder: str, probes: int, k: int, threshold: float = -1.0, digits: int = 6) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` nearest among rows of each query's ``probes`` nearest lists, itself left out.

    Exact if ``probes`` is the number of lists. Similarity is the cosine rounded to ``digits``,
    at least ``threshold``; equals are ranked by id. Null and zero queries find nothing.
    """
    spark = queries.sparkSession
    centres = centroids(spark, folder)
    none = spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
    if not len(centres):
        return none
    asked = _nearest(_rows(queries, id_col, vector_col), centres, probes)
    lists = sorted(r["grp"] for r in asked.select("grp").distinct().collect())  # at most as many as there are lists
    if not lists:
        return none

    def best(part: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.array([], np.int64), "id": np.array([], np.int64), "similarity": np.array([])})]
        for row in part.itertuples():
            q, c = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.c_ids, np.int64)
            sims = np.round(np.frombuffer(row.q_unit).reshape(len(q), -1) @ np.frombuffer(row.c_unit).reshape(len(c), -1).T, digits)
            for i in range(len(q)):
                near = np.flatnonzero((sims[i] >= threshold) & (c != q[i]))
                near = near[np.lexsort((c[near], -sims[i][near]))][:k]
                out.append(pd.DataFrame({"query_id": q[i], "id": c[near], "similarity": sims[i][near]}))
        return pd.concat(out)

    pairs = _packed(asked, "q", BLOCK).join(blocks(spark, folder, lists).withColumnRenamed("list", "grp"), "grp")
    found = pairs.groupBy("grp", "q_block", "block").applyInPandas(best, "query_id long, id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

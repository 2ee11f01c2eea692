"""Late interaction and partitioned search."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import vector_search


def slices(vector: Column, parts: int, width: int) -> Column:
    """A vector as ``parts`` token vectors of ``width`` components."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(vector, i * width + 1, width))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(vector: Column) -> Column:
    """A vector over its norm, to which a little is added so that zero vectors stay."""
    norm = F.sqrt(_dot(vector, vector)) + F.lit(1e-8)
    return F.transform(vector, lambda x: x.cast("double") / norm)


def max_sim(query: Column, doc: Column) -> Column:
    """Sum over a query's token vectors of the best product with a document's; both of unit vectors."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: _dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, v: s + v)


def partitioned(vectors: DataFrame, id_col: str, vector_col: str, lists: int, sample: int, seed: int = 42) -> tuple[DataFrame, list]:
    """((id, vector, list), centroids): every row in the list of its nearest centroid.

    Centroids are fitted on the ``sample`` rows of smallest id hash, a bounded number;
    rows are of one length, null vectors left out.
    """
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), unit(F.col(vector_col)).alias("vector"))
    fitted = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector("vector").alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(fitted)
    centroids = [list(map(float, c)) for c in model.clusterCenters()]
    placed = model.setPredictionCol("list").transform(rows.select("id", "vector", array_to_vector("vector").alias("features"))).drop("features")
    return placed, centroids


def probed(index: DataFrame, centroids: list, queries: DataFrame, probes: int, k: int) -> DataFrame:
    """(query_id, id, similarity, rank): the nearest among rows in each query's ``probes`` nearest lists, itself left out.

    Queries (id, vector) meet the lists they ask for as groups of a block search, so no pair of rows is a row.
    """
    centres = np.array(centroids)

    def asked(batches):
        for part in batches:
            found = np.stack(part["vector"].to_numpy()) @ centres.T
            near = np.argsort(-found, axis=1, kind="stable")[:, :probes]
            part = part.assign(lists=near.tolist())
            yield part

    wanted = queries.select("id", unit(F.col("vector")).alias("vector")).mapInPandas(asked, "id long, vector array<double>, lists array<int>")
    wanted = wanted.select("id", "vector", F.explode("lists").alias("list"))
    return vector_search.topk(index.select("id", "vector", "list"), wanted, "id", "vector", k, -2.0, "list")

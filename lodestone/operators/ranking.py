"""Term scores, rank fusion and retrieval evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import term_search
from lodestone.operators.graph import cut


def _terms(text_col: str) -> Column:
    return F.split(F.lower(text_col), "[^a-z0-9]+")


def term_counts(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """Rows (key, term, tf): lower-case runs of a-z and digits of three characters or more."""
    words = F.filter(_terms(text_col), lambda x: F.length(x) >= 3)
    return df.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def sparse_scores(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str) -> DataFrame:
    """Rows (query, doc, dot, overlap) of documents that share a term with the query."""
    joined = queries.withColumnRenamed("tf", "q_tf").join(docs, "term")
    return joined.groupBy(query_key, doc_key).agg(F.sum(F.col("q_tf") * F.col("tf")).alias("dot"), F.count(F.lit(1)).alias("overlap"))


def best_scores(items: DataFrame, docs: DataFrame, item_key: str, doc_key: str, text_col: str, k: int) -> DataFrame:
    """Rows (item, doc, dot, overlap) of :func:`sparse_scores`, those that can be among an item's best ``k`` by either score."""
    asked = cut(term_counts(items, item_key, text_col))
    single, repeated = term_search.by_id(docs.select(doc_key, text_col), doc_key)
    # shorter words of a document meet no term of an item
    best = term_search.best_scores(asked, single, item_key, doc_key, _terms(text_col), k)
    return best.unionByName(sparse_scores(asked, term_counts(repeated, doc_key, text_col), item_key, doc_key))


def reciprocal_rank_fusion(scores: DataFrame, query_key: str, doc_key: str, weights: dict[str, float], fetch: int, k: int = 60) -> DataFrame:
    """Rows (query, doc, score, rank): each list's best ``fetch`` give weight / (k + rank).

    All lists are ranked in one pass over the scores, which are dealt by query once.
    """
    places = {c: F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc(c), doc_key)) for c in weights}
    ranked = scores.select(query_key, doc_key, *(p.alias(f"place_{c}") for c, p in places.items()))
    ranked = ranked.where(F.least(*(F.col(f"place_{c}") for c in weights), F.lit(fetch + 1)) <= fetch)
    parts = [F.when(F.col(f"place_{c}") <= fetch, F.lit(w) / (F.lit(k) + F.col(f"place_{c}"))).otherwise(0.0) for c, w in weights.items()]
    fused = ranked.select(query_key, doc_key, F.round(reduce(lambda x, y: x + y, parts), 9).alias("score"))
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), doc_key)
    return fused.withColumn("rank", F.row_number().over(order))


def shared_passages(items: DataFrame, docs: DataFrame, item_key: str, doc_key: str, words: int) -> DataFrame:
    """Rows (item, doc, grade): how many different runs of ``words`` words an item shares with a document."""

    def grams(df: DataFrame, key: str) -> DataFrame:
        split = df.select(key, F.split("text", r"\s+").alias("w")).where(F.size("w") >= words)
        runs = F.transform(F.sequence(F.lit(1), F.size("w") - (words - 1)), lambda i: F.concat_ws(" ", F.slice("w", i, words)))
        return split.select(key, F.explode(runs).alias("gram")).distinct()

    single, repeated = term_search.by_id(docs.select(doc_key, "text"), doc_key)
    said = items.select(item_key, F.split("text", r"\s+").alias("w"))
    found = term_search.shared_runs(said, single, item_key, doc_key, F.split("text", r"\s+"), words)
    joined = grams(items, item_key).join(grams(repeated, doc_key), "gram").groupBy(item_key, doc_key).agg(F.count(F.lit(1)).alias("grade"))
    return found.unionByName(joined)


def evaluate(queries: DataFrame, ranked: DataFrame, qrels: DataFrame, query_key: str, doc_key: str, k: int) -> DataFrame:
    """Rows (query, rr, ndcg, precision_at_k, recall_at_k) for every query; 0 where nothing is relevant or found."""
    gain = F.col("grade") / F.log2(F.col("rank") + 1)
    hit = F.col("grade") > 0
    judged = ranked.where(F.col("rank") <= k).join(qrels, [query_key, doc_key], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    found = judged.groupBy(query_key).agg((1 / F.min(F.when(hit, F.col("rank")))).alias("rr"), F.sum(gain).alias("dcg"), F.count_if(hit).alias("hits"))
    best = qrels.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("grade"), doc_key)))
    ideal = best.groupBy(query_key).agg(F.sum(F.when(F.col("rank") <= k, gain)).alias("idcg"), F.count(F.lit(1)).alias("n_rel"))
    joined = queries.join(found, query_key, "left").join(ideal, query_key, "left")

    def share(a: str, b):
        return F.round(F.coalesce(F.try_divide(F.col(a), b), F.lit(0.0)), 6)

    return joined.select(
        query_key,
        F.round(F.coalesce("rr", F.lit(0.0)), 6).alias("rr"),
        share("dcg", F.col("idcg")).alias("ndcg"),
        share("hits", F.lit(float(k))).alias("precision_at_k"),
        share("hits", F.col("n_rel")).alias("recall_at_k"),
    )


def score_aggregates(df: DataFrame, key: str, score: str, position: str) -> DataFrame:
    """Mean, max, min, median and mean weighted by 1/position, by key."""
    return df.groupBy(key).agg(
        F.round(F.avg(score), 6).alias("mean"),
        F.max(score).alias("max"),
        F.min(score).alias("min"),
        F.round(F.percentile(score, 0.5), 6).alias("median"),
        F.round(F.sum(F.col(score) / F.col(position)) / F.sum(1 / F.col(position)), 6).alias("weighted_mean"),
    )

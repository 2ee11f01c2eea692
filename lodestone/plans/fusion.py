"""Score normalisation over ``events``, sparse and hybrid retrieval over ``documents``, and its evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import scoring
from lodestone.operators import ranking
from lodestone.operators.graph import cut
from lodestone.plans.registry import query
from lodestone.sources import table


@query(
    "norm_scores",
    """
WITH s AS (
  SELECT event_id, user_id, value, min(value) OVER w AS lo, max(value) OVER w AS hi, avg(value) OVER w AS mean,
    stddev_pop(value) OVER w AS sd, count(*) OVER w AS n, rank() OVER (PARTITION BY user_id ORDER BY value) AS rk,
    count(*) OVER (PARTITION BY user_id, value) AS ties
  FROM events WINDOW w AS (PARTITION BY user_id)),
e AS (SELECT *, exp((value - hi) / 10.0) AS x FROM s)
SELECT event_id,
  round(CASE WHEN hi - lo < 1e-10 THEN 0.5 ELSE (value - lo) / (hi - lo) END, 6) AS min_max,
  round(CASE WHEN sd < 1e-10 THEN 0.5 ELSE 1 / (1 + exp(-(value - mean) / sd)) END, 6) AS z_score,
  round(x / sum(x) OVER (PARTITION BY user_id), 6) AS softmax,
  round(CASE WHEN n = 1 THEN 0.5 ELSE (rk - 1 + (ties - 1) / 2.0) / (n - 1) END, 6) AS percentile
FROM e""",
)
def norm_scores(spark, sf_dir):
    """Four normalisations of event values within each user."""
    over, value = Window.partitionBy("user_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(scoring.min_max(value, over), 6).alias("min_max"),
        F.round(scoring.z_sigmoid(value, over), 6).alias("z_score"),
        F.round(scoring.softmax(value, over, 10.0), 6).alias("softmax"),
        F.round(scoring.percentile(value, "user_id"), 6).alias("percentile"),
    )


@query(
    "agg_scores",
    """
WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)
SELECT user_id, round(avg(value), 6) AS mean, max(value) AS max, min(value) AS min, round(quantile_cont(value, 0.5), 6) AS median,
  round(sum(value / pos) / sum(1.0 / pos), 6) AS weighted_mean
FROM p GROUP BY user_id""",
)
def agg_scores(spark, sf_dir):
    """Mean, extremes, median and mean weighted by 1/position of each user's values."""
    events = table(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return ranking.score_aggregates(events.withColumn("pos", pos), "user_id", "value", "pos")


_TERMS = """
docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3) AS words FROM documents),
items AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3) AS words FROM benchmark),
d AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM docs) GROUP BY 1, 2),
q AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(words) AS term FROM items) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, sum(q.tf * d.tf) AS dot, count(*) AS overlap FROM q JOIN d USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dot DESC, doc_id) AS sparse_rank,
  row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS dense_rank FROM s)"""

_FUSED = """
f AS (SELECT item_id, doc_id, sum(score) AS score FROM (
    SELECT item_id, doc_id, 0.7 / (60 + dense_rank) AS score FROM r WHERE dense_rank <= 20
    UNION ALL SELECT item_id, doc_id, 0.3 / (60 + sparse_rank) FROM r WHERE sparse_rank <= 20) GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f)"""

_QRELS = """
dw AS (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS w FROM documents),
iw AS (SELECT item_id, regexp_split_to_array(text, '\\s+') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM dw WHERE len(w) >= 8)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM iw WHERE len(w) >= 8)),
rel AS (SELECT item_id, doc_id, count(*) AS grade FROM ig JOIN dg USING (gram) GROUP BY 1, 2)"""


def _scored(spark, sf_dir, k):
    return ranking.best_scores(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", "text", k)


def _fused(scored):
    return ranking.reciprocal_rank_fusion(scored, "item_id", "doc_id", {"overlap": 0.7, "dot": 0.3}, fetch=20)


def _qrels(spark, sf_dir):
    return ranking.shared_passages(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", 8)


@query("sparse_topk", f"WITH {_TERMS} SELECT item_id, doc_id, CAST(dot AS BIGINT) AS dot, sparse_rank AS rank FROM r WHERE sparse_rank <= 10")
def sparse_topk(spark, sf_dir):
    """Best ten documents of each passage by the dot product of term counts."""
    order = Window.partitionBy("item_id").orderBy(F.desc("dot"), "doc_id")
    return _scored(spark, sf_dir, 10).select("item_id", "doc_id", "dot", F.row_number().over(order).alias("rank")).where("rank <= 10")


@query("hybrid_rrf", f"WITH {_TERMS}, {_FUSED} SELECT item_id, doc_id, round(score, 9) AS score, rank FROM fr WHERE rank <= 10")
def hybrid_rrf(spark, sf_dir):
    """Weighted reciprocal rank fusion of overlap and dot product."""
    return _fused(_scored(spark, sf_dir, 20)).where("rank <= 10")


@query("qrels_passages", f"WITH {_QRELS} SELECT item_id, doc_id, grade FROM rel")
def qrels_passages(spark, sf_dir):
    """Documents that hold eight words of a passage in a row."""
    return _qrels(spark, sf_dir)


@query(
    "eval_metrics",
    f"""
WITH {_TERMS}, {_FUSED}, {_QRELS},
j AS (SELECT fr.item_id, fr.doc_id, fr.rank, coalesce(grade, 0) AS grade FROM fr LEFT JOIN rel USING (item_id, doc_id) WHERE rank <= 10),
ideal AS (SELECT item_id, sum(grade / log2(i + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC, doc_id) AS i FROM rel) WHERE i <= 10 GROUP BY 1),
n AS (SELECT item_id, count(*) AS n_rel FROM rel GROUP BY 1),
m AS (SELECT item_id, coalesce(1.0 / min(CASE WHEN grade > 0 THEN rank END), 0) AS rr, sum(grade / log2(rank + 1)) AS dcg, count(*) FILTER (grade > 0) AS hits FROM j GROUP BY 1)
SELECT b.item_id, round(coalesce(rr, 0), 6) AS rr, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(hits, 0) / 10.0, 6) AS precision_at_k, round(coalesce(hits / n_rel, 0), 6) AS recall_at_k
FROM benchmark b LEFT JOIN m USING (item_id) LEFT JOIN ideal USING (item_id) LEFT JOIN n USING (item_id)""",
)
def eval_metrics(spark, sf_dir):
    """Reciprocal rank, nDCG, precision and recall at ten of the fused ranking, by passage."""
    return ranking.evaluate(table(spark, sf_dir, "benchmark").select("item_id"), _fused(_scored(spark, sf_dir, 20)), cut(_qrels(spark, sf_dir)), "item_id", "doc_id", 10)

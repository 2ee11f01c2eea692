"""Rules over evidence, bound to the tables at hand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import evidence, ranking
from lodestone.operators.graph import cut
from lodestone.plans import fusion, vector
from lodestone.plans.registry import query
from lodestone.plans.telemetry import metrics
from lodestone.sources import table

_HITS = vector._ranked(8, 0.1)


@query(
    "rerank_graph",
    f"""
WITH h AS ({_HITS}), m AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY 1),
x AS (SELECT h.*, least(1.0, coalesce(n, 0) / 10.0) AS bm, CASE WHEN id % 5 = 4 THEN 0.0 ELSE greatest(0.0, 1 - (id % 5) / 3.0) END AS bd FROM h LEFT JOIN m ON m.user_id = h.id % 150),
s AS (SELECT query_id, id, round((bm * 0.3 + bd * 0.3) / 0.6, 6) AS graph_score, round(similarity * 0.4 + bm * 0.3 + bd * 0.3, 6) AS combined FROM x)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, id) AS new_rank FROM s""",
)
def rerank_graph(spark, sf_dir):
    """Vector hits reranked by mentions and distance."""
    mentions = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("n"))
    hits = vector.vec_topk(spark, sf_dir).withColumn("user_id", F.col("id") % 150).join(mentions, "user_id", "left")
    distance = F.when(F.col("id") % 5 < 4, F.col("id") % 5)
    return evidence.graph_rerank(hits, "query_id", "id", "similarity", F.col("n"), distance).select("query_id", "id", "graph_score", "combined", "new_rank")


@query(
    "dual_level",
    f"""
WITH h AS ({_HITS}), g AS (SELECT query_id, avg(similarity) FILTER (id % 2 = 0) AS low, avg(similarity) FILTER (id % 2 = 1) AS high FROM h GROUP BY 1)
SELECT query_id, round(greatest(0.0, least(1.0, (coalesce(low, 0) * 0.6 + coalesce(high, 0) * 0.4) * CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN 1.1 ELSE 1 END)), 6) AS confidence FROM g""",
)
def dual_level(spark, sf_dir):
    """Confidence of low- and high-level hits together."""
    levels = vector.vec_topk(spark, sf_dir).withColumn("level", F.when(F.col("id") % 2 == 0, "low").otherwise("high"))
    return evidence.dual_level_confidence(levels, "query_id", "level", "similarity")


@query(
    "merge_entities",
    """
WITH r AS (SELECT user_id AS entity, event_id, CASE WHEN event_type <> 'view' THEN event_type END AS description, event_id % 7 AS chunk FROM events)
SELECT entity, arg_max(description, event_id) FILTER (description IS NOT NULL) AS description, string_agg(DISTINCT CAST(chunk AS VARCHAR), ',' ORDER BY CAST(chunk AS VARCHAR)) AS chunks, min(event_id) AS created FROM r GROUP BY 1""",
)
def merge_entities(spark, sf_dir):
    """Entities merged from their writes."""
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), "event_id", F.when(kind != "view", kind).alias("description"), (F.col("event_id") % 7).alias("chunk"))
    return evidence.merge_entities(rows, "entity", "event_id", "description", "chunk")


@query(
    "provider_chain",
    f"""
WITH a AS (SELECT page_id, p, CASE p WHEN 0 THEN CASE WHEN page_id % 3 = 0 THEN 403 ELSE 200 END WHEN 1 THEN CASE WHEN page_id % 6 = 0 THEN 500 ELSE 200 END ELSE 200 END AS status, html FROM pages, range(3) r(p)),
o AS (SELECT * FROM a WHERE status = 200 AND trim(html) <> '' AND NOT ({' OR '.join(f"contains(lower(html), '{p}')" for p in evidence.BLOCKED_PHRASES)}))
SELECT page_id, min(p) AS provider FROM o GROUP BY 1""",
)
def provider_chain(spark, sf_dir):
    """First provider that gives each page."""
    p, page = F.col("p"), F.col("page_id")
    status = F.when((p == 0) & (page % 3 == 0), 403).when((p == 1) & (page % 6 == 0), 500).otherwise(200)
    attempts = table(spark, sf_dir, "pages").select("page_id", "html", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("p")).withColumn("status", status)
    good = (F.col("status") == 200) & (F.trim("html") != "") & ~evidence.blocked(F.col("status"), F.col("html"))
    return evidence.first_success(attempts, "page_id", "p", good).select("page_id", F.col("p").cast("long").alias("provider"))


@query(
    "props_redacted",
    """
SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '","api_key":"[REDACTED]","message_hash":"' || sha256(substring(event_type || '-' || user_id, 1, 100)) || '","message_length":"' || length(event_type || '-' || user_id) || '"}' AS props FROM events""",
)
def props_redacted(spark, sf_dir):
    """Event properties with a secret and a message among them, redacted."""
    message = F.concat_ws("-", "event_type", "user_id")
    props = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("api_key"), F.col("event_id").cast("string"), F.lit("message"), message)
    return table(spark, sf_dir, "events").select("event_id", F.to_json(evidence.redacted(props)).alias("props"))


@query(
    "agent_health",
    "SELECT user_id, max(ts) AS last_seen, date_diff('second', max(ts), TIMESTAMP '2024-01-31') <= 86400 AS healthy, date_diff('second', max(ts), TIMESTAMP '2024-01-31') > 3 * 86400 AS expired FROM events GROUP BY 1",
)
def agent_health(spark, sf_dir):
    """Whether each agent's last heartbeat is recent, or three times too old."""
    age = F.floor(F.unix_micros(F.lit("2024-01-31").cast("timestamp")) / 1000000) - F.max("sec")
    return metrics(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("last_seen"), (age <= 86400).alias("healthy"), (age > 3 * 86400).alias("expired"))


@query("retry_schedule", "SELECT event_id, i AS attempt, CAST(2 * pow(2, i) AS BIGINT) AS delay FROM events, range(4) r(i) WHERE event_type = 'error'")
def retry_schedule(spark, sf_dir):
    """Delays of four retries of each failed event, doubling from two seconds."""
    failed = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("attempt"))
    return failed.withColumn("delay", (2 * F.pow(F.lit(2.0), F.col("attempt"))).cast("long"))


@query(
    "reference_report",
    """
SELECT source, count(*) AS total, count(*) FILTER (quality = 1) AS valid, count(*) FILTER (quality = 0 AND n_chars >= 1000) AS invalid, count(*) FILTER (quality = 0 AND n_chars < 1000) AS uncertain,
  round(count(*) FILTER (quality = 1) / count(*), 6) AS confidence FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
)
def reference_report(spark, sf_dir):
    """Valid, invalid and uncertain references by source."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    good, long_enough = F.col("quality") == 1, F.col("n_chars") >= 1000
    return joined.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(good).alias("valid"), F.count_if(~good & long_enough).alias("invalid"), F.count_if(~good & ~long_enough).alias("uncertain"),
        F.round(F.count_if(good) / F.count(F.lit(1)), 6).alias("confidence"),
    )


@query(
    "evidence_union",
    f"""
WITH h AS ({_HITS}) SELECT query_id, id, 'vector' AS kind FROM h WHERE rank <= 5
UNION ALL SELECT query_id, id, 'graph' FROM (SELECT q.vec_id AS query_id, e.event_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY e.value DESC, e.event_id) AS place FROM embeddings q JOIN events e ON e.user_id = q.vec_id WHERE q.vec_id % 20 = 0) WHERE place <= 5""",
)
def evidence_union(spark, sf_dir):
    """Vector hits and what is linked to the query in one list, five of either."""
    hits = vector.vec_topk(spark, sf_dir).where("rank <= 5")
    asks = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    links = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), "value").join(asks, "query_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), "id"))
    kinds = ((hits, "vector"), (links.withColumn("place", place).where("place <= 5"), "graph"))
    return reduce(DataFrame.unionByName, (h.select("query_id", "id", F.lit(k).alias("kind")) for h, k in kinds))


def _evaluated(ranking_: str, name: str) -> str:
    """Metrics at ten of a ranking (item_id, doc_id, rank) as common table expressions."""
    return f"""
j{name} AS (SELECT x.item_id, x.doc_id, x.rank, coalesce(grade, 0) AS grade FROM ({ranking_}) x LEFT JOIN rel ON rel.item_id = x.item_id AND rel.doc_id = x.doc_id WHERE x.rank <= 10),
m{name} AS (SELECT item_id, coalesce(1.0 / min(CASE WHEN grade > 0 THEN rank END), 0) AS rr, sum(grade / log2(rank + 1)) AS dcg, count(*) FILTER (grade > 0) AS hits FROM j{name} GROUP BY 1),
e{name} AS (SELECT b.item_id, round(coalesce(rr, 0), 6) AS rr, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(hits, 0) / 10.0, 6) AS precision_at_k, round(coalesce(hits / n_rel, 0), 6) AS recall_at_k
  FROM benchmark b LEFT JOIN m{name} m ON m.item_id = b.item_id LEFT JOIN ideal ON ideal.item_id = b.item_id LEFT JOIN n ON n.item_id = b.item_id)"""


@query(
    "eval_baseline",
    f"""
WITH {fusion._TERMS}, {fusion._FUSED}, {fusion._QRELS},
ideal AS (SELECT item_id, sum(grade / log2(i + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC, doc_id) AS i FROM rel) WHERE i <= 10 GROUP BY 1),
n AS (SELECT item_id, count(*) AS n_rel FROM rel GROUP BY 1), {_evaluated('SELECT item_id, doc_id, rank FROM fr', 'a')}, {_evaluated('SELECT item_id, doc_id, dense_rank AS rank FROM r', 'b')}
SELECT ea.item_id, {', '.join(f'round(ea.{c} - eb.{c}, 6) AS {c}_delta' for c in ('rr', 'ndcg', 'precision_at_k', 'recall_at_k'))} FROM ea JOIN eb ON eb.item_id = ea.item_id""",
)
def eval_baseline(spark, sf_dir):
    """Metrics of the fused ranking less those of the term-overlap ranking."""
    items = table(spark, sf_dir, "benchmark").select("item_id")
    scored, rel = cut(fusion._scored(spark, sf_dir, 20)), cut(fusion._qrels(spark, sf_dir))
    alone = ranking.reciprocal_rank_fusion(scored, "item_id", "doc_id", {"overlap": 1.0}, fetch=20)
    new, old = (ranking.evaluate(items, ranked, rel, "item_id", "doc_id", 10) for ranked in (fusion._fused(scored), alone))
    return evidence.baseline_delta(new, old, "item_id", ["rr", "ndcg", "precision_at_k", "recall_at_k"])

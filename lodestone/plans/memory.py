"""Scoped memories over ``conversations``: scope by turn, last access some days before a date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import scoring
from lodestone.operators import delivery, merging, ordered
from lodestone.plans.registry import query
from lodestone.plans.telemetry import metrics
from lodestone.plans.text import docs
from lodestone.sources import table

_M = """m AS (SELECT conv_id, turn, role, text, conv_id * 100 + turn AS id, ['session', 'user', 'agent', 'global'][1 + turn % 4] AS scope,
  round((1 + conv_id % 10) / 10.0, 1) AS importance, turn AS access_count, conv_id % 60 AS days FROM conversations)"""


def memories(spark, sf_dir):
    scopes = F.array(*map(F.lit, ("session", "user", "agent", "global")))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text", (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.get(scopes, (F.col("turn") % 4).cast("int")).alias("scope"),
        F.round((1 + F.col("conv_id") % 10) / 10.0, 1).alias("importance"), F.col("turn").alias("access_count"), (F.col("conv_id") % 60).alias("days"),
    )


_DECAY = "greatest(0.0, least(1.0, importance * pow(2.0, -days / 30.0) * least(1.0, 0.5 + 0.1 * access_count)))"


def _decayed(rows):
    return scoring.importance_decay(F.col("importance"), F.col("days"), F.col("access_count"), 30.0)


@query("memory_decay", f"WITH {_M} SELECT id, round({_DECAY}, 6) AS importance FROM m WHERE abs(importance - {_DECAY}) > 0.001")
def memory_decay(spark, sf_dir):
    """Faded importance of memories where it has changed."""
    rows = memories(spark, sf_dir)
    return rows.where(F.abs(F.col("importance") - _decayed(rows)) > 0.001).select("id", F.round(_decayed(rows), 6).alias("importance"))


@query("memory_prune", f"WITH {_M} SELECT id FROM m WHERE {_DECAY} < 0.1")
def memory_prune(spark, sf_dir):
    """Memories that fade below what is kept."""
    rows = memories(spark, sf_dir)
    return rows.where(_decayed(rows) < 0.1).select("id")


@query("memory_scopes", f"WITH {_M} SELECT id, scope, importance FROM m WHERE (scope = 'session' AND conv_id = 3) OR (scope = 'user' AND role = 'user') OR scope = 'global'")
def memory_scopes(spark, sf_dir):
    """What a context may see: its session, its user, and the global scope."""
    session, user, everyone = (F.col("scope") == s for s in ("session", "user", "global"))
    return memories(spark, sf_dir).where(reduce(lambda a, b: a | b, [session & (F.col("conv_id") == 3), user & (F.col("role") == "user"), everyone])).select("id", "scope", "importance")


@query("memory_search", f"WITH {_M} SELECT id, r FROM (SELECT id, scope, row_number() OVER (PARTITION BY scope ORDER BY importance DESC, id) AS r FROM m WHERE contains(lower(text), 'the')) WHERE r <= 10")
def memory_search(spark, sf_dir):
    """Ten most important memories of each scope that hold a word."""
    found = memories(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("the")))
    order = Window.partitionBy("scope").orderBy(F.desc("importance"), "id")
    return found.select("id", F.row_number().over(order).alias("r")).where("r <= 10")


@query("memory_quota", f"WITH {_M} SELECT scope, role, count(*) AS n, count(*) > 50 AS exceeded FROM m GROUP BY 1, 2")
def memory_quota(spark, sf_dir):
    """Memories by scope and role against a quota."""
    return memories(spark, sf_dir).groupBy("scope", "role").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 50).alias("exceeded"))


@query(
    "scope_parents",
    f"WITH {_M}, x(scope, seen) AS (VALUES ('session','session'),('session','user'),('session','global'),('user','user'),('user','global'),('agent','agent'),('agent','global'),('global','global')) SELECT id, seen FROM m JOIN x USING (scope)",
)
def scope_parents(spark, sf_dir):
    """Each memory with the scopes that include its own."""
    parents = {"session": ("session", "user", "global"), "user": ("user", "global"), "agent": ("agent", "global"), "global": ("global",)}
    lookup = F.create_map(*(x for k, v in parents.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return memories(spark, sf_dir).select("id", F.explode(F.element_at(lookup, F.col("scope"))).alias("seen"))


@query("memory_access", f"WITH {_M}, h AS (SELECT id FROM m WHERE importance >= 0.9) SELECT m.id, access_count + CASE WHEN h.id IS NULL THEN 0 ELSE 1 END AS access_count FROM m LEFT JOIN h USING (id)")
def memory_access(spark, sf_dir):
    """Access counts after one search returned some of the memories."""
    rows = memories(spark, sf_dir)
    hits = rows.where("importance >= 0.9").select(F.col("id").alias("hit"))
    return rows.join(hits, F.col("id") == F.col("hit"), "left").select("id", (F.col("access_count") + F.when(F.col("hit").isNull(), 0).otherwise(1)).alias("access_count"))


def _merged_sql(threshold: float) -> str:
    return f"""
WITH RECURSIVE m AS (SELECT CAST(label AS VARCHAR) AS grp, vec_id AS id, (vec_id % 10) / 10.0 AS importance, vec_id % 5 AS access_count, CAST(embedding AS DOUBLE[]) AS v,
    row_number() OVER (PARTITION BY label ORDER BY vec_id % 10 DESC, vec_id % 7 DESC, vec_id) AS r FROM embeddings),
s AS (SELECT b.grp, b.r, list(a.r) AS near FROM m a JOIN m b ON a.grp = b.grp AND a.r < b.r WHERE list_cosine_similarity(a.v, b.v) >= {threshold} GROUP BY 1, 2),
n AS (SELECT grp, r, coalesce(near, []) AS near FROM m LEFT JOIN s USING (grp, r)),
w AS (SELECT DISTINCT grp, 0::BIGINT AS r, []::BIGINT[] AS kept FROM m
  UNION ALL SELECT w.grp, n.r, CASE WHEN len(list_intersect(kept, near)) = 0 THEN list_append(kept, n.r) ELSE kept END FROM w JOIN n ON n.grp = w.grp AND n.r = w.r + 1),
l AS (SELECT grp, arg_max(kept, r) AS kept FROM w GROUP BY 1),
p AS (SELECT m.*, coalesce(list_min(list_intersect(near, kept)), m.r) AS first FROM m JOIN n USING (grp, r) JOIN l USING (grp))
SELECT p.grp, max(o.id) AS primary_id, CAST(max(p.importance) AS DOUBLE) AS importance, CAST(sum(p.access_count) AS BIGINT) AS access_count, count(*) AS merged
FROM p JOIN m o ON o.grp = p.grp AND o.r = p.first GROUP BY p.grp, p.first"""


def _label_memories(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "label", F.col("vec_id").alias("id"), ((F.col("vec_id") % 10) / 10.0).alias("importance"), (F.col("vec_id") % 7).alias("accessed_at"), (F.col("vec_id") % 5).alias("access_count"), "embedding"
    )


@query("memory_merge", _merged_sql(0.9))
def memory_merge(spark, sf_dir):
    """Greedy merging of near-equal vectors within each label."""
    return merging.merge_similar(_label_memories(spark, sf_dir), "label", 0.9)


@query("memory_merge_related", _merged_sql(0.3))
def memory_merge_related(spark, sf_dir):
    """The same for vectors that are merely related, of which there are many."""
    return merging.merge_similar(_label_memories(spark, sf_dir), "label", 0.3)


_EVENTS = """e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS i FROM
  (SELECT event_id, user_id, event_type = 'error' AS failed, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS sec FROM events))"""


@query(
    "rate_limit_sliding",
    f"""
WITH RECURSIVE {_EVENTS},
w AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, []::DOUBLE[] AS log, false AS allowed FROM e
  UNION ALL SELECT user_id, i, event_id, CASE WHEN len(live) < 3 THEN list_append(live, sec) ELSE live END, len(live) < 3 FROM
    (SELECT e.*, list_filter(w.log, lambda x: x > e.sec - 86400) AS live FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1))
SELECT user_id, event_id, allowed FROM w WHERE i > 0""",
)
def rate_limit_sliding(spark, sf_dir):
    """Three events in any trailing day are allowed to each user."""
    return ordered.sliding_limit(metrics(spark, sf_dir), "user_id", "sec", "event_id", 86400, 3)


@query(
    "circuit_breaker",
    f"""
WITH RECURSIVE {_EVENTS},
w AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0 AS bad, -1e300 AS until, false AS rejected FROM e
  UNION ALL SELECT user_id, i, event_id, CASE WHEN refused THEN bad WHEN next >= 2 THEN 0 ELSE next END, CASE WHEN NOT refused AND next >= 2 THEN sec + 21600 ELSE until END, refused FROM
    (SELECT e.*, w.bad, w.until, e.sec < w.until AS refused, CASE WHEN e.failed THEN w.bad + 1 ELSE 0 END AS next FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1))
SELECT user_id, event_id, rejected FROM w WHERE i > 0""",
)
def circuit_breaker(spark, sf_dir):
    """Calls refused for six hours after two errors in a row of a user."""
    events = metrics(spark, sf_dir).withColumn("failed", F.col("strategy") == "error")
    return ordered.circuit_breaker(events, "user_id", "sec", "event_id", "failed", 2, 21600.0)


@query(
    "task_deliveries",
    """
WITH RECURSIVE m AS (SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 'ack' ELSE event_type END AS kind, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS sec FROM events),
a AS (SELECT user_id, event_id, kind, sec FROM m WHERE sec <= 1706400000 UNION ALL SELECT DISTINCT user_id, 9223372036854775807, 'end', 1706400000 FROM m WHERE sec <= 1706400000),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS i FROM a),
w AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::DOUBLE AS opened, 0 AS attempt, NULL::DOUBLE AS due, []::STRUCT(t DOUBLE, status VARCHAR, attempt INT)[] AS found FROM e
  UNION ALL
  SELECT user_id, i, CASE WHEN kind = 'end' OR opened IS NOT NULL AND NOT (kind = 'ack' OR fails) THEN opened WHEN opened IS NULL THEN sec END,
    CASE WHEN opened IS NULL AND kind <> 'end' THEN 0 ELSE attempt END, CASE WHEN opened IS NULL OR kind = 'ack' THEN NULL WHEN waits THEN sec + 14400 * pow(2, attempt) ELSE due END,
    list_concat(found, CASE WHEN kind = 'end' THEN [] WHEN opened IS NULL THEN [{'t': sec, 'status': 'delivered', 'attempt': 0}] WHEN kind = 'ack' THEN [{'t': sec, 'status': 'completed', 'attempt': attempt}]
      WHEN fails THEN [{'t': sec, 'status': 'failed', 'attempt': attempt}] WHEN waits THEN [{'t': sec, 'status': 'waiting', 'attempt': attempt}] ELSE [] END)
  FROM (SELECT *, kind = 'error' AND due IS NULL AND opened IS NOT NULL AND attempt >= 2 AS fails, kind = 'error' AND due IS NULL AND opened IS NOT NULL AND attempt < 2 AS waits FROM
    (SELECT user_id, i, kind, sec, CASE WHEN ends THEN NULL ELSE opened END AS opened, attempt + again::INT AS attempt, CASE WHEN ends OR again THEN NULL ELSE due END AS due,
        list_concat(CASE WHEN again THEN [{'t': due, 'status': 'retry', 'attempt': attempt + 1}] ELSE [] END, CASE WHEN ends THEN [{'t': opened + 86400, 'status': 'expired', 'attempt': attempt + again::INT}] ELSE [] END) AS found
      FROM (SELECT e.user_id, e.i, e.kind, e.sec, w.opened, w.attempt, w.due, coalesce(w.opened + 86400 <= e.sec, false) AS ends, coalesce(w.due <= e.sec AND w.due < w.opened + 86400, false) AS again
        FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1))))
SELECT user_id, x.t AS at, x.status, x.attempt FROM (SELECT user_id, unnest(found) AS x FROM w)""",
)
def task_deliveries(spark, sf_dir):
    """What becomes of each user's task: two retries four and eight hours after an error, a day to live, up to a date."""
    events = metrics(spark, sf_dir).withColumn("kind", F.when(F.col("strategy") == "signup", "ack").otherwise(F.col("strategy")))
    return delivery.delivered(events, "user_id", "sec", "event_id", "kind", delivery.Rules(2, 14400.0, 86400.0), 1706400000.0)


@query(
    "cache_lru",
    """
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY cache ORDER BY sec, event_id) AS i FROM
  (SELECT event_id, user_id % 5 AS cache, CAST(user_id AS VARCHAR) AS key, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS sec FROM events)),
w AS (SELECT DISTINCT cache, 0::BIGINT AS i, NULL::BIGINT AS event_id, false AS hit, []::STRUCT(k VARCHAR, u DOUBLE)[] AS held FROM e
  UNION ALL SELECT cache, i, event_id, len(own) > 0, CASE WHEN len(own) > 0 THEN list_concat(list_filter(held, lambda x: x.k <> key), own)
      ELSE list_concat(list_filter(held, lambda x: x.k <> key AND x.u > sec), [{'k': key, 'u': sec + 86400}])[-10:] END FROM
    (SELECT e.*, w.held, list_filter(w.held, lambda x: x.k = e.key AND x.u > e.sec) AS own FROM w JOIN e ON e.cache = w.cache AND e.i = w.i + 1))
SELECT cache, event_id, hit FROM w WHERE i > 0""",
)
def cache_lru(spark, sf_dir):
    """Which requests five caches of ten entries, each living a day, would have answered."""
    requests = metrics(spark, sf_dir).withColumn("cache", F.col("user_id") % 5)
    return ordered.cache_replay(requests, "cache", "user_id", "sec", "event_id", 10, 86400.0)


@query("chunk_boundaries")
def chunk_boundaries(spark, sf_dir):
    """Chunks of every document that end with a paragraph or sentence."""
    return ordered.boundary_chunks(docs(spark, sf_dir), "doc_id", "text")


@query("chunk_parents")
def chunk_parents(spark, sf_dir):
    """Boundary chunks gathered into parents of 1,024 words."""
    chunks = ordered.boundary_chunks(docs(spark, sf_dir), "doc_id", "text", 256, 25)
    return ordered.greedy_parents(chunks.withColumn("tokens", F.size(F.split("content", r"\s+"))), "doc_id", 1024)

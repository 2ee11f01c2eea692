"""Decision rules of retrieval: routes, grades, confidence, plans, scopes and positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.plans.memory import _M, _decayed, memories
from lodestone.plans.registry import query
from lodestone.sources import table


@query(
    "routes_combined",
    """
WITH d AS (SELECT event_id, ['global', 'local', 'hybrid'][CAST(1 + event_id % 3 AS INT)] AS rule, ['global', 'hybrid'][CAST(1 + user_id % 2 AS INT)] AS model, (30 + event_id % 60) / 100.0 AS rule_conf, (40 + user_id % 50) / 100.0 AS model_conf FROM events)
SELECT event_id, CASE WHEN rule = model OR model_conf <= rule_conf THEN rule ELSE model END AS route,
  round(CAST(CASE WHEN rule = model THEN least(0.95, (rule_conf + model_conf) / 2 + 0.1) ELSE greatest(rule_conf, model_conf) * 0.9 END AS DOUBLE), 6) AS confidence FROM d""",
)
def routes_combined(spark, sf_dir):
    """A rule's and a model's route as one: agreement raises confidence, else the surer one is taken a little less surely."""
    e, u = F.col("event_id"), F.col("user_id")
    rule = F.get(F.array(*map(F.lit, ("global", "local", "hybrid"))), (e % 3).cast("int"))
    model = F.get(F.array(*map(F.lit, ("global", "hybrid"))), (u % 2).cast("int"))
    rule_conf, model_conf = (30 + e % 60) / 100.0, (40 + u % 50) / 100.0
    route = F.when((rule == model) | (model_conf <= rule_conf), rule).otherwise(model)
    confidence = F.when(rule == model, F.least(F.lit(0.95), (rule_conf + model_conf) / 2 + 0.1)).otherwise(F.greatest(rule_conf, model_conf) * 0.9)
    return table(spark, sf_dir, "events").select("event_id", route.alias("route"), F.round(confidence, 6).alias("confidence"))


_HITS = "h AS (SELECT user_id AS query_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events)"


def _ranked(spark, sf_dir, keep=()):
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), "event_id", "value", *keep, F.row_number().over(order).alias("r"))


@query(
    "grades",
    f"""
WITH {_HITS}, t AS (SELECT query_id, value FROM h WHERE r <= 10), n AS (SELECT query_id, min(value) AS lo, max(value) AS hi, count(*) AS n FROM t GROUP BY 1),
g AS (SELECT query_id, avg(CASE WHEN n = 1 OR hi - lo < 1e-10 THEN 0.5 ELSE (value - lo) / (hi - lo) END) AS score FROM t JOIN n USING (query_id) GROUP BY 1)
SELECT query_id, round(score, 6) AS score, round(score, 6) >= 0.5 AS passed, CASE WHEN round(score, 6) >= 0.5 THEN NULL ELSE 'web_search' END AS fallback FROM g""",
)
def grades(spark, sf_dir):
    """Mean normalised score of each query's ten best hits, whether it passes, and what is fallen back on if not."""
    top = _ranked(spark, sf_dir).where("r <= 10")
    ends = Window.partitionBy("query_id")
    lo, hi, n = (f.over(ends) for f in (F.min("value"), F.max("value"), F.count(F.lit(1))))
    scaled = F.when((n == 1) | (hi - lo < 1e-10), 0.5).otherwise((F.col("value") - lo) / (hi - lo))
    graded = top.select("query_id", scaled.alias("s")).groupBy("query_id").agg(F.round(F.avg("s"), 6).alias("score"))
    passed = F.col("score") >= 0.5
    return graded.select("query_id", "score", passed.alias("passed"), F.when(~passed, "web_search").alias("fallback"))


@query("rank_scores", f"WITH {_HITS} SELECT query_id, event_id, round(1 - (r - 1) / 20.0, 3)::DOUBLE AS score FROM h WHERE r <= 20")
def rank_scores(spark, sf_dir):
    """Scores by place among at most twenty hits."""
    return _ranked(spark, sf_dir).where("r <= 20").select("query_id", "event_id", F.round(1 - (F.col("r") - 1) / 20.0, 3).alias("score"))


@query(
    "reranked_order",
    f"""
WITH {_HITS}, t AS (SELECT query_id, event_id, r - 1 AS original_rank, (event_id * 37 % 101) / 100.0 AS score FROM h WHERE r <= 20)
SELECT query_id, event_id, original_rank, score::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_rank) AS rank FROM t) WHERE rank <= 5""",
)
def reranked_order(spark, sf_dir):
    """The five best of twenty hits by a second score, with the places they had."""
    hits = _ranked(spark, sf_dir).where("r <= 20").select("query_id", "event_id", (F.col("r") - 1).alias("original_rank"), ((F.col("event_id") * 37 % 101) / 100.0).alias("score"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "original_rank"))).where("rank <= 5")


@query(
    "hits_and_paths",
    f"""
WITH {_HITS}, p AS (SELECT user_id AS query_id, event_id, event_id % 4 AS edges FROM events)
SELECT query_id, 'hit' AS kind, event_id, r AS place FROM h WHERE r <= 3
UNION ALL SELECT query_id, 'path', event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY edges, event_id) AS place FROM p) WHERE place <= 3""",
)
def hits_and_paths(spark, sf_dir):
    """Hits by falling score and paths by their number of edges, three of each."""
    hits = _ranked(spark, sf_dir).where("r <= 3").select("query_id", F.lit("hit").alias("kind"), "event_id", F.col("r").alias("place"))
    order = Window.partitionBy("query_id").orderBy("edges", "event_id")
    paths = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.lit("path").alias("kind"), "event_id", (F.col("event_id") % 4).alias("edges"))
    return hits.union(paths.withColumn("place", F.row_number().over(order)).where("place <= 3").select("query_id", "kind", "event_id", "place"))


@query(
    "dual_weighted",
    """
WITH s AS (SELECT user_id AS query_id, event_id, CASE WHEN event_type = 'purchase' THEN 'high' ELSE 'low' END AS level, (event_id % 100) / 100.0 AS score FROM events WHERE event_id % 10 = 0),
n AS (SELECT query_id, count(*) FILTER (WHERE level = 'low') AS low, count(*) FILTER (WHERE level = 'high') AS high FROM s GROUP BY 1)
SELECT s.query_id, event_id, level, round(CASE WHEN level = 'low' THEN score * 0.6 ELSE score * 0.4 END, 3)::DOUBLE AS score, (low = 0) <> (high = 0) AS fallback_used FROM s JOIN n ON n.query_id = s.query_id""",
)
def dual_weighted(spark, sf_dir):
    """Scores of two levels by their weights, and whether one level alone has answered."""
    level = F.when(F.col("event_type") == "purchase", "high").otherwise("low")
    hits = table(spark, sf_dir, "events").where("event_id % 10 = 0").select(F.col("user_id").alias("query_id"), "event_id", level.alias("level"), (F.col("event_id") % 100).cast("decimal(10,2)").alias("s"))
    of = Window.partitionBy("query_id")
    low, high = (F.count_if(F.col("level") == k).over(of) for k in ("low", "high"))
    weight = F.when(F.col("level") == "low", F.lit("0.006").cast("decimal(4,3)")).otherwise(F.lit("0.004").cast("decimal(4,3)"))
    return hits.select("query_id", "event_id", "level", F.round(F.col("s") * weight, 3).cast("double").alias("score"), ((low == 0) != (high == 0)).alias("fallback_used"))


@query(
    "lazy_confidence",
    r"""
WITH q AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '\w{3,}'), lambda t: true) AS terms, turn + 1 AS entities, turn % 5 AS rels, 'the and of ' || role AS seen FROM conversations),
c AS (SELECT *, CASE WHEN len(terms) = 0 THEN 0.5 ELSE len(list_filter(terms, lambda t: contains(seen, t))) / CAST(len(terms) AS DOUBLE) END AS coverage,
  CASE WHEN entities > 1 THEN least(1.0, rels / CAST(greatest(1, entities * (entities - 1)) AS DOUBLE)) ELSE 0.0 END AS density FROM q)
SELECT conv_id, turn, round(least(1.0, entities / CAST(50 AS DOUBLE)) * 0.4 + coverage * 0.4 + density * 0.2 + 1e-9, 2) AS confidence FROM c""",
)
def lazy_confidence(spark, sf_dir):
    """Confidence of an answer from its entities, the query's terms they cover and how linked they are."""
    terms = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w{3,})".replace("(?U)", "")), 1)
    seen = F.concat(F.lit("the and of "), "role")
    n = F.col("turn") + 1
    found = F.size(F.filter(terms, lambda t: F.contains(seen, t)))
    coverage = F.when(F.size(terms) == 0, 0.5).otherwise(found / F.size(terms))
    density = F.when(n > 1, F.least(F.lit(1.0), (F.col("turn") % 5) / F.greatest(F.lit(1), n * (n - 1)))).otherwise(0.0)
    confidence = F.least(F.lit(1.0), n / F.lit(50.0)) * 0.4 + coverage * 0.4 + density * 0.2
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(confidence + 1e-9, 2).alias("confidence"))


# Phrases of an answer and the confidence that each stands for.
_PHRASES = [(("high confidence", "confident"), 0.8), (("medium confidence", "moderate"), 0.6), (("low confidence", "uncertain"), 0.4), (("insufficient", "not enough"), 0.3)]
_SAID = ("With high confidence", "A moderate view", "It is uncertain", "Not enough is known", "Nothing on that")


@query(
    "synthesis_confidence",
    f"""
WITH s AS (SELECT event_id, lower([{', '.join(f"'{x}'" for x in _SAID)}][CAST(1 + event_id % 5 AS INT)]) AS said, event_id % 7 AS low, user_id % 4 AS high FROM events),
b AS (SELECT *, CASE {' '.join(f"WHEN {' OR '.join(f'''contains(said, '{p}')''' for p in ps)} THEN {v}" for ps, v in _PHRASES)} ELSE 0.5 END::DOUBLE AS c FROM s)
SELECT event_id, round(least(1.0, c * CASE WHEN low > 0 AND high > 0 THEN CAST(1.15 AS DOUBLE) ELSE 1.0 END * CASE WHEN low >= 5 THEN CAST(1.05 AS DOUBLE) ELSE 1.0 END * CASE WHEN high >= 3 THEN CAST(1.05 AS DOUBLE) ELSE 1.0 END) + 1e-9, 2) AS confidence FROM b""",
)
def synthesis_confidence(spark, sf_dir):
    """Confidence that an answer states, raised where both levels and more results are behind it."""
    said = F.lower(F.get(F.array(*map(F.lit, _SAID)), (F.col("event_id") % 5).cast("int")))
    low, high = F.col("event_id") % 7, F.col("user_id") % 4
    base = F.coalesce(*(F.when(F.contains(said, F.lit(a)) | F.contains(said, F.lit(b)), v) for (a, b), v in _PHRASES), F.lit(0.5))
    raised = base * F.when((low > 0) & (high > 0), 1.15).otherwise(1.0) * F.when(low >= 5, 1.05).otherwise(1.0) * F.when(high >= 3, 1.05).otherwise(1.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.least(F.lit(1.0), raised) + 1e-9, 2).alias("confidence"))


# The steps of a plan.
_STEPS = ("Understand the question intent", "Select retrieval strategy", "Gather evidence", "Synthesize response")


@query(
    "plans_built",
    rf"""
WITH q AS (SELECT conv_id, turn, lower(text) || CASE WHEN turn % 4 = 0 THEN ' versus' ELSE '' END AS q FROM conversations WHERE role = 'user')
SELECT conv_id, turn, '{_STEPS[0]}' || CASE WHEN regexp_matches(q, '\b(compare|versus)\b') THEN ' > Break down into sub-questions' ELSE '' END || ' > {_STEPS[1]} > {_STEPS[2]}'
  || CASE WHEN regexp_matches(q, '\b(if|depending)\b') THEN ' > Refine plan based on intermediate signals' ELSE '' END || ' > {_STEPS[3]}' AS plan FROM q""",
)
def plans_built(spark, sf_dir):
    """Steps of answering each question; some words add a step."""
    asked = F.concat(F.lower("text"), F.when(F.col("turn") % 4 == 0, " versus").otherwise(""))
    split = F.when(asked.rlike(r"\b(compare|versus)\b"), "Break down into sub-questions")
    refine = F.when(asked.rlike(r"\b(if|depending)\b"), "Refine plan based on intermediate signals")
    steps = F.array_compact(F.array(F.lit(_STEPS[0]), split, F.lit(_STEPS[1]), F.lit(_STEPS[2]), refine, F.lit(_STEPS[3])))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(steps, " > ").alias("plan"))


@query(
    "scope_checked",
    f"""
WITH {_M}, c AS (SELECT id, scope, CASE WHEN conv_id % 3 > 0 THEN conv_id END AS session_id, nullif(role, 'system') AS user_id, CASE WHEN turn % 3 = 0 THEN role END AS agent_id FROM m)
SELECT id, CASE WHEN scope = 'user' AND user_id IS NULL THEN 'user_id is required for USER scope' WHEN scope = 'session' AND session_id IS NULL THEN 'session_id is required for SESSION scope'
  WHEN scope = 'agent' AND agent_id IS NULL THEN 'agent_id is required for AGENT scope' END AS error FROM c""",
)
def scope_checked(spark, sf_dir):
    """What a memory's scope misses, if anything."""
    given = {"user": F.nullif("role", F.lit("system")), "session": F.when(F.col("conv_id") % 3 > 0, F.col("conv_id").cast("string")), "agent": F.when(F.col("turn") % 3 == 0, F.col("role"))}
    errors = [F.when((F.col("scope") == k) & F.coalesce(v, F.lit("")).isin(""), f"{k}_id is required for {k.upper()} scope") for k, v in given.items()]
    return memories(spark, sf_dir).select("id", F.coalesce(*errors).alias("error"))


@query("scope_deleted", f"WITH {_M} SELECT id, scope FROM m WHERE NOT (scope = 'session' AND conv_id % 2 = 0)")
def scope_deleted(spark, sf_dir):
    """What is left after the memories of a scope were deleted for half of the sessions."""
    rows = memories(spark, sf_dir)
    gone = rows.where("scope = 'session' AND conv_id % 2 = 0").select("id")
    return rows.join(gone, "id", "left_anti").select("id", "scope")


@query("memories_filtered", f"WITH {_M} SELECT id FROM m WHERE scope = 'user' AND role = 'user' AND conv_id >= 10")
def memories_filtered(spark, sf_dir):
    """Memories that pass all filters that were given; those left open don't count."""
    filters = {"scope": "user", "role": "user", "text": None}
    rows = memories(spark, sf_dir).where("conv_id >= 10")
    for column, value in filters.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.select("id")


@query("memory_contexts", f"WITH {_M} SELECT scope, CASE WHEN scope = 'session' THEN role || '/' || conv_id WHEN scope = 'global' THEN '' ELSE role END AS context, count(*) AS n, max(importance) AS most FROM m GROUP BY 1, 2")
def memory_contexts(spark, sf_dir):
    """Memories by what they may be merged within: a session's are its user's."""
    context = F.when(F.col("scope") == "session", F.concat_ws("/", "role", "conv_id")).when(F.col("scope") == "global", "").otherwise(F.col("role"))
    return memories(spark, sf_dir).groupBy("scope", context.alias("context")).agg(F.count(F.lit(1)).alias("n"), F.max("importance").alias("most"))


_FADE = "greatest(0.0, least(1.0, importance * pow(2.0, -days / 30.0) * least(1.0, 0.5 + 0.1 * access_count)))"


@query(
    "memory_consolidated",
    f"""
WITH {_M}, d AS (SELECT id, scope, role, text, access_count, CASE WHEN abs(importance - {_FADE}) > 0.001 THEN {_FADE} ELSE importance END AS importance FROM m),
g AS (SELECT min(id) AS id, scope, role, text, max(importance) AS importance, sum(access_count) AS access_count, count(*) - 1 AS merged FROM d GROUP BY scope, role, text)
SELECT id, scope, round(importance, 6) AS importance, CAST(access_count AS BIGINT) AS access_count, merged FROM g WHERE round(importance, 6) >= 0.1""",
)
def memory_consolidated(spark, sf_dir):
    """Memories after fading, merging those of one text within their scope and owner, and dropping what is of no importance."""
    rows = memories(spark, sf_dir)
    faded = _decayed(rows)
    rows = rows.withColumn("importance", F.when(F.abs(F.col("importance") - faded) > 0.001, faded).otherwise(F.col("importance")))
    merged = rows.groupBy("scope", "role", "text").agg(F.min("id").alias("id"), F.round(F.max("importance"), 6).alias("importance"), F.sum("access_count").alias("access_count"), (F.count(F.lit(1)) - 1).alias("merged"))
    return merged.where("importance >= 0.1").select("id", "scope", "importance", "access_count", "merged")


@query("feedback_cleared", "SELECT event_id, user_id FROM events WHERE user_id % 10 <> 3")
def feedback_cleared(spark, sf_dir):
    """Feedback that is left after a tenant's was cleared."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    gone = rows.where("user_id % 10 = 3").select("event_id")
    return rows.join(gone, "event_id", "left_anti")


@query("stream_backlog", "SELECT event_type AS stream, count(*) AS length, count(*) FILTER (WHERE event_id % 7 = 0) AS pending, min(ts) FILTER (WHERE event_id % 7 = 0) AS oldest_pending FROM events GROUP BY 1")
def stream_backlog(spark, sf_dir):
    """Length and backlog of every stream: entries that nobody has acknowledged."""
    open_ = F.col("event_id") % 7 == 0
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stream")).agg(F.count(F.lit(1)).alias("length"), F.count_if(open_).alias("pending"), F.min(F.when(open_, F.col("ts"))).alias("oldest_pending"))


@query(
    "cache_replayed",
    """
WITH e AS (SELECT event_id, user_id % 5 AS tenant, user_id AS key, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, before IS NOT NULL AND ts <= before + INTERVAL 2 HOUR AS hit FROM e""",
)
def cache_replayed(spark, sf_dir):
    """Which requests a cache that keeps entries for two hours after their last use would have answered."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("event_id", "ts", before.alias("before"))
    return rows.select("event_id", (F.col("before").isNotNull() & (F.col("ts") <= F.col("before") + F.expr("INTERVAL 2 HOURS"))).alias("hit"))


@query(
    "page_batch",
    r"""
WITH p AS (SELECT page_id, url, regexp_matches(url, '^https?://[^/?#]+') AND NOT regexp_matches(url, '[?]page=') AS ok FROM pages)
SELECT page_id, url FROM p WHERE ok ORDER BY page_id LIMIT 100""",
)
def page_batch(spark, sf_dir):
    """A batch of valid pages of at most a hundred, what fails left out."""
    valid = F.col("url").rlike(r"^https?://[^/?#]+") & ~F.col("url").rlike("[?]page=")
    return table(spark, sf_dir, "pages").where(valid).select("page_id", "url").orderBy("page_id").limit(100)


@query("sources_synced", "SELECT kind, count(*) AS found, CAST(sum(size) AS BIGINT) AS size FROM (SELECT 'document' AS kind, length(text) AS size FROM documents UNION ALL SELECT 'page', length(html) FROM pages UNION ALL SELECT 'turn', length(text) FROM conversations) GROUP BY 1")
def sources_synced(spark, sf_dir):
    """All sources read in one job, by kind."""
    parts = [("document", "documents", "text"), ("page", "pages", "html"), ("turn", "conversations", "text")]
    rows = [table(spark, sf_dir, t).select(F.lit(kind).alias("kind"), F.length(c).alias("size")) for kind, t, c in parts]
    return rows[0].union(rows[1]).union(rows[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("found"), F.sum("size").alias("size"))

"""Records: lookups, ordered children, validated inserts, merges of relationships, shares and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import keyed
from lodestone.plans.registry import query
from lodestone.plans.text import chunk_windows, docs
from lodestone.sources import table


@query("document_lookup", "SELECT l.doc_id, d.doc_id IS NOT NULL AS found, d.source, d.n_chars FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.lang = 'en'")
def document_lookup(spark, sf_dir):
    """Documents by id for one tenant: another tenant's rows are not found."""
    own = docs(spark, sf_dir).where("lang = 'en'").select("doc_id", "source", "n_chars", F.lit(True).alias("there"))
    return table(spark, sf_dir, "labels").select("doc_id").join(own, "doc_id", "left").select("doc_id", F.col("there").isNotNull().alias("found"), "source", "n_chars")


_W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@query(
    "ordered_chunks",
    f"""
WITH t AS (SELECT doc_id, len({_W}) AS n FROM documents),
c AS (SELECT doc_id, n, unnest(range(CASE WHEN n = 0 THEN 0 WHEN n <= 512 THEN 1 ELSE CAST(ceil((n - 512) / 448.0) AS BIGINT) + 1 END)) AS i FROM t)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS position, CAST(least(512, n - i * 448) AS INTEGER) AS tokens FROM c""",
)
def ordered_chunks(spark, sf_dir):
    """Chunks of each document in order, with their place and tokens."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunk_windows(spark, sf_dir).select("doc_id", "chunk_index", F.row_number().over(order).alias("position"), F.size(F.split("content", " ")).alias("tokens"))


@query(
    "chunks_valid",
    """
SELECT vec_id, len(embedding) AS dimension,
  len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS valid FROM embeddings""",
)
def chunks_valid(spark, sf_dir):
    """Whether each vector may be inserted: of the right dimension, all components finite."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dimension"), ((F.size("embedding") == 64) & ~bad).alias("valid"))


@query(
    "merge_relationships",
    """
WITH e AS (SELECT l_suppkey, l_partkey, l_shipdate, l_orderkey, l_linenumber, l_discount FROM lineitem
    WHERE l_returnflag IN ('A', 'N') AND l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT p_partkey FROM part)),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_discount DESC) AS back FROM e)
SELECT 'S:' || l_suppkey AS src, 'RELATED_TO' AS rel, 'P:' || l_partkey AS dst, min(l_shipdate) AS created_at, max(CASE WHEN back = 1 THEN l_discount END) AS confidence, count(*) AS written
FROM r GROUP BY l_suppkey, l_partkey""",
)
def merge_relationships(spark, sf_dir):
    """One relationship for each pair of known ends and allowed type: first written at, confidence as last written."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "N"))
    rows = rows.join(table(spark, sf_dir, "supplier"), rows["l_suppkey"] == F.col("s_suppkey"), "left_semi").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    last = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_discount")
    merged = rows.groupBy("l_suppkey", "l_partkey").agg(F.min("l_shipdate").alias("created_at"), F.max(last)["l_discount"].alias("confidence"), F.count(F.lit(1)).alias("written"))
    return merged.select(F.concat(F.lit("S:"), "l_suppkey").alias("src"), F.lit("RELATED_TO").alias("rel"), F.concat(F.lit("P:"), "l_partkey").alias("dst"), "created_at", "confidence", "written")


@query(
    "document_graph",
    f"""
WITH t AS (SELECT doc_id, lang, len({_W}) AS n FROM documents),
c AS (SELECT doc_id, unnest(range(CASE WHEN n = 0 THEN 0 WHEN n <= 512 THEN 1 ELSE CAST(ceil((n - 512) / 448.0) AS BIGINT) + 1 END)) AS i FROM t)
SELECT 'D:' || doc_id AS src, 'HAS_CHUNK' AS rel, 'K:' || doc_id || ':' || i AS dst FROM c
UNION ALL SELECT 'D:' || doc_id, 'MENTIONS', 'L:' || lang FROM t""",
)
def document_graph(spark, sf_dir):
    """Edges of documents to their chunks and to the entities they mention."""
    chunks = chunk_windows(spark, sf_dir).select(F.concat(F.lit("D:"), "doc_id").alias("src"), F.lit("HAS_CHUNK").alias("rel"), F.concat(F.lit("K:"), "doc_id", F.lit(":"), "chunk_index").alias("dst"))
    mentions = docs(spark, sf_dir).select(F.concat(F.lit("D:"), "doc_id").alias("src"), F.lit("MENTIONS").alias("rel"), F.concat(F.lit("L:"), "lang").alias("dst"))
    return chunks.union(mentions)


@query("workspace_saves", "SELECT doc_id, strlen(text) AS bytes, strlen(text) <= 100000 AS saved FROM documents")
def workspace_saves(spark, sf_dir):
    """Which documents fit into a saved item of at most 100,000 bytes."""
    size = F.octet_length("text").cast("long")
    return docs(spark, sf_dir).select("doc_id", size.alias("bytes"), (size <= 100_000).alias("saved"))


_KEY = b"share key of the tests"
_INNER, _OUTER = (p.hex() for p in keyed.pads(_KEY))
_AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"


@query(
    "share_tokens",
    f"""
WITH s AS (SELECT event_id, event_id || ':' || user_id AS message, ts + INTERVAL 7 DAY AS expires_at FROM events WHERE event_type = 'purchase')
SELECT event_id, substring(sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode(message)))), 1, 16) AS token, expires_at > {_AS_OF} AS open FROM s""",
)
def share_tokens(spark, sf_dir):
    """Sixteen digits of a keyed hash for every shared item, and whether the share is still open."""
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    message = F.concat("event_id", F.lit(":"), "user_id")
    return events.select("event_id", F.substring(keyed.hmac_sha256(_KEY, message), 1, 16).alias("token"), (F.col("ts") + F.expr("INTERVAL 7 DAY") > F.expr(_AS_OF.replace("TIMESTAMP", "TIMESTAMP_NTZ"))).alias("open"))


@query(
    "entity_uuids",
    """
WITH d AS (SELECT c_custkey, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(c_name)) AS h FROM customer)
SELECT c_custkey, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', CAST(('0x' || substring(h, 17, 1)) AS INT) % 4 + 1, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS id FROM d""",
)
def entity_uuids(spark, sf_dir):
    """Name-based ids of entities."""
    return table(spark, sf_dir, "customer").select("c_custkey", keyed.name_uuid("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("c_name")).alias("id"))


@query("export_markdown", "SELECT doc_id, '# Document ' || doc_id || chr(10) || chr(10) || '*Source: ' || source || '*' || chr(10) || chr(10) || text AS content FROM documents")
def export_markdown(spark, sf_dir):
    """Documents as Markdown."""
    return docs(spark, sf_dir).select("doc_id", F.concat_ws("\n\n", F.concat(F.lit("# Document "), "doc_id"), F.concat(F.lit("*Source: "), "source", F.lit("*")), "text").alias("content"))


@query("export_json", "SELECT doc_id, to_json({'id': doc_id, 'source': source, 'language': lang, 'chars': n_chars}) AS content FROM documents")
def export_json(spark, sf_dir):
    """Documents' descriptions as JSON lines."""
    return docs(spark, sf_dir).select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "source", F.col("lang").alias("language"), F.col("n_chars").alias("chars"))).alias("content"))


@query(
    "reembedded",
    "SELECT doc_id, source, CASE WHEN source = 'src1' THEN 'new' ELSE 'old' END AS model, CASE WHEN source = 'src1' THEN 2 ELSE 1 END AS version FROM documents",
)
def reembedded(spark, sf_dir):
    """Chunks of one tenant written anew by another model, all others as they are."""
    rows = docs(spark, sf_dir).select("doc_id", "source", F.lit("old").alias("model"), F.lit(1).alias("version"))
    again = rows.where("source = 'src1'").select("doc_id", "source", F.lit("new").alias("model"), (F.col("version") + 1).alias("version"))
    return rows.where("NOT source <=> 'src1'").unionByName(again)


@query("tenants", "SELECT DISTINCT lang AS tenant FROM documents")
def tenants(spark, sf_dir):
    """Distinct tenants."""
    return docs(spark, sf_dir).select(F.col("lang").alias("tenant")).distinct()


_USE = """u AS (SELECT event_type AS model, CAST(floor(value * 10) AS BIGINT) AS input, event_id % 500 AS output, CASE WHEN event_id % 3 = 0 THEN event_id % 700 ELSE 0 END AS cache_read, CASE WHEN event_id % 3 = 1 THEN event_id % 300 ELSE 0 END AS cache_write FROM events)"""


def _usage(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"), F.floor(F.col("value") * 10).alias("input"), (e % 500).alias("output"),
        F.when(e % 3 == 0, e % 700).otherwise(0).alias("cache_read"), F.when(e % 3 == 1, e % 300).otherwise(0).alias("cache_write"),
    )


@query(
    "context_usage",
    f"""
WITH {_USE} SELECT model, count(*) AS chunks, CAST(sum(input) AS BIGINT) AS input_tokens, CAST(sum(output) AS BIGINT) AS output_tokens, CAST(sum(cache_write) AS BIGINT) AS written, CAST(sum(cache_read) AS BIGINT) AS read,
  count(*) FILTER (WHERE cache_read > 0) AS hits, count(*) FILTER (WHERE cache_read = 0) AS misses, round(count(*) FILTER (WHERE cache_read > 0) / count(*), 6) AS hit_rate FROM u GROUP BY model""",
)
def context_usage(spark, sf_dir):
    """Tokens of contextual enrichment by model, with cache hits and their rate."""
    hit = F.col("cache_read") > 0
    return _usage(spark, sf_dir).groupBy("model").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("input").alias("input_tokens"), F.sum("output").alias("output_tokens"), F.sum("cache_write").alias("written"), F.sum("cache_read").alias("read"),
        F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.round(F.try_divide(F.count_if(hit), F.count(F.lit(1))), 6).alias("hit_rate"),
    )


_PRICES = [("view", "0.00025", "0.00125", "0.0003", "0.00003"), ("click", "0.003", "0.015", "0.00375", "0.0003"), ("purchase", "0.00015", "0.0006", "0", "0.000075")]
_DEFAULT = ("0.001", "0.002", "0", "0")


@query(
    "context_costs",
    f"""
WITH {_USE}, p(model, a, b, c, d) AS (VALUES {', '.join("('" + m + "', " + ', '.join(f'CAST({x} AS DECIMAL(12,6))' for x in xs) + ')' for m, *xs in _PRICES)}),
t AS (SELECT model, sum(input) AS i, sum(output) AS o, sum(cache_write) AS w, sum(cache_read) AS r FROM u GROUP BY model)
SELECT model, p.model IS NULL AS default_price, round(CAST(i * coalesce(a, {_DEFAULT[0]}) + o * coalesce(b, {_DEFAULT[1]}) + w * coalesce(c, {_DEFAULT[2]}) + r * coalesce(d, {_DEFAULT[3]}) AS DOUBLE) / 1000, 6) AS cost FROM t LEFT JOIN p USING (model)""".replace("SELECT model, p.model IS NULL", "SELECT t.model, p.model IS NULL").replace("LEFT JOIN p USING (model)", "LEFT JOIN p ON p.model = t.model"),
)
def context_costs(spark, sf_dir):
    """Cost of contextual enrichment by model; models without a price have a default one."""
    prices = spark.createDataFrame(_PRICES, "model string, a string, b string, c string, d string").select("model", *(F.col(c).cast("decimal(12,6)").alias(c) for c in "abcd"), F.lit(True).alias("priced"))
    totals = _usage(spark, sf_dir).groupBy("model").agg(*(F.sum(c).alias(c) for c in ("input", "output", "cache_write", "cache_read")))
    parts = [F.col(t).cast("decimal(18,0)") * F.coalesce(p, F.lit(d).cast("decimal(12,6)")) for t, p, d in zip(("input", "output", "cache_write", "cache_read"), "abcd", _DEFAULT, strict=True)]
    cost = F.round((parts[0] + parts[1] + parts[2] + parts[3]).cast("double") / 1000, 6)
    return totals.join(F.broadcast(prices), "model", "left").select("model", F.col("priced").isNull().alias("default_price"), cost.alias("cost"))


@query(
    "cache_stats",
    "SELECT user_id % 10 AS tenant, count(*) FILTER (WHERE event_id % 4 <> 0) AS hits, count(*) FILTER (WHERE event_id % 4 = 0) AS misses, round(count(*) FILTER (WHERE event_id % 4 <> 0) / count(*), 6) AS hit_rate FROM events GROUP BY 1",
)
def cache_stats(spark, sf_dir):
    """Hits, misses and hit rate of a cache by tenant."""
    hit = F.col("event_id") % 4 != 0
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("tenant")).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.round(F.try_divide(F.count_if(hit), F.count(F.lit(1))), 6).alias("hit_rate"))


@query(
    "session_quotas",
    """
WITH s AS (SELECT conv_id % 7 AS tenant, conv_id, count(*) AS messages FROM conversations GROUP BY 1, 2)
SELECT tenant, count(*) AS sessions, count(*) > 10 AS sessions_exceeded, CAST(sum(messages) AS BIGINT) AS messages, count(*) FILTER (WHERE messages > 6) AS long_sessions FROM s GROUP BY 1""",
)
def session_quotas(spark, sf_dir):
    """Sessions and messages by tenant against their limits."""
    sessions = table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 7).alias("tenant"), "conv_id").agg(F.count(F.lit(1)).alias("messages"))
    return sessions.groupBy("tenant").agg(F.count(F.lit(1)).alias("sessions"), (F.count(F.lit(1)) > 10).alias("sessions_exceeded"), F.sum("messages").alias("messages"), F.count_if(F.col("messages") > 6).alias("long_sessions"))


@query(
    "change_totals",
    """
WITH e AS (SELECT o_orderkey, count(*) AS nodes, count(DISTINCT l_suppkey) AS refs FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-02-01' GROUP BY 1)
SELECT count(*) AS episodes, CAST(coalesce(sum(nodes), 0) AS BIGINT) AS edges, CAST(coalesce(sum(refs), 0) AS BIGINT) AS entities FROM e""",
)
def change_totals(spark, sf_dir):
    """Totals of what has changed in a month: episodes, the edges and the entities they refer to."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1998-01-01' AND o_orderdate < TIMESTAMP_NTZ '1998-02-01'").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    each = orders.join(lines, "o_orderkey").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("edges"), F.size(F.collect_set("l_suppkey")).alias("entities"))
    return each.agg(F.count(F.lit(1)).alias("episodes"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"), F.coalesce(F.sum("entities"), F.lit(0)).alias("entities"))


@query(
    "bench_averages",
    "SELECT event_type AS strategy, count(*) AS queries, round(avg(CAST(value AS DECIMAL(12,4))), 4) AS latency, round(avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.5 END), 6) AS mrr FROM events GROUP BY 1",
)
def bench_averages(spark, sf_dir):
    """Mean latency and mean metric of every strategy of a benchmark run."""
    mrr = F.when(F.col("event_id") % 3 == 0, 1.0).otherwise(0.5)
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("strategy")).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.col("value").cast("decimal(12,4)")).cast("double"), 4).alias("latency"), F.round(F.avg(mrr), 6).alias("mrr"))


@query(
    "agents_by_capability",
    """
WITH a AS (SELECT user_id AS agent, list_sort(list_distinct(list(event_type))) AS capabilities, max(ts) AS seen FROM events GROUP BY 1)
SELECT agent, len(capabilities) AS n_capabilities, seen FROM a WHERE list_contains(capabilities, 'purchase') AND seen > TIMESTAMP '2024-01-29 00:00:00'""",
)
def agents_by_capability(spark, sf_dir):
    """Healthy agents that have a capability."""
    agents = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("agent")).agg(F.collect_set("event_type").alias("capabilities"), F.max("ts").alias("seen"))
    return agents.where(F.array_contains("capabilities", "purchase") & F.expr("seen > TIMESTAMP_NTZ '2024-01-29 00:00:00'")).select("agent", F.size("capabilities").cast("long").alias("n_capabilities"), "seen")


@query("ids_valid", "SELECT doc_id, source, regexp_full_match(source, '[a-zA-Z0-9_-]{1,5}') AS valid FROM documents")
def ids_valid(spark, sf_dir):
    """Whether tenant ids have the allowed form."""
    return docs(spark, sf_dir).select("doc_id", "source", F.col("source").rlike(r"\A[a-zA-Z0-9_-]{1,5}\z").alias("valid"))


@query(
    "hits_by_metadata",
    """
WITH h AS (SELECT event_id, user_id, value, props, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r) AS rank FROM h WHERE r <= 20 AND CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0)
SELECT user_id, event_id, rank FROM f WHERE rank <= 10""",
)
def hits_by_metadata(spark, sf_dir):
    """Ten hits of each query that have the wanted metadata, out of twice as many fetched."""
    best = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    hits = table(spark, sf_dir, "events").select("event_id", "user_id", "props", F.row_number().over(best).alias("r")).where("r <= 20")
    wanted = hits.where(F.get_json_object("props", "$.k").cast("int") % 2 == 0)
    return wanted.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("r")).alias("rank")).where("rank <= 10")

"""Vector search over ``embeddings``: every row whose id is divisible by 20 asks, all rows answer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.operators import chunking, embedding, telemetry, vector_index, vector_search
from lodestone.operators.graph import shared_folder
from lodestone.plans.registry import query
from lodestone.sources import table


def _pairs(where: str = "") -> str:
    return f"""
  SELECT q.vec_id AS query_id, c.vec_id AS id,
    round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS similarity
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0 {where}"""


def _ranked(k: int, threshold: float, where: str = "") -> str:
    return f"""
SELECT query_id, id, similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM ({_pairs(where)}) p
  WHERE similarity >= {threshold}) r
WHERE rank <= {k}"""


def _search(spark, sf_dir, k, threshold, group=None):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", *([group.alias("grp_key")] if group is not None else []))
    return vector_search.topk(vectors, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", k, threshold, "grp_key" if group is not None else None)


@query("vec_topk", _ranked(8, 0.1))
def vec_topk(spark, sf_dir):
    """Nearest eight vectors by cosine of at least 0.1."""
    return _search(spark, sf_dir, 8, 0.1)


@query("vec_index_search", _ranked(8, 0.1))
def vec_index_search(spark, sf_dir):
    """The same out of an index on disk, built of most vectors, with the others appended, and all of its lists probed."""
    vectors, folder = table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    vector_index.create(vectors.where("vec_id % 5 <> 0"), "vec_id", "embedding", folder, lists=16)
    vector_index.append(vectors.where("vec_id % 5 = 0"), "vec_id", "embedding", folder)
    return vector_index.search(vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", folder, 16, 8, 0.1)


@query("vec_topk_level", _ranked(5, 0.0, "AND q.vec_id % 4 = c.vec_id % 4"))
def vec_topk_level(spark, sf_dir):
    """The same among vectors of the query's level."""
    return _search(spark, sf_dir, 5, 0.0, F.col("vec_id") % 4)


@query("vec_topk_label", _ranked(5, 0.0, "AND q.label = c.label"))
def vec_topk_label(spark, sf_dir):
    """The same among vectors of the query's label, the tenant of this table."""
    return _search(spark, sf_dir, 5, 0.0, F.col("label"))


@query(
    "vec_small_to_big",
    f"""
WITH hits AS ({_ranked(24, 0.05)}),
g AS (SELECT query_id, id // 10 AS parent_id, count(*) AS n_children, max(similarity) AS best FROM hits GROUP BY 1, 2),
s AS (SELECT query_id, parent_id, n_children, round(least(1.0, best + least(0.1 * (n_children - 1), 0.2)), 3) AS score FROM g)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS rank FROM s) WHERE rank <= 8""",
)
def vec_small_to_big(spark, sf_dir):
    """Small hits, three times as many as wanted, gathered into their parents."""
    return vector_search.grouped_parents(_search(spark, sf_dir, 24, 0.05), F.floor(F.col("id") / 10), 8)


_GAIN = (0.8, 1.0, 1.05, 1.1, 1.25, 1.5)


@query(
    "rerank_gain",
    f"""
WITH hits AS ({_ranked(24, 0.05)}),
g AS (SELECT query_id, id // 10 AS parent_id, round(least(1.0, max(similarity) + least(0.1 * (count(*) - 1), 0.2)), 3) AS score FROM hits GROUP BY 1, 2),
x AS (SELECT query_id, max(similarity) AS pre FROM hits GROUP BY 1), y AS (SELECT query_id, max(score) AS post FROM g GROUP BY 1),
i AS (SELECT query_id, round(pre, 6) AS pre, round(post, 6) AS post, post / pre AS ratio FROM x JOIN y USING (query_id) WHERE pre > 0),
b AS (SELECT CAST(v AS DOUBLE) AS le FROM (VALUES {", ".join(f"({b})" for b in _GAIN)}, ('inf'::DOUBLE)) z(v)),
h AS (SELECT le, count(*) FILTER (ratio <= le) AS n FROM i, b GROUP BY 1),
r AS (SELECT *, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS low, 0.5 * max(n) OVER () AS want FROM h WINDOW w AS (ORDER BY le)),
q AS (SELECT round(arg_min(CASE WHEN le = 'inf'::DOUBLE THEN {_GAIN[-1]} ELSE low + (le - low) * (want - below) / (n - below) END, le), 6) AS median FROM r WHERE n >= want AND below < want)
SELECT query_id, pre, post, round(ratio, 6) AS ratio, median, median < 1 AS ineffective FROM i, q""",
)
def rerank_gain(spark, sf_dir):
    """What gathering small hits into parents gains each query, the median gain out of its histogram, and whether that calls for an alert."""
    hits = _search(spark, sf_dir, 24, 0.05)
    parents = vector_search.grouped_parents(hits, F.floor(F.col("id") / 10), 1)
    gains = telemetry.improvement(hits.withColumnRenamed("similarity", "score"), parents, "query_id", "score")
    median = telemetry.quantile(telemetry.histogram(gains.withColumn("all_of", F.lit(1)), ["all_of"], "ratio", _GAIN), ["all_of"], 0.5).select(F.col("quantile").alias("median"))
    rows = gains.select("query_id", *(F.round(c, 6).alias(c) for c in ("pre", "post", "ratio")))
    return rows.crossJoin(median).withColumn("ineffective", F.col("median") < 1)  # one row beside each


_W = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')"
_PLACES = f"""
t AS (SELECT doc_id, {_W} AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 512 THEN 1 ELSE CAST(ceil((len(w) - 512) / 448.0) AS BIGINT) + 1 END)) AS i FROM t),
k AS (SELECT doc_id * 65536 + i AS id, w[i * 448 + 1:i * 448 + 512] AS w FROM c UNION ALL SELECT -1 - item_id, {_W} FROM benchmark),
f AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]))) AS feature FROM k),
p AS (SELECT id, CAST('0x' || substring(md5(feature), 1, 8) AS BIGINT) % 256 AS place, 1 - 2 * (CAST('0x' || substring(md5(feature), 9, 1) AS BIGINT) % 2) AS sign FROM f),
v AS (SELECT id, place, sum(sign) AS value FROM p GROUP BY 1, 2 HAVING sum(sign) <> 0),
u AS (SELECT id, place, value, sqrt(sum(value * value) OVER (PARTITION BY id)) AS norm FROM v)"""


def _chunk_vectors(spark, sf_dir):
    chunks = chunking.windows(table(spark, sf_dir, "documents"), ["doc_id"], F.col("text"), 512, 64)
    return embedding.text_vectors(chunks.select((F.col("doc_id") * 65536 + F.col("chunk_index")).alias("id"), "content"), F.col("content")).select("id", "vector")


@query("chunk_vectors", f"WITH {_PLACES} SELECT id, count(*) AS places, round(max(abs(value) / norm), 9) AS peak, CAST(arg_min(place, (-abs(value), place)) AS INT) AS peak_at FROM u WHERE id >= 0 GROUP BY id")
def chunk_vectors(spark, sf_dir):
    """Chunks of all documents as hashed vectors: how many places aren't zero, and the first of the greatest."""
    sizes = _chunk_vectors(spark, sf_dir).select("id", F.transform("vector", F.abs).alias("sizes"))
    rows = sizes.select("id", F.size(F.filter("sizes", lambda x: x > 0)).cast("long").alias("places"), F.array_max("sizes").alias("top"), "sizes")
    return rows.where("places > 0").select("id", "places", F.round("top", 9).alias("peak"), (F.array_position("sizes", F.col("top")) - 1).cast("int").alias("peak_at"))


@query(
    "passages_nearest",
    f"""
WITH {_PLACES},
s AS (SELECT -1 - a.id AS item_id, b.id, round(sum(a.value * b.value) / (a.norm * b.norm), 6) AS similarity FROM u a JOIN u b ON a.place = b.place AND a.id < 0 AND b.id >= 0 GROUP BY a.id, b.id, a.norm, b.norm)
SELECT item_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, id) AS rank FROM s WHERE similarity >= 0.2) WHERE rank <= 5""",
)
def passages_nearest(spark, sf_dir):
    """For each passage of the benchmark the five chunks whose hashed vectors are nearest."""
    asked = embedding.text_vectors(table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("id"), "text"), F.col("text")).select("id", "vector")
    found = vector_search.topk(_chunk_vectors(spark, sf_dir), asked, "id", "vector", 5, 0.2)
    return found.select((-1 - F.col("query_id")).alias("item_id"), "id", "similarity", "rank")

"""Composite retrieval: memories by vector, late interaction, walks to parents, graph and vector evidence together."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import classify, text
from lodestone.operators import chunking, graph, grounding, history, multi_vector, vector_search
from lodestone.plans.costs import _FEEDBACK, AS_OF, _faded, _feedback
from lodestone.plans.graph import _BOTH, _P, _V, part_of, vertices
from lodestone.plans.knowledge import ancestors, chunk_tree
from lodestone.plans.registry import query
from lodestone.plans.vector import _pairs, _ranked, _search
from lodestone.sources import table

_SCOPED = "s AS (SELECT vec_id, embedding, vec_id % 4 AS scope, label AS owner FROM embeddings)"
_SIM = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6)"


@query(
    "memory_vector_search",
    f"""
WITH {_SCOPED}, p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_SIM} AS similarity FROM s q JOIN s c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND (c.scope = 3 OR c.owner = q.owner))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p) WHERE rank <= 5""",
)
def memory_vector_search(spark, sf_dir):
    """The nearest memories that are everyone's or the asker's own."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    asks = rows.where("vec_id % 20 = 0")
    everyone = vector_search.topk(rows.where("vec_id % 4 = 3"), asks, "vec_id", "embedding", 5, -2.0)
    own = vector_search.topk(rows, asks, "vec_id", "embedding", 5, -2.0, "label")
    both = everyone.unionByName(own).select("query_id", "id", "similarity").distinct()
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).where("rank <= 5")


@query(
    "similar_memories",
    f"""
WITH {_SCOPED}, p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_SIM} AS similarity FROM s q JOIN s c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND q.owner = c.owner)
SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p WHERE similarity >= 0.15""",
)
def similar_memories(spark, sf_dir):
    """All memories of the owner that are similar enough, nearest first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    most = rows.groupBy("label").count().agg(F.max("count")).first()[0] or 1  # no owner has more to be found
    return vector_search.topk(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", most, 0.15, "label")


_TOKENS = "list_transform(range(0, 8), lambda i: list_transform({v}[i * 8 + 1:i * 8 + 8], lambda x: CAST(x AS DOUBLE)))"
_UNIT = "list_transform({t}, lambda v: list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-8)))"


def _units(v):
    return _UNIT.format(t=_TOKENS.format(v=v))


@query(
    "maxsim_rerank",
    f"""
WITH h AS ({_ranked(8, 0.1)}),
u AS (SELECT vec_id, {_units('embedding')} AS t FROM embeddings),
p AS (SELECT h.query_id, h.id, h.rank AS original_rank, unnest(q.t) AS qv, generate_subscripts(q.t, 1) AS i, d.t AS dt FROM h JOIN u q ON q.vec_id = h.query_id JOIN u d ON d.vec_id = h.id),
m AS (SELECT query_id, id, original_rank, i, list_max(list_transform(dt, lambda dv: list_dot_product(qv, dv))) AS best FROM p),
s AS (SELECT query_id, id, original_rank, round(sum(best), 6) AS score FROM m GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s""",
)
def maxsim_rerank(spark, sf_dir):
    """Vector hits ordered anew by the sum of each query token's best match; eight tokens make up a vector here."""
    hits = _search(spark, sf_dir, 8, 0.1)
    tokens = F.transform(multi_vector.slices(F.col("embedding"), 8, 8), multi_vector.unit)
    units = table(spark, sf_dir, "embeddings").select("vec_id", tokens.alias("t"))
    joined = hits.join(units.select(F.col("vec_id").alias("query_id"), F.col("t").alias("q")), "query_id").join(units.select(F.col("vec_id").alias("id"), F.col("t").alias("d")), "id")
    scored = joined.select("query_id", "id", F.col("rank").alias("original_rank"), F.round(multi_vector.max_sim(F.col("q"), F.col("d")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


@query("vec_partitioned")
def vec_partitioned(spark, sf_dir):
    """Nearest eight vectors out of the lists of an index; the tests measure its recall."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index, centroids = multi_vector.partitioned(rows, "vec_id", "embedding", lists=16, sample=20_000)
    asks = rows.where("vec_id % 20 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return multi_vector.probed(index, centroids, asks, probes=12, k=8)


_TREE = """t AS (SELECT vec_id AS id, CASE WHEN vec_id % 40 = 0 THEN NULL ELSE vec_id - vec_id % (CASE WHEN vec_id % 4 <> 0 THEN 4 WHEN vec_id % 8 <> 0 THEN 8 ELSE 40 END) END AS parent,
    CASE WHEN vec_id % 40 = 0 THEN 3 WHEN vec_id % 8 = 0 THEN 2 WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END AS level FROM embeddings)"""


@query(
    "small_to_big_walk",
    f"""
WITH RECURSIVE {_TREE}, hits AS ({_ranked(24, 0.05)}),
w(start, id, level) AS (SELECT id, id, level FROM t UNION ALL SELECT w.start, p.id, p.level FROM w JOIN t c ON c.id = w.id JOIN t p ON p.id = c.parent WHERE w.level < 2),
a AS (SELECT start, arg_max(id, level) AS ancestor FROM w GROUP BY start),
g AS (SELECT query_id, ancestor AS parent_id, count(*) AS n_children, max(similarity) AS best FROM hits JOIN a ON start = hits.id GROUP BY 1, 2),
s AS (SELECT query_id, parent_id, n_children, round(least(1.0, best + least(0.1 * (n_children - 1), 0.2)), 3) AS score FROM g)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS rank FROM s) WHERE rank <= 8""",
)
def small_to_big_walk(spark, sf_dir):
    """Small hits gathered into the parents that a walk up the hierarchy leads to."""
    up = ancestors(chunk_tree(spark, sf_dir), 2, 3).select(F.col("start").alias("id"), "ancestor")
    return vector_search.grouped_parents(_search(spark, sf_dir, 24, 0.05).join(up, "id"), F.col("ancestor"), 8)


@query(
    "similar_queries",
    f"""
WITH fb AS (SELECT DISTINCT user_id AS vec_id FROM events WHERE event_type <> 'error'), p AS ({_pairs("AND c.vec_id IN (SELECT vec_id FROM fb)")})
SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p WHERE similarity >= 0.0) WHERE rank <= 5""",
)
def similar_queries(spark, sf_dir):
    """The five nearest earlier queries that have feedback other than corrections, out of all that have any."""
    given = table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("user_id").alias("vec_id")).distinct()
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_search.topk(vectors.join(given, "vec_id", "left_semi"), vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", 5, 0.0)


@query(
    "query_boost",
    f"""
WITH {_FEEDBACK}, p AS ({_pairs("AND c.vec_id IN (SELECT user_id FROM events)")}),
h AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS r FROM p) WHERE r <= 5),
d AS (SELECT query_id AS id, score, CAST(floor((epoch_us({AS_OF}) - epoch_us(ts)) / 86400000000.0) AS BIGINT) AS age FROM f),
w AS (SELECT id, score, CASE WHEN age <= 10 THEN 1.0 ELSE exp(-(age - 10) / 10.0) END AS decay FROM d),
g AS (SELECT h.query_id, count(DISTINCT h.id) AS based_on_queries, count(*) AS n, sum(score * decay) / sum(decay) AS mean, sum(decay) AS total FROM h JOIN w ON w.id = h.id GROUP BY 1)
SELECT query_id, based_on_queries, n, round(CASE WHEN n < 10 THEN 1.0 ELSE greatest(0.5, least(1.5, 1 + 0.5 * mean)) END, 6) AS boost,
  round(CASE WHEN n < 10 THEN n / 10.0 ELSE least(1.0, n / 20.0) END, 6) AS confidence, total < n - 1e-9 AS decay_applied FROM g""",
)
def query_boost(spark, sf_dir):
    """Ranking boost of each query from the fading feedback of the five nearest past queries that have any."""
    given = _feedback(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    past = vectors.join(given.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    near = vector_search.topk(past, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", 5, -1.0).select("query_id", "id")
    return history.similar_boost(near, _faded(given), "query_id", "score", "decay")


_QUESTIONS = """k AS (SELECT vec_id AS query_id, vec_id // 20 AS k FROM embeddings WHERE vec_id % 20 = 0),
q AS (SELECT query_id, k % 4 AS kind, CASE k % 4 WHEN 0 THEN 'Give a summary of ' || n_name WHEN 1 THEN 'Which path leads from ' || n_name || ' to ' || r_name
  WHEN 2 THEN 'Compare the graph of ' || n_name || ' across ' || r_name ELSE 'Who is customer ' || lpad(CAST(query_id AS VARCHAR), 9, '0') END AS question
  FROM k JOIN nation ON n_nationkey = k % 25 JOIN region ON r_regionkey = n_regionkey)"""


def questions(spark, sf_dir):
    """Rows (query_id, question): each asking vector with a question about a nation, its region or a customer."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.floor(F.col("vec_id") / 20).alias("k"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("k") % 4
    said = (
        F.when(k == 0, F.concat(F.lit("Give a summary of "), "n_name"))
        .when(k == 1, F.concat(F.lit("Which path leads from "), "n_name", F.lit(" to "), "r_name"))
        .when(k == 2, F.concat(F.lit("Compare the graph of "), "n_name", F.lit(" across "), "r_name"))
        .otherwise(F.concat(F.lit("Who is customer "), F.lpad(F.col("query_id").cast("string"), 9, "0")))
    )
    return asked.join(places, F.col("k") % 25 == F.col("n_nationkey")).select("query_id", said.alias("question"))


_TERMS = "list_transform(regexp_extract_all({}, '[A-Za-z0-9][A-Za-z0-9_-]{{2,}}'), lambda x: lower(x))"
_LAZY = f"""{_V}, {_P}, {_BOTH}, {_QUESTIONS},
qt AS (SELECT DISTINCT query_id, unnest({_TERMS.format("question")}) AS term FROM q), vt AS (SELECT DISTINCT id, unnest({_TERMS.format("name")}) AS term FROM v),
seeds AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS r FROM (SELECT DISTINCT query_id, id FROM qt JOIN vt ON vt.term = qt.term
  WHERE qt.term NOT IN ({', '.join(repr(w) for w in classify.STOPWORDS)}))) WHERE r <= 10),
one AS (SELECT DISTINCT query_id, ways.dst AS id FROM seeds JOIN ways ON ways.src = seeds.id),
two AS (SELECT DISTINCT query_id, ways.dst AS id FROM one JOIN ways ON ways.src = one.id),
a AS (SELECT query_id, id, min(hop) AS hop FROM (SELECT query_id, id, 0 AS hop FROM seeds UNION ALL SELECT query_id, id, 1 FROM one UNION ALL SELECT query_id, id, 2 FROM two) GROUP BY 1, 2),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, id) AS place FROM a) WHERE place <= 50),
r AS (SELECT x.query_id, p.src, p.rel, p.dst FROM e x JOIN p ON p.src = x.id JOIN e y ON y.query_id = x.query_id AND y.id = p.dst)"""


def _entities(spark, sf_dir):
    """(questions, their entities): seeds by terms and what lies within two hops of them."""
    asked = questions(spark, sf_dir)
    return asked, grounding.entities(grounding.seeds(asked, vertices(spark, sf_dir), classify.STOPWORDS), graph.undirected(part_of(spark, sf_dir)))


@query(
    "lazy_query",
    f"""
WITH {_LAZY}, n AS (SELECT query_id, count(*) AS entities, count(*) FILTER (WHERE hop = 0) AS seeds, string_agg(lower(name), ' ') AS names FROM e JOIN v ON v.id = e.id GROUP BY 1),
c AS (SELECT query_id, count(*) AS rels FROM r GROUP BY 1),
t AS (SELECT q.query_id, coalesce(entities, 0) AS entities, coalesce(seeds, 0) AS seeds, coalesce(rels, 0) AS rels, coalesce(names, '') AS names, regexp_extract_all(lower(question), '\\w{{3,}}') AS terms
  FROM q LEFT JOIN n ON n.query_id = q.query_id LEFT JOIN c ON c.query_id = q.query_id)
SELECT query_id, entities, seeds, rels AS relationships, CASE WHEN entities = 0 THEN 0.0 ELSE round(least(1.0, entities / CAST(50 AS DOUBLE)) * 0.4 + len(list_filter(terms, lambda x: contains(names, x))) / CAST(len(terms) AS DOUBLE) * 0.4
  + CASE WHEN entities > 1 THEN least(1.0, rels / CAST(entities * (entities - 1) AS DOUBLE)) ELSE 0.0 END * 0.2 + 1e-9, 2) END AS confidence FROM t""",
)
def lazy_query(spark, sf_dir):
    """Seeds of each question, their neighbourhood, the relationships inside it and the confidence of an answer from them."""
    asked, found = _entities(spark, sf_dir)
    found = graph.cut(found)
    return grounding.confidence(asked, found, grounding.relationships(found, part_of(spark, sf_dir)), vertices(spark, sf_dir))


@query(
    "hybrid_retrieve",
    f"""
WITH {_LAZY}, h AS ({_ranked(5, 0.0)})
SELECT query_id, 'vector' AS kind, CAST(id AS VARCHAR) AS id, rank AS place FROM h UNION ALL SELECT query_id, 'graph', id, place FROM e WHERE place <= 5""",
)
def hybrid_retrieve(spark, sf_dir):
    """Vector hits and graph entities of the questions, five of each."""
    hits = _search(spark, sf_dir, 5, 0.0).select("query_id", F.lit("vector").alias("kind"), F.col("id").cast("string").alias("id"), F.col("rank").alias("place"))
    return hits.union(_entities(spark, sf_dir)[1].where("place <= 5").select("query_id", F.lit("graph").alias("kind"), "id", "place"))


@query(
    "orchestrated",
    f"""
WITH {_LAZY}, h AS ({_ranked(5, 0.0)}), s AS (SELECT query_id, question, ['vector', 'graph', 'hybrid', 'vector'][kind + 1] AS strategy FROM q),
vh AS (SELECT query_id, count(*) AS n, string_agg('[' || id || '] ' || coalesce(text, ''), chr(10) ORDER BY rank) AS said FROM h LEFT JOIN documents ON doc_id = id GROUP BY 1),
g AS (SELECT query_id, count(*) AS n, string_agg('[' || e.id || '] ' || type || ' ' || name, chr(10) ORDER BY place) AS said FROM e JOIN v ON v.id = e.id WHERE place <= 5 GROUP BY 1)
SELECT s.query_id, strategy, CASE WHEN strategy = 'graph' THEN 0 ELSE coalesce(vh.n, 0) END AS vector_hits, CASE WHEN strategy = 'vector' THEN 0 ELSE coalesce(g.n, 0) END AS graph_hits,
  'Question: ' || question || CASE WHEN strategy <> 'graph' AND vh.n > 0 THEN chr(10) || chr(10) || 'Passages:' || chr(10) || vh.said ELSE '' END || CASE WHEN strategy <> 'vector' AND g.n > 0 THEN chr(10) || chr(10) || 'Entities:' || chr(10) || g.said ELSE '' END AS prompt
FROM s LEFT JOIN vh ON vh.query_id = s.query_id LEFT JOIN g ON g.query_id = s.query_id""",
)
def orchestrated(spark, sf_dir):
    """For each question the strategy that its words call for, the evidence of that kind and the prompt made of both."""
    asked, found = _entities(spark, sf_dir)
    asked = asked.withColumn("strategy", classify.strategy(F.col("question")))

    def said(rows, place, line):  # at most five lines of a question
        lines = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), line.alias("line")))).alias("l"))
        return lines.select("query_id", F.size("l").cast("long").alias("n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("said"))

    wants = lambda kind: asked.where(F.col("strategy").isin(kind, "hybrid")).select("query_id")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = _search(spark, sf_dir, 5, 0.0).join(wants("vector"), "query_id", "left_semi").join(texts, "id", "left")
    passages = said(hits, "rank", F.concat(F.lit("["), "id", F.lit("] "), F.coalesce("text", F.lit("")))).select("query_id", F.col("n").alias("v"), F.col("said").alias("v_said"))
    named = found.where("place <= 5").join(wants("graph"), "query_id", "left_semi").join(vertices(spark, sf_dir), "id")
    places = said(named, "place", F.concat(F.lit("["), "id", F.lit("] "), "type", F.lit(" "), "name")).select("query_id", F.col("n").alias("g"), F.col("said").alias("g_said"))
    rows = asked.join(passages, "query_id", "left").join(places, "query_id", "left")
    prompt = F.concat_ws("\n\n", F.concat(F.lit("Question: "), "question"), F.concat(F.lit("Passages:\n"), "v_said"), F.concat(F.lit("Entities:\n"), "g_said"))
    return rows.select("query_id", "strategy", F.coalesce("v", F.lit(0)).alias("vector_hits"), F.coalesce("g", F.lit(0)).alias("graph_hits"), prompt.alias("prompt"))


_W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@query(
    "index_job",
    f"""
WITH d AS (SELECT min(doc_id) AS doc_id, lang AS tenant, text FROM documents GROUP BY lang, text), t AS (SELECT doc_id, tenant, {_W} AS w FROM d),
c AS (SELECT doc_id, tenant, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 512 THEN 1 ELSE CAST(ceil((len(w) - 512) / 448.0) AS BIGINT) + 1 END)) AS i FROM t),
k AS (SELECT doc_id, tenant, i, array_to_string(w[i * 448 + 1:i * 448 + 512], ' ') AS content, least(512, len(w) - i * 448) AS tokens FROM c)
SELECT doc_id, tenant, CAST(i AS INTEGER) AS chunk_index, 'chunk_0_' || substring(sha256(tenant || ':' || doc_id || ':L0:C' || i), 1, 16) AS chunk_id, CAST(tokens AS INTEGER) AS tokens, sha256('Document: ' || doc_id || chr(10) || chr(10) || content) AS embedded_sha256 FROM k""",
)
def index_job(spark, sf_dir):
    """Documents once for each tenant and content, in chunks with ids, sizes and the text that is embedded."""
    first = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("tenant"), "text").agg(F.min("doc_id").alias("doc_id"))
    chunks = chunking.windows(first, ["doc_id", "tenant"], F.col("text"), 512, 64)
    embedded = F.concat_ws("\n\n", F.concat(F.lit("Document: "), "doc_id"), "content")
    return chunks.select("doc_id", "tenant", "chunk_index", text.chunk_id(F.col("tenant"), F.col("doc_id"), F.lit(0), F.col("chunk_index")).alias("chunk_id"), "tokens", F.sha2(embedded, 256).alias("embedded_sha256"))


@query(
    "context_reindex",
    f"""
WITH t AS (SELECT doc_id, source, {_W} AS w FROM documents WHERE source IN ('src1', 'src2')),
c AS (SELECT doc_id, source, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 512 THEN 1 ELSE CAST(ceil((len(w) - 512) / 448.0) AS BIGINT) + 1 END)) AS i FROM t)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, 'Document: ' || source || chr(10) || chr(10) || 'Context: part ' || (i + 1) || chr(10) || chr(10) || array_to_string(w[i * 448 + 1:i * 448 + 512], ' ') AS content FROM c""",
)
def context_reindex(spark, sf_dir):
    """The chunks of some tenants again in order, each with its context before it."""
    rows = table(spark, sf_dir, "documents").where("source IN ('src1', 'src2')")
    chunks = chunking.windows(rows, ["doc_id", "source"], F.col("text"), 512, 64)
    content = F.concat_ws("\n\n", F.concat(F.lit("Document: "), "source"), F.concat(F.lit("Context: part "), F.col("chunk_index") + 1), "content")
    return chunks.select("doc_id", "chunk_index", content.alias("content"))

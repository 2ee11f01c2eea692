"""Documents and pages: identity, chunks, links, markup and classification."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import classify, text
from lodestone.operators import chunking
from lodestone.plans.registry import query
from lodestone.sources import table

_W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(
    "dedup_upsert",
    """
SELECT lang AS tenant, sha256(text) AS content_hash, min(doc_id) AS doc_id, max(doc_id) AS last_seen, count(*) AS n FROM documents GROUP BY 1, 2""",
)
def dedup_upsert(spark, sf_dir):
    """Documents once for each tenant and content; the first stays, the last touches it."""
    return docs(spark, sf_dir).groupBy(F.col("lang").alias("tenant"), F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last_seen"), F.count(F.lit(1)).alias("n"))


@query(
    "upsert_last_wins",
    "SELECT source, lang, arg_max(doc_id, doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1, 2",
)
def upsert_last_wins(spark, sf_dir):
    """Of rows with one key the last one written."""
    return docs(spark, sf_dir).groupBy("source", "lang").agg(F.max("doc_id").alias("doc_id"), F.max_by("n_chars", "doc_id").alias("n_chars"))


@query("delete_listed", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def delete_listed(spark, sf_dir):
    """What is left after deleting the documents of a list."""
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return docs(spark, sf_dir).join(gone, "doc_id", "left_anti").select("doc_id", "source")


@query("count_by_source", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT lang) AS langs FROM documents GROUP BY 1")
def count_by_source(spark, sf_dir):
    """Documents, characters and languages by source."""
    return docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("langs"))


@query(
    "text_keys",
    """
SELECT doc_id, 'chunk_0_' || substring(sha256(lang || ':' || doc_id || ':L0:C1'), 1, 16) AS chunk_id,
  CAST('0x' || substring(sha256(source), 1, 8) AS BIGINT) % 16 AS bucket,
  CASE WHEN length(text) > 500 THEN rtrim(substring(text, 1, 500), ' ') || '...' ELSE text END AS preview FROM documents""",
)
def text_keys(spark, sf_dir):
    """Deterministic chunk id, tenant bucket and preview."""
    return docs(spark, sf_dir).select(
        "doc_id",
        text.chunk_id(F.col("lang"), F.col("doc_id"), F.lit(0), F.lit(1)).alias("chunk_id"),
        text.tenant_bucket(F.col("source"), 16).alias("bucket"),
        text.truncated(F.col("text"), 500).alias("preview"),
    )


@query(
    "chunk_windows",
    f"""
WITH t AS (SELECT doc_id, {_W} AS w FROM documents),
c AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 512 THEN 1 ELSE CAST(ceil((len(w) - 512) / 448.0) AS BIGINT) + 1 END AS n FROM t),
e AS (SELECT doc_id, w, unnest(range(n)) AS i FROM c)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, array_to_string(w[i * 448 + 1:i * 448 + 512], ' ') AS content FROM e""",
)
def chunk_windows(spark, sf_dir):
    """Chunks of 512 words that overlap by 64."""
    return chunking.windows(docs(spark, sf_dir), ["doc_id"], F.col("text"), 512, 64).select("doc_id", "chunk_index", "content")


@query(
    "chunk_hierarchy",
    f"""
WITH t AS (SELECT doc_id, {_W} AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 256 THEN 1 ELSE CAST(ceil((len(w) - 256) / 231.0) AS BIGINT) + 1 END)) AS i FROM t)
SELECT doc_id, i // 2 AS parent_index, count(*) AS children, CAST(sum(len(w[i * 231 + 1:i * 231 + 256])) AS BIGINT) AS tokens FROM c GROUP BY 1, 2""",
)
def chunk_hierarchy(spark, sf_dir):
    """Chunks of 256 words that overlap by a tenth, two to a parent."""
    chunks = chunking.windows(docs(spark, sf_dir), ["doc_id"], F.col("text"), 256, 25)
    return chunks.groupBy("doc_id", F.floor(F.col("chunk_index") / 2).alias("parent_index")).agg(F.count(F.lit(1)).alias("children"), F.sum("tokens").alias("tokens"))


@query("chunk_estimate", f"SELECT doc_id, CAST(CASE WHEN len({_W}) = 0 THEN 0 WHEN len({_W}) <= 512 THEN 1 ELSE ceil(len({_W}) / (CAST(0.8 AS DOUBLE) * 512)) END AS BIGINT) AS chunks FROM documents")
def chunk_estimate(spark, sf_dir):
    """Chunks to expect of every document."""
    return docs(spark, sf_dir).select("doc_id", text.estimated_chunks(F.size(text.words(F.col("text"))), 512).alias("chunks"))


@query(
    "chunks_to_documents",
    f"""
WITH t AS (SELECT doc_id, {_W} AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(CASE WHEN len(w) <= 512 THEN 1 ELSE CAST(ceil((len(w) - 512) / 448.0) AS BIGINT) + 1 END)) AS i FROM t WHERE len(w) > 0)
SELECT doc_id, count(*) AS chunks, sha256(string_agg(array_to_string(w[i * 448 + 1:i * 448 + 512], ' '), chr(10) ORDER BY i)) AS sha256 FROM c GROUP BY 1""",
)
def chunks_to_documents(spark, sf_dir):
    """The whole contents of every document's chunks, in order."""
    pieces = chunk_windows(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("p"))
    return pieces.select("doc_id", F.size("p").cast("long").alias("chunks"), F.sha2(F.array_join(F.transform("p", lambda x: x["content"]), "\n"), 256).alias("sha256"))


@query("documents_from_chunks", f"WITH t AS (SELECT doc_id, {_W} AS w FROM documents) SELECT doc_id, array_to_string(w, ' ') AS content FROM t WHERE len(w) > 0")
def documents_from_chunks(spark, sf_dir):
    """Whole documents put together again from their chunks, each without the words it shares with the one before."""
    own = F.when(F.col("chunk_index") == 0, F.col("content")).otherwise(F.array_join(F.slice(F.split("content", " "), 65, 512), " "))
    pieces = chunk_windows(spark, sf_dir).select("doc_id", F.struct("chunk_index", own.alias("own")).alias("piece"))
    joined = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list("piece")).alias("p"))
    return joined.select("doc_id", F.array_join(F.transform("p", lambda x: x["own"]), " ").alias("content"))


@query(
    "query_terms",
    rf"""
WITH e AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_-]{{2,}}')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_-]{{2,}}'), 1) AS i FROM benchmark),
d AS (SELECT item_id, lower(w) AS w, min(i) AS i FROM e WHERE lower(w) NOT IN ({', '.join(repr(w) for w in classify.STOPWORDS)}) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, i) AS r FROM d)
SELECT item_id, string_agg(w, ' ' ORDER BY r) AS terms FROM r WHERE r <= 6 GROUP BY 1""",
)
def query_terms(spark, sf_dir):
    """The six longest terms of each passage."""
    found = text.longest(text.terms(F.col("text"), classify.STOPWORDS), 6)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(found, " ").alias("terms")).where("terms <> ''")


_HREF = """list_distinct(regexp_extract_all(html, '<a[^>]* href="([^"]*)"', 1))"""


@query(
    "page_links",
    f"""
SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS url, len({_HREF}) AS n_links,
  trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages""",
)
def page_links(spark, sf_dir):
    """Host, normalised URL, number of links and title of every page."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.url_host(F.col("url")).alias("host"),
        text.normalised_url(F.col("url")).alias("url"),
        F.size(text.hrefs(F.col("html"))).cast("long").alias("n_links"),
        F.coalesce(text.title(F.col("html")), F.lit("")).alias("title"),
    )


_TO = r"list_transform(regexp_extract_all(html, '<a[^>]* href=\"([^\"]*)\"', 1), lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN x ELSE regexp_extract(url, '^https?://[^/?#]+') || x END)"


@query(
    "page_site_links",
    rf"""
WITH l AS (SELECT page_id, url, unnest({_TO} || list_transform(range(1, 4), lambda i: regexp_extract(url, '^https?://[^/?#]+') || '/up' || i)) AS link FROM pages),
n AS (SELECT DISTINCT page_id, url, regexp_replace(regexp_replace(link, '#.*$', ''), '/+$', '') AS link FROM l)
SELECT page_id, link FROM n WHERE regexp_matches(link, '^https?://') AND lower(regexp_extract(link, '^https?://([^/?#]+)', 1)) = lower(regexp_extract(url, '^https?://([^/?#]+)', 1))""",
)
def page_site_links(spark, sf_dir):
    """Links of every page within its site, with three more of a Markdown text that climbs to the root."""
    climbed = F.lit("# Up\n[a](" + "../" * 9 + "up1/) and [b](" + "../" * 9 + "x/./../up2#part), [c](/y/../up3)")
    found = F.concat(text.html_references(F.col("html")), text.markdown_references(climbed))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.site_links(found, F.col("url"))).alias("link"))


@query(
    "page_filter",
    r"""
SELECT page_id, url FROM pages WHERE regexp_extract(url, '^https?://([^/?#]+)', 1) <> ''
  AND NOT regexp_matches(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2[0-9]|3[01])\.)')
  AND regexp_matches(url, '/(en|de)/') AND NOT regexp_matches(url, 'page=')""",
)
def page_filter(spark, sf_dir):
    """Public pages that match what is to be crawled."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").where(text.public_url(url) & url.rlike("/(en|de)/") & ~url.rlike("page=")).select("page_id", "url")


@query(
    "page_markup_text",
    r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '</?(ac|ri):[^>]*>', '', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""",
)
def page_markup_text(spark, sf_dir):
    """Plain text of the pages taken as storage-format markup."""
    return table(spark, sf_dir, "pages").select("page_id", text.markup_text(F.col("html")).alias("text"))


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_T = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"
_PADDED = f"(' ' || array_to_string({_T}, ' ') || ' ')"


def _hits(hints):
    return "(" + " + ".join(f"CAST(contains({_PADDED}, ' {h} ') AS INT)" for h in hints) + ")"


@query(
    "classify_turns",
    f"""
WITH t AS (SELECT conv_id, turn, len({_T}) AS n, {_hits(classify.RELATIONAL)} > 0 AS rel, {_hits(classify.SEMANTIC)} > 0 AS sem, {_hits(classify.HYBRID)} > 0 AS hyb, {_hits(classify.COMPLEX)} AS hard FROM conversations),
p AS (SELECT *, CASE WHEN n > 60 THEN 2 WHEN n > 25 THEN 1 ELSE 0 END + least(3, hard) AS points FROM t)
SELECT conv_id, turn, CASE WHEN (rel AND sem) OR (hyb AND (rel OR sem)) THEN 'hybrid' WHEN rel THEN 'graph' ELSE 'vector' END AS strategy,
  CASE WHEN points >= 5 THEN 'complex' WHEN points <= 2 THEN 'simple' ELSE 'medium' END AS complexity FROM p""",
)
def classify_turns(spark, sf_dir):
    """Retrieval strategy and model complexity for every turn."""
    said = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", classify.strategy(said).alias("strategy"), classify.complexity(said).alias("complexity"))


def _matches(patterns):
    return "(" + " + ".join(f"CAST(regexp_matches(q, '(?i){p}') AS INT)" for p in patterns) + ")"


@query(
    "route_questions",
    rf"""
WITH t AS (SELECT conv_id, turn, text AS q FROM conversations WHERE role = 'user' UNION ALL SELECT -1 - item_id, 0, CASE item_id % 4 WHEN 0 THEN 'What are the main themes of ' WHEN 1 THEN 'Who is the author of ' WHEN 2 THEN 'Compare all trends, and when was ' ELSE '' END || text FROM benchmark),
m AS (SELECT conv_id, turn, {_matches(classify.GLOBAL)} AS wide, {_matches(classify.LOCAL)} AS narrow FROM t),
s AS (SELECT *, wide / nullif(wide + narrow, 0) AS share FROM m)
SELECT conv_id, turn, CASE WHEN share >= 0.7 THEN 'global' WHEN share <= 0.3 THEN 'local' ELSE 'hybrid' END AS route,
  round(CASE WHEN share IS NULL THEN 0.3 WHEN share >= 0.7 THEN least(0.9, 0.6 + share * 0.3) WHEN share <= 0.3 THEN least(0.9, 0.6 + (1 - share) * 0.3) ELSE 0.6 END, 6) AS confidence FROM s""",
)
def route_questions(spark, sf_dir):
    """Whether each user turn, and each of some questions about passages, is about the corpus or about one thing."""
    kind, confidence = classify.route(F.col("text"))
    k = F.col("item_id") % 4
    lead = F.when(k == 0, "What are the main themes of ").when(k == 1, "Who is the author of ").when(k == 2, "Compare all trends, and when was ").otherwise("")
    asked = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.concat(lead, "text").alias("text"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text").union(asked).select("conv_id", "turn", kind.alias("route"), F.round(confidence, 6).alias("confidence"))


_L = {k: f"len(list_intersect({_T}, {_list(v)}))" for k, v in classify.MARKERS.items()}


@query(
    "classify_language",
    f"""
WITH t AS (SELECT doc_id, {', '.join(f'{v} AS l_{k}' for k, v in _L.items())} FROM documents), b AS (SELECT *, greatest({', '.join(f'l_{k}' for k in _L)}) AS best FROM t)
SELECT doc_id, CASE {' '.join(f"WHEN l_{k} = best THEN '{k}'" for k in _L)} END AS language,
  round(CASE WHEN best = 0 THEN 0.3 ELSE least(1.0, best / 5.0) END, 6) AS confidence FROM b""",
)
def classify_language(spark, sf_dir):
    """Language of every document by marker words."""
    lang, confidence = classify.language(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", lang.alias("language"), F.round(confidence, 6).alias("confidence"))


_S = {k: f"length(regexp_replace(text, '[^{c}]', '', 'g'))" for k, c in classify.SCRIPTS.items()}


@query(
    "classify_script",
    rf"""
WITH t AS (SELECT doc_id, text, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters, {', '.join(f'{v} AS s_{k}' for k, v in _S.items())} FROM documents),
b AS (SELECT *, greatest({', '.join(f's_{k}' for k in _S)}) AS best FROM t), c AS (SELECT *, coalesce(best / nullif(letters, 0), 0) AS share FROM b)
SELECT doc_id, CASE WHEN share > 0.3 THEN CASE {' '.join(f"WHEN s_{k} = best THEN '{k}'" for k in _S)} END END AS script,
  round(CASE WHEN share > 0.3 THEN least(1.0, share * 1.5) ELSE 0 END, 6) AS confidence,
  round(0.5 + 0.5 * greatest(0.0, least(1.0, (length(text) - 50) / 1950.0)), 6) AS grade FROM c""",
)
def classify_script(spark, sf_dir):
    """Dominant script and a grade by length of every document."""
    kind, confidence = classify.script(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", kind.alias("script"), F.round(confidence, 6).alias("confidence"), F.round(classify.length_grade(F.length("text")), 6).alias("grade"))


@query(
    "incremental_listing",
    "SELECT d.doc_id FROM documents d LEFT JOIN labels s USING (doc_id) WHERE d.n_chars IS NULL OR s.doc_id IS NULL OR s.quality <> d.n_chars % 2",
)
def incremental_listing(spark, sf_dir):
    """Items whose tag is not that of the state table."""
    state = table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = docs(spark, sf_dir).join(state, "doc_id", "left")
    return joined.where(F.col("n_chars").isNull() | ~F.col("quality").eqNullSafe(F.col("n_chars") % 2)).select("doc_id")


@query(
    "sync_runs",
    """
SELECT source, count(*) AS found, count(l.quality) AS synced, count(*) - count(l.quality) AS failed,
  CASE WHEN count(l.quality) = count(*) THEN 'COMPLETED' WHEN count(l.quality) > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""",
)
def sync_runs(spark, sf_dir):
    """Found, synced and failed items and the state of each source's run."""
    joined = docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    n, done = F.count(F.lit(1)), F.count("quality")
    return joined.groupBy("source").agg(n.alias("found"), done.alias("synced"), (n - done).alias("failed"), F.when(done == n, "COMPLETED").when(done > 0, "PARTIAL").otherwise("FAILED").alias("status"))


@query("names_by_group", "SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 25")
def names_by_group(spark, sf_dir):
    """The 25 longest documents of each language."""
    order = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return docs(spark, sf_dir).select("lang", "doc_id", F.row_number().over(order).alias("r")).where("r <= 25").drop("r")

"""Rules on strings: ids, paths, dependencies, tables, sections, prompts and tolerant JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import keyed, markup, text
from lodestone.operators import chunking
from lodestone.plans.registry import query
from lodestone.plans.text import docs
from lodestone.sources import files, table

_W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@query("table_ids", "SELECT doc_id, substring(sha256(lang || ':' || doc_id || ':table:' || source), 1, 32) AS id FROM documents")
def table_ids(spark, sf_dir):
    """Ids of tables from what they belong to."""
    return docs(spark, sf_dir).select("doc_id", F.substring(F.sha2(F.concat_ws(":", "lang", F.col("doc_id").cast("string"), F.lit("table"), "source"), 256), 1, 32).alias("id"))


@query("cache_keys", "WITH i AS (SELECT conv_id, list_sort(list(CAST(turn AS VARCHAR))) AS ids, min(text) AS q FROM conversations GROUP BY 1) SELECT conv_id, sha256(array_to_string(ids, '|') || chr(10) || q) AS key FROM i")
def cache_keys(spark, sf_dir):
    """Cache key of each conversation's ids and question."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.col("turn").cast("string")).alias("ids"), F.min("text").alias("q"))
    return rows.select("conv_id", F.sha2(F.concat_ws("\n", F.array_join(F.array_sort("ids"), "|"), "q"), 256).alias("key"))


#: Rules of which profile fits a domain: whole domains first, then ends, then beginnings.
PROFILES = [("exact", "example.org", "stealth"), ("suffix", ".example.net", "fast"), ("prefix", "docs.", "fast"), ("prefix", "www.", "thorough"), ("prefix", "blog.", "fast")]
_HOST = "lower(regexp_extract(url, '^https?://([^/?#]+)', 1))"


@query(
    "crawl_profiles",
    f"""
WITH r(kind, pattern, profile, place) AS (VALUES {', '.join(f"('{k}', '{p}', '{x}', {i})" for i, (k, p, x) in enumerate(PROFILES))}),
h AS (SELECT page_id, {_HOST} AS host FROM pages),
m AS (SELECT page_id, arg_min(profile, place) AS profile FROM h JOIN r ON (kind = 'exact' AND (host = pattern OR ends_with(host, '.' || pattern))) OR (kind = 'suffix' AND ends_with(host, pattern)) OR (kind = 'prefix' AND starts_with(host, pattern)) GROUP BY 1)
SELECT h.page_id, host, coalesce(profile, 'thorough') AS profile FROM h LEFT JOIN m ON m.page_id = h.page_id""",
)
def crawl_profiles(spark, sf_dir):
    """How each page's domain is crawled."""
    host = F.lower(text.url_host(F.col("url")))
    fits = {"exact": lambda p: (host == p) | host.endswith("." + p), "suffix": lambda p: host.endswith(p), "prefix": lambda p: host.startswith(p)}
    rules = [F.when(fits[kind](pattern), F.lit(profile)) for kind, pattern, profile in PROFILES]
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.coalesce(*rules, F.lit("thorough")).alias("profile"))


_GRID = "g AS (SELECT l_orderkey AS id, list([CAST(l_linenumber AS VARCHAR), l_returnflag || '|' || l_linestatus, CAST(CAST(l_quantity AS INT) AS VARCHAR)] ORDER BY l_linenumber, l_returnflag || '|' || l_linestatus, CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS rows FROM lineitem GROUP BY 1)"


def _tables(spark, sf_dir):
    """One table of cells for each order."""
    cells = F.array(F.col("l_linenumber").cast("string"), F.concat_ws("|", "l_returnflag", "l_linestatus"), F.col("l_quantity").cast("int").cast("string"))
    key = F.struct("l_linenumber", cells.alias("c"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(key)).alias("k"))
    return rows.select("id", F.transform("k", lambda x: x["c"]).alias("rows"))


_HEADERS = ("line", "flags", "quantity")
_LINES = r"list_transform(rows, lambda r: '| ' || array_to_string(list_transform(r, lambda c: replace(c, '|', '\|')), ' | ') || ' |')"


@query("table_markdown", f"WITH {_GRID} SELECT id, '| line | flags | quantity |' || chr(10) || '|---|---|---|' || chr(10) || array_to_string({_LINES}, chr(10)) AS content FROM g")
def table_markdown(spark, sf_dir):
    """Every order's lines as a Markdown table."""
    return _tables(spark, sf_dir).select("id", markup.table_markdown(F.array(*map(F.lit, _HEADERS)), F.col("rows")).alias("content"))


@query(
    "table_chunks",
    f"""
WITH {_GRID}, s AS (SELECT id, len(rows) AS n, unnest(range(0, len(rows), 3)) AS first, rows FROM g),
c AS (SELECT id, n, first, rows[first + 1:first + 3] AS rows FROM s)
SELECT id, CAST(first // 3 AS INTEGER) AS chunk_index, substring(sha256('t:' || id || ':chunk:' || (first // 3)), 1, 32) AS chunk_id,
  CASE WHEN n <= 3 THEN '**Order ' || id || '**' || chr(10) ELSE '**Order ' || id || ' (rows ' || (first + 1) || '-' || (first + len(rows)) || ')**' || chr(10) END
  || chr(10) || '| line | flags | quantity |' || chr(10) || '|---|---|---|' || chr(10) || array_to_string({_LINES}, chr(10)) AS content FROM c""",
)
def table_chunks(spark, sf_dir):
    """Tables in chunks of at most three rows, each with the headers and a caption that says which rows."""
    sliced = _tables(spark, sf_dir).select("id", F.size("rows").alias("n"), F.explode(markup.row_slices(F.col("rows"), 3)).alias("s")).select("id", "n", "s.first", "s.rows")
    which = F.when(F.col("n") <= 3, "").otherwise(F.concat(F.lit(" (rows "), F.col("first") + 1, F.lit("-"), F.col("first") + F.size("rows"), F.lit(")")))
    caption = F.concat(F.lit("Order "), "id", which)
    index = F.floor(F.col("first") / 3).cast("int")
    key = F.concat(F.lit("t:"), "id", F.lit(":chunk:"), index)
    return sliced.select("id", index.alias("chunk_index"), F.substring(F.sha2(key, 256), 1, 32).alias("chunk_id"), markup.table_markdown(F.array(*map(F.lit, _HEADERS)), F.col("rows"), caption).alias("content"))


@query(
    "row_maps",
    f"WITH {_GRID}, e AS (SELECT id, unnest(rows) AS r, generate_subscripts(rows, 1) AS i FROM g) SELECT id, CAST(i AS INTEGER) AS row, r[1] AS line, r[2] AS flags, r[3] AS quantity, '' AS note FROM e",
)
def row_maps(spark, sf_dir):
    """Cells by header; a header without a cell is empty."""
    maps = markup.row_maps(F.array(*map(F.lit, (*_HEADERS, "note"))), F.col("rows"))
    rows = _tables(spark, sf_dir).select("id", F.posexplode(maps).alias("i", "m"))
    return rows.select("id", (F.col("i") + 1).alias("row"), *(F.col("m")[h].alias(h) for h in (*_HEADERS, "note")))


@query(
    "dense_grids",
    """
WITH c AS (SELECT user_id AS grid, CAST(event_id % 4 AS INT) AS r, CAST(event_id % 3 AS INT) AS k, min(event_id) AS v FROM events WHERE event_id % 5 <> 0 GROUP BY 1, 2, 3),
g AS (SELECT grid, max(r) AS rows, max(k) AS cols FROM c GROUP BY 1),
f AS (SELECT grid, r, unnest(range(cols + 1)) AS k FROM (SELECT grid, cols, unnest(range(rows + 1)) AS r FROM g))
SELECT f.grid, CAST(f.r AS INT) AS r, string_agg(coalesce(CAST(v AS VARCHAR), ''), ',' ORDER BY f.k) AS cells FROM f LEFT JOIN c ON c.grid = f.grid AND c.r = f.r AND c.k = f.k GROUP BY 1, 2""",
)
def dense_grids(spark, sf_dir):
    """Sparse cells as whole rows, empty where there is none."""
    e = F.col("event_id")
    cells = table(spark, sf_dir, "events").where(e % 5 != 0).groupBy(F.col("user_id").alias("grid"), (e % 4).cast("int").alias("r"), (e % 3).cast("int").alias("k")).agg(F.min(e).cast("string").alias("v"))
    rows = cells.groupBy("grid", "r").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("cells"))
    size = cells.groupBy("grid").agg(F.max("r").alias("rows"), F.max("k").alias("cols"))
    full = size.select("grid", "cols", F.explode(F.sequence(F.lit(0), "rows")).alias("r")).join(rows, ["grid", "r"], "left")
    dense = F.transform(F.sequence(F.lit(0), "cols"), lambda k: F.coalesce(F.element_at("cells", k), F.lit("")))
    return full.select("grid", "r", F.array_join(dense, ",").alias("cells"))


@query("slides_markdown", "SELECT page_id, '## Slide ' || page_id || ': ' || coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), 'Untitled') || chr(10) || chr(10) || '**Notes:** ' || length(html) || ' characters' AS content FROM pages")
def slides_markdown(spark, sf_dir):
    """Slides with title and notes."""
    title = F.trim(F.coalesce(text.title(F.col("html")), F.lit("")))
    named = F.when(title == "", "Untitled").otherwise(title)
    head = F.concat(F.lit("## Slide "), "page_id", F.lit(": "), named)
    return table(spark, sf_dir, "pages").select("page_id", F.concat_ws("\n\n", head, F.concat(F.lit("**Notes:** "), F.length("html"), F.lit(" characters"))).alias("content"))


@query(
    "prompts_built",
    """
SELECT conv_id, turn, CASE WHEN turn = 0 THEN '' ELSE 'You answer from evidence.' || chr(10) || chr(10) END || 'Question: ' || text
  || CASE WHEN length(text) > 100 THEN chr(10) || chr(10) || 'Evidence: ' || rtrim(substring(text, 1, 100), ' ') || '...' ELSE '' END AS prompt FROM conversations WHERE role = 'user'""",
)
def prompts_built(spark, sf_dir):
    """Prompts of the sections that there are."""
    rules = F.when(F.col("turn") != 0, "You answer from evidence.")
    evidence = F.when(F.length("text") > 100, F.concat(F.lit("Evidence: "), text.truncated(F.col("text"), 100)))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat_ws("\n\n", rules, F.concat(F.lit("Question: "), "text"), evidence).alias("prompt"))


@query(
    "summaries_parsed",
    f"""
WITH r AS (SELECT doc_id, 'Here it is.' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'SUMMARY: about ' || source || chr(10) END || 'KEYWORDS: ' || lang || ', ,' || array_to_string({_W}[1:3], ' , ') AS x FROM documents),
l AS (SELECT doc_id, string_split(trim(x), chr(10)) AS lines FROM r),
k AS (SELECT doc_id, list_filter(lines, lambda s: starts_with(s, 'SUMMARY:')) AS s, list_filter(lines, lambda s: starts_with(s, 'KEYWORDS:')) AS w FROM l)
SELECT doc_id, CASE WHEN len(s) = 0 THEN 'A community of related entities' ELSE trim(replace(s[-1], 'SUMMARY:', '')) END AS summary,
  array_to_string(list_filter(list_transform(string_split(replace(w[-1], 'KEYWORDS:', ''), ','), lambda t: trim(t)), lambda t: t <> ''), '|') AS keywords FROM k""",
)
def summaries_parsed(spark, sf_dir):
    """Summary and keywords out of replies."""
    line = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("SUMMARY: about "), "source", F.lit("\n"))).otherwise("")
    words = F.array_join(F.slice(text.words(F.col("text")), 1, 3), " , ")
    reply = F.concat(F.lit("Here it is.\n"), line, F.lit("KEYWORDS: "), "lang", F.lit(", ,"), words)
    return docs(spark, sf_dir).select("doc_id", markup.summary(reply).alias("summary"), F.array_join(markup.keywords(reply), "|").alias("keywords"))


@query(
    "paths_normal",
    r"""
WITH p AS (SELECT page_id, ['/', '', './././', '\\'][CAST(1 + page_id % 4 AS INT)] || regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '^/', '') || '\\x' || page_id || '.py' AS path FROM pages),
n AS (SELECT page_id, regexp_replace(replace(regexp_replace(path, '^[/\\]+', ''), '\', '/'), '^(\./)+', '') AS path FROM p)
SELECT page_id, path, string_split(path, '/')[-1] AS name FROM n""".replace("'\\\\'", "'\\'").replace("'\\\\x'", "'\\x'"),
)
def paths_normal(spark, sf_dir):
    """Paths in one way of writing, and their last part."""
    lead = F.get(F.array(*map(F.lit, ("/", "", "./././", "\\"))), (F.col("page_id") % 4).cast("int"))
    inner = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1), "^/", "")
    path = markup.normal_path(F.concat(lead, inner, F.lit("\\x"), "page_id", F.lit(".py")))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), markup.base_name(path).alias("name"))


_REQUIREMENTS = ["{}=={}.0", "# {} {}", "{}[extra]>={}", "-r {}{}.txt", "{} ; python_version > '{}'", "{} @ https://x.example/{}", "-e {}~={}", "  "]


@query(
    "dependencies",
    f"""
WITH l AS (SELECT p_partkey, CASE p_partkey % 8 {' '.join(f"WHEN {i} THEN replace(replace('{r.replace(chr(39), chr(39) * 2)}', '{{}}', '@@'), '@@', 'p' || p_size)" for i, r in enumerate(_REQUIREMENTS))} END AS line FROM part),
e AS (SELECT p_partkey, line, trim(split_part(trim(regexp_replace(trim(line), '^-e ', '')), ';', 1)) AS entry FROM l),
u AS (SELECT p_partkey, line, CASE WHEN contains(entry, '@') AND contains(entry, '://') THEN trim(split_part(entry, '@', 1)) ELSE entry END AS entry FROM e)
SELECT p_partkey, CASE WHEN regexp_matches(trim(line), '^(#|-r|--)') THEN NULL ELSE nullif(trim(regexp_replace(split_part(entry, '[', 1), '(==|>=|<=|!=|~=|>|<).*$', '')), '') END AS package FROM u""",
)
def dependencies(spark, sf_dir):
    """Package names of requirement lines."""
    name = F.concat(F.lit("p"), "p_size")
    lines = [F.replace(F.lit(r), F.lit("{}"), name) for r in _REQUIREMENTS]
    line = F.get(F.array(*lines), (F.col("p_partkey") % 8).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", markup.requirement(line).alias("package"))


@query(
    "proxies_masked",
    """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'http://***:***@host' || s_suppkey || ':8080' WHEN s_suppkey % 3 = 1 THEN 'socks5://host' || s_suppkey || '/path' ELSE 'https://***:***@h.example' END AS proxy FROM supplier""",
)
def proxies_masked(spark, sf_dir):
    """Proxies without credentials."""
    k = F.col("s_suppkey")
    url = F.when(k % 3 == 0, F.concat(F.lit("http://user:secret@HOST"), k, F.lit(":8080/x"))).when(k % 3 == 1, F.concat(F.lit("socks5://host"), k, F.lit("/path"))).otherwise(F.lit("https://user@h.example"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", markup.masked_proxy(url).alias("proxy"))


@query("tokens_cut", f"SELECT doc_id, CASE WHEN len({_W}) <= 30 THEN text ELSE array_to_string({_W}[1:30], ' ') || '... [truncated]' END AS content FROM documents")
def tokens_cut(spark, sf_dir):
    """Documents cut after thirty words."""
    return docs(spark, sf_dir).select("doc_id", markup.cut_words(F.col("text"), 30).alias("content"))


@query("cron_fields", "SELECT s_suppkey, CAST(s_suppkey % 60 AS VARCHAR) AS minute, CAST(s_suppkey % 24 AS VARCHAR) AS hour, '*' AS day, '*' AS month, CAST(s_suppkey % 7 AS VARCHAR) AS day_of_week FROM supplier WHERE s_suppkey % 9 <> 0")
def cron_fields(spark, sf_dir):
    """Schedules by field; those without exactly five are left out."""
    k = F.col("s_suppkey")
    cron = F.concat_ws("  ", k % 60, k % 24, F.lit("*"), F.when(k % 9 != 0, "*"), k % 7)
    fields = F.split(F.trim(cron), r"\s+")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", fields.alias("f")).where(F.size("f") == 5)
    return rows.select("s_suppkey", *(F.col("f")[i].alias(n) for i, n in enumerate(("minute", "hour", "day", "month", "day_of_week"))))


@query(
    "bloom_sizes",
    "SELECT source, count(*) AS items, CAST(ceil(-count(*) * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS bits, CAST(greatest(1, round(ceil(-count(*) * ln(0.01) / (ln(2) * ln(2))) / count(*) * ln(2))) AS BIGINT) AS hashes FROM documents GROUP BY 1",
)
def bloom_sizes(spark, sf_dir):
    """Bits and hash functions of a filter of each source's documents at one per cent of false hits."""
    n = F.col("items")
    bits = F.ceil(-n * F.log(F.lit(0.01)) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0))))
    sized = docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("items")).withColumn("bits", bits.cast("long"))
    return sized.withColumn("hashes", F.greatest(F.lit(1), F.round(F.col("bits") / n * F.log(F.lit(2.0)))).cast("long"))


@query("speech_seconds", f"SELECT doc_id, round(len({_W}) / CAST(150 AS DOUBLE) * 60 / 1.25, 3) AS seconds FROM documents")
def speech_seconds(spark, sf_dir):
    """How long documents take to be read aloud."""
    return docs(spark, sf_dir).select("doc_id", F.round(F.size(text.words(F.col("text"))) / 150.0 * 60 / 1.25, 3).alias("seconds"))


@query(
    "as_of_checked",
    """
SELECT o_orderkey, o_orderdate <= TIMESTAMP '1998-06-30 00:00:00' + INTERVAL 5 MINUTE AS as_of_valid, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 3 - 1) > o_orderdate AS range_valid FROM orders""",
)
def as_of_checked(spark, sf_dir):
    """Whether a point in time is not in the future, five minutes allowed, and a range ends after it begins."""
    at = F.col("o_orderdate")
    end = F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 3 - 1 AS int))")
    return table(spark, sf_dir, "orders").select("o_orderkey", (at <= F.expr("TIMESTAMP_NTZ '1998-06-30 00:05:00'")).alias("as_of_valid"), (end > at).alias("range_valid"))


@query(
    "section_chunks",
    f"""
WITH p AS (SELECT doc_id, text, {_W} AS w, '## ' || source || chr(10) || chr(10) || text AS whole FROM documents),
n AS (SELECT doc_id, list_filter(regexp_split_to_array(whole, '\\s+'), lambda x: x <> '') AS w, whole FROM p),
c AS (SELECT doc_id, w, whole, unnest(range(CASE WHEN len(w) <= 512 THEN 1 ELSE CAST(ceil((len(w) - 512) / 448.0) AS BIGINT) + 1 END)) AS i FROM n)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(least(512, len(w) - i * 448) AS INTEGER) AS tokens, CASE WHEN len(w) <= 512 THEN regexp_replace(regexp_replace(whole, '^\\s+', ''), '\\s+$', '') ELSE array_to_string(w[i * 448 + 1:i * 448 + 512], ' ') END AS content FROM c""",
)
def section_chunks(spark, sf_dir):
    """Sections under their heading, whole where they fit into a chunk."""
    whole = markup.section_text(F.col("source"), F.col("text"))
    rows = docs(spark, sf_dir).select("doc_id", whole.alias("whole"))
    chunks = chunking.windows(rows, ["doc_id"], F.col("whole"), 512, 64)
    # a section that fits is kept as it is, its white space too
    single = chunks.groupBy("doc_id").agg(F.max("chunk_index").alias("last")).where("last = 0").join(rows, "doc_id").select("doc_id", F.regexp_replace(F.regexp_replace("whole", r"^\s+", ""), r"\s+$", "").alias("kept"))
    return chunks.join(single, "doc_id", "left").select("doc_id", "chunk_index", "tokens", F.coalesce("kept", "content").alias("content"))


@query(
    "chunks_with_context",
    """
SELECT doc_id, 'Document: ' || source || CASE WHEN doc_id % 4 = 0 THEN '' ELSE chr(10) || chr(10) || 'Context: in ' || lang END || chr(10) || chr(10) || text AS content FROM documents""",
)
def chunks_with_context(spark, sf_dir):
    """Chunks below the name of their document and the context that was written for them, where there is any."""
    context = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("Context: in "), "lang"))
    return docs(spark, sf_dir).select("doc_id", F.concat_ws("\n\n", F.concat(F.lit("Document: "), "source"), context, "text").alias("content"))


@query(
    "overlaps_merged",
    """
WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS after FROM conversations),
q AS (SELECT conv_id, turn, text AS a, CASE WHEN turn % 2 = 0 THEN substring(text, 11) || ' ' || after ELSE after END AS b FROM p WHERE after IS NOT NULL),
o AS (SELECT *, list_max(list_filter(range(0, least(length(a), length(b), 2000) + 1), lambda n: right(a, n) = left(b, n))) AS n FROM q)
SELECT conv_id, turn, n AS overlap, trim(CASE WHEN n > 0 THEN a || substring(b, n + 1) ELSE a || ' ' || b END) AS merged FROM o""",
)
def overlaps_merged(spark, sf_dir):
    """Neighbouring pieces joined without what the one ends and the other begins with."""
    from pyspark.sql import Window

    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    pairs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", after.alias("after")).where("after IS NOT NULL")
    pairs = pairs.select("conv_id", "turn", F.col("text").alias("a"), F.when(F.col("turn") % 2 == 0, F.concat(F.expr("substring(text, 11)"), F.lit(" "), "after")).otherwise(F.col("after")).alias("b"))
    sized = pairs.withColumn("n", markup.overlap(F.col("a"), F.col("b"), 2000))
    merged = F.when(F.col("n") > 0, F.concat("a", F.expr("substring(b, n + 1)"))).otherwise(F.concat_ws(" ", "a", "b"))
    return sized.select("conv_id", "turn", F.col("n").cast("long").alias("overlap"), F.trim(merged).alias("merged"))


@query(
    "metadata_parsed",
    """
WITH m AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"title": "t' || event_id || '", "page_count": ' || (event_id % 7 - 2) || '}' WHEN 1 THEN '{"title": 5, "page_count": "x"}' WHEN 2 THEN 'not json' ELSE props END AS raw FROM events),
v AS (SELECT event_id, CASE WHEN json_valid(raw) THEN raw END AS raw FROM m)
SELECT event_id, CASE WHEN json_type(raw, '$.title') = 'VARCHAR' THEN json_extract_string(raw, '$.title') END AS title,
  CASE WHEN json_type(raw, '$.page_count') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract_string(raw, '$.page_count') AS BIGINT) >= 0 THEN CAST(json_extract_string(raw, '$.page_count') AS BIGINT) END AS page_count FROM v""",
)
def metadata_parsed(spark, sf_dir):
    """Metadata read field by field: what has the wrong type is left out, what is no JSON is empty."""
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, F.concat(F.lit('{"title": "t'), e, F.lit('", "page_count": '), e % 7 - 2, F.lit("}"))).when(e % 4 == 1, '{"title": 5, "page_count": "x"}').when(e % 4 == 2, "not json").otherwise(F.col("props"))
    parsed = F.try_parse_json(raw)
    title, pages = F.try_variant_get(parsed, "$.title", "string"), F.try_variant_get(parsed, "$.page_count", "long")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    return table(spark, sf_dir, "events").select("event_id", F.when(kind("$.title") == "STRING", title).alias("title"), F.when((kind("$.page_count") == "BIGINT") & (pages >= 0), pages).alias("page_count"))


@query(
    "pricing_parsed",
    """
SELECT 'm' || p_partkey AS model, CAST(p_retailprice AS DECIMAL(18,9))::DOUBLE AS input_per_1k, CAST(p_size AS DOUBLE) AS output_per_1k FROM part WHERE p_partkey % 5 = 0 AND p_retailprice IS NOT NULL AND p_size IS NOT NULL
UNION ALL SELECT 'm' || p_partkey, 0.0, 2.0 FROM part WHERE p_partkey % 5 = 4""",
)
def pricing_parsed(spark, sf_dir):
    """Prices out of settings; entries that are no prices, or negative, are passed over."""
    k = F.col("p_partkey")
    pair = lambda a, b: F.concat(F.lit('{"input_per_1k": '), a, F.lit(', "output_per_1k": '), b, F.lit("}"))
    forms = (pair(F.concat(F.lit('"'), F.col("p_retailprice").cast("decimal(18,9)"), F.lit('"')), F.col("p_size")), pair(F.lit('"-1"'), F.col("p_size")), F.lit("7"), pair(F.lit('"x"'), F.lit("1")), pair(F.lit("0"), F.lit("2")))
    setting = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), k).alias("model"), F.get(F.array(*forms), (k % 5).cast("int")).alias("value"))
    rows = setting.select("model", *(F.expr(f"try_cast(get_json_object(value, '$.{c}') AS decimal(18,9))").alias(c) for c in ("input_per_1k", "output_per_1k")))
    return rows.where("input_per_1k >= 0 AND output_per_1k >= 0").select("model", F.col("input_per_1k").cast("double").alias("input_per_1k"), F.col("output_per_1k").cast("double").alias("output_per_1k"))


@query("messages_decoded", "WITH m AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE 'plain ' || event_type END AS raw FROM events) SELECT event_id, json_valid(raw) AS is_json, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.k') ELSE raw END AS value FROM m")
def messages_decoded(spark, sf_dir):
    """Messages as JSON where they are, else as they are."""
    raw = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("plain "), "event_type"))
    parsed = F.try_parse_json(raw)
    return table(spark, sf_dir, "events").select("event_id", parsed.isNotNull().alias("is_json"), F.when(parsed.isNotNull(), F.try_variant_get(parsed, "$.k", "string")).otherwise(raw).alias("value"))


@query(
    "metadata_merged",
    """
SELECT event_id, to_json(map_from_entries(list_sort(map_entries(map_concat(map(['k', 'source'], [json_extract_string(props, '$.k'), 'old']), map(['source', 'type'], ['new', event_type])))))) AS metadata FROM events""",
)
def metadata_merged(spark, sf_dir):
    """Two maps as one, in which the later wins."""
    old = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("source"), F.lit("old"))
    new = F.create_map(F.lit("source"), F.lit("new"), F.lit("type"), F.col("event_type"))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))  # no duplicates, so no session setting decides
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, new))))).alias("metadata"))


@query("video_ids", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE substring(md5(CAST(event_id AS VARCHAR)), 1, 11) END AS video FROM events")
def video_ids(spark, sf_dir):
    """Ids out of four ways of writing a video's address; null where there is none."""
    own = F.substring(F.md5(F.col("event_id").cast("string")), 1, 11)
    forms = [("https://www.youtube.com/watch?v=", "&t=3"), ("https://youtu.be/", "?x=1"), ("https://www.youtube.com/embed/", ""), ("https://www.youtube.com/shorts/", "/"), ("https://example.com/", "")]
    url = F.get(F.array(*(F.concat(F.lit(a), own, F.lit(b)) for a, b in forms)), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", files.video_id(url).alias("video"))


@query(
    "file_types",
    f"""
WITH f AS (SELECT p_partkey, 'Report.v2.' || ['PDF', 'docx', 'xlsx', 'md', 'exe', 'txt'][CAST(1 + p_partkey % 6 AS INT)] AS name FROM part)
SELECT p_partkey, name, coalesce(map({[*files.KINDS]}, {[*files.KINDS.values()]})[lower(regexp_extract(name, '\\.([^.]+)$', 1))], 'unknown') AS type FROM f""",
)
def file_types(spark, sf_dir):
    """Kinds of files by the extension of their names."""
    ends = F.array(*map(F.lit, ("PDF", "docx", "xlsx", "md", "exe", "txt")))
    name = F.concat(F.lit("Report.v2."), F.get(ends, (F.col("p_partkey") % 6).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), files.kind(name, F.lit("")).alias("type"))


_TRACE_KEY = bytes(range(32))


@query(
    "traces_sealed",
    """
SELECT conv_id, turn, sha256(text) AS opened_sha256, '<encrypted: InvalidTag>' AS by_another, CAST(ceil((28 + strlen(text)) * 4 / 3.0) AS BIGINT) AS least_chars, true AS safe FROM conversations WHERE text IS NOT NULL""",
)
def traces_sealed(spark, sf_dir):
    """Turns sealed under one key: opened with it again, and with another in vain."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", keyed.sealed(_TRACE_KEY, F.col("text")).alias("s"))
    opened = F.sha2(keyed.unsealed(_TRACE_KEY, F.col("s")), 256)
    body = F.rtrim(F.substring("s", 5, 2**31 - 1), F.lit("="))
    return rows.select("conv_id", "turn", opened.alias("opened_sha256"), keyed.unsealed(bytes(32), F.col("s")).alias("by_another"), F.length(body).cast("long").alias("least_chars"), F.col("s").rlike("^enc:[A-Za-z0-9_-]+=*$").alias("safe"))

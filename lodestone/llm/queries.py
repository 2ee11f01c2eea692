"""The corpus operators as queries over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, embeddings, html, licenses, lines, mixing, phrases, pii, quality, repair, simhash, tokens
from lodestone.sources import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and masked, and one full of control strings; all read back from the output."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.format_conversations(rows))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of every document, each with the occurrence that stays."""
    return lines.report(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every document."""
    found = pii.detect(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS))
    return found.select(
        "doc_id",
        *(f"n_{k}" for k in pii.KINDS),
        F.sha2(pii.written(base), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, bpe.build(docs), decoded_col="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors and fitted rate of every document; shares are wanted of all domains, none of toxic text."""
    labels = mixing.label_domains(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(table(spark, sf_dir, "documents"), labels, mixing.TARGETS)
    domain = F.array_position("posterior", F.array_max("posterior")).cast("int") - 1
    return mixed.select("doc_id", "n_tokens", "posterior", F.element_at(F.array(*map(F.lit, mixing.DOMAINS)), domain + 1).alias("domain"), "rate")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality.assess(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.section_tokens(docs, bpe.build(docs))
    return counted.select("doc_id", "n_tokens", F.size("section_tokens").cast("long").alias("n_sections"), "section_tokens", "n_crossing")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged by its rows' checksums, judged and repaired; those without rows left have zeros."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.report(repair.damage(rows))
    all_ids = rows.select("conv_id").distinct()
    whole = all_ids.join(found, all_ids["conv_id"].eqNullSafe(found["conv"]), "left").drop("conv")
    counts = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return whole.fillna(counts | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of every language."""
    return phrases.ranked(phrases.collocations(table(spark, sf_dir, "documents")))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and signatures of every document."""
    found = licenses.detect(table(spark, sf_dir, "documents")).withColumn("base", licenses.base_places())
    starts = F.transform("base", lambda d: d["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        licenses.label_list(F.col("base")).alias("base_labels"),
        licenses.label_list(F.col("detections")).alias("labels"),
        "score",
    )


def queries() -> dict[str, Query]:
    made = (
        op1_chat_format, op2_line_dedup, op3_embedding_near_dedup, op4_html_extract, op5_pii, op6_bpe, op7_mixing, op8_quality_rules, op9_simhash_near_dedup,
        op10_token_counts, op11_structure_repair, op12_phrase_mining, op13_license_scan,
    )
    return {f.__name__: f for f in made}


#: Control strings of the template, as one pattern of what escaping lengthens by a character.
_CONTROL = r"""(<\\*\|turn\|>|<\\*\|text\|>|<\\*\|end\|>|<\\*\|endoftext\|>|<\\*\|im_start\|>|<\\*\|im_end\|>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\])"""

_OP1_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(text)
    + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


_OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8))),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g WHERE n > 1) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
dup AS (SELECT doc_id, count(*) AS n_dup_lines FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM l) WHERE r > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT doc_id, host, text, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
t AS (SELECT DISTINCT host, text, n_words FROM m),
s AS (SELECT host, text, n_words, list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM (SELECT host, text, n_words, unnest(string_split(text, chr(10))) AS line FROM t)),
n AS (SELECT *, array_to_string(ws, ' ') AS key, list_transform(range(1, len(ws) - {quality.GRAM} + 2), lambda i: array_to_string(ws[i:i + {quality.GRAM} - 1], ' ')) AS grams FROM s WHERE len(ws) > 0),
k AS (SELECT host, text, n_words, key, len(ws) AS words, CASE WHEN len(grams) = 0 THEN 'K' || key ELSE 'L' || list_min(grams) END AS low, CASE WHEN len(grams) = 0 THEN 'K' || key ELSE 'H' || list_max(grams) END AS high FROM n),
lim AS (SELECT host, greatest({quality.MIN_DOCS}, count(*) * {quality.MIN_SHARE}) AS most FROM t GROUP BY 1),
u AS (SELECT DISTINCT host, text, key, low, high FROM k),
marks AS (SELECT host, text, key, unnest(list_distinct(['K' || key, low, high])) AS mark FROM u),
above AS (SELECT host, mark, most FROM marks JOIN lim USING (host) GROUP BY host, mark, most HAVING count(*) > most),
sh AS (SELECT DISTINCT host, text, key FROM marks JOIN above USING (host, mark)),
own AS (SELECT host, text, any_value(n_words) - sum(words) >= {quality.OWN_WORDS} AS counts FROM k JOIN sh USING (host, text, key) GROUP BY 1, 2),
tpl AS (SELECT u.host, u.key FROM u JOIN above a ON a.host = u.host AND a.mark = 'K' || u.key JOIN own o ON o.host = u.host AND o.text = u.text
  GROUP BY u.host, u.key, most HAVING sum(CAST(counts AS INT)) > most AND sum(CAST(counts AS INT)) >= count(*) * {quality.OWN_SHARE}),
gone AS (SELECT host, text, sum(words) AS removed FROM k JOIN tpl USING (host, key) GROUP BY 1, 2),
v AS (SELECT m.*, CAST(n_words - coalesce(removed, 0) AS BIGINT) AS words_left, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m LEFT JOIN gone USING (host, text))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_left, NOT base_failed AND words_left >= n_words * {quality.LEFT_SHARE} AS kept FROM v
"""


# Rows are read from the last to the first. A conversation's state is, for what is written last (n nothing,
# s system, u user, a assistant), the cheapest edits of the rows from here on: cost, letters, rows they leave.
# Structs compare field by field, so the least struct has the least cost and of equal costs the least letters.
_EDITS = """{{'c': {cost} + {to}.c, 'a': '{letter}' || {to}.a, 'o': {row} || {to}.o}}"""


def _edit(letter: str, cost: str, to: str, row: str = "[]::VARCHAR[]") -> str:
    return _EDITS.format(letter=letter, cost=cost, to=to, row=row)


def _insert(state: str) -> str:
    row = "['user:']"
    return f"list_min([{state}, {_edit('I', '3', 'u', row)}]) AS {state}"


def _choices(after: str) -> str:
    """Ways to keep or rerole a row; ``after``: initials of the roles that may follow, which are also the states then."""
    said, reroled = "[m.role || ':' || m.text]", {"u": "['user:' || m.text]", "a": "['assistant:' || m.text]"}
    ways = [f"CASE WHEN forced = 0 AND m.initial = '{x}' THEN {_edit('K', 'more', f'b.{x}', said)} END" for x in after]
    ways += [f"CASE WHEN forced = 0 THEN {_edit('R', '3 + more', f'b.{x}', reroled[x])} END" for x in after if x in "ua"]
    return ", ".join(ways)


_OP11_SQL = rf"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
k AS (SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(key, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)) % 20 AS kind FROM r),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, substring(role, 1, 1) AS initial, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, lag(substring(role, 1, 1)) OVER w AS before,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
m AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
f AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1 ELSE 0 END AS forced, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM m),
ends AS (SELECT {{'c': 0, 'a': '', 'o': []::VARCHAR[]}} AS none),
walk AS (
  SELECT conv_id, max(n) + 1 AS i, any_value(none) AS n, any_value({{'c': 6, 'a': 'II', 'o': ['user:', 'assistant:']}}) AS s, any_value({{'c': 3, 'a': 'I', 'o': ['assistant:']}}) AS u, any_value(none) AS a FROM f, ends GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {_insert('n')}, {_insert('s')}, u, a FROM (
    SELECT conv_id, i, n, s, list_min([u, {_edit('I', '3', 'a', "['assistant:']")}]) AS u, list_min([a, {_edit('I', '3', 'u', "['user:']")}]) AS a FROM (
      SELECT m.conv_id, m.i, list_min([{_edit('D', '4', 'b.n')}, {_choices('su')}]) AS n, list_min([{_edit('D', '4', 'b.s')}, {_choices('u')}]) AS s,
        list_min([{_edit('D', '4', 'b.u')}, {_choices('a')}]) AS u, list_min([{_edit('D', '4', 'b.a')}, {_choices('u')}]) AS a
      FROM walk b JOIN f m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i - 1))),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
x AS (SELECT DISTINCT conv_id FROM conversations)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(w.n.c, 0) AS BIGINT) AS cost, coalesce(w.n.a, '') AS audit, sha256(coalesce(array_to_string(w.n.o, chr(10)), '')) AS repaired_sha256
FROM x LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM x.conv_id AND w.i = 1
"""


_OP12_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS ws FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, ws, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= {phrases.LEAST}),
c AS (SELECT lang, k, ws, f, unnest(range(1, k)) AS cut FROM f WHERE k >= 2),
s AS (SELECT c.lang, c.k, c.ws, c.f, c.cut, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * c.f) // (l.f::HUGEINT + r.f) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:c.cut] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[c.cut + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1),
i AS (SELECT lang, f, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda x: ws[x:x + m - 1])))) AS ws FROM f WHERE k > 2),
h AS (SELECT lang, ws, max(f) AS longer FROM i GROUP BY 1, 2),
q AS (SELECT lang, array_to_string(b.ws, ' ') AS phrase, b.f AS a, l, r, n, score FROM b JOIN n USING (lang) LEFT JOIN h USING (lang, ws) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * b.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM q QUALIFY rank <= {phrases.TOP}
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": _OP1_SQL, "op8_quality_rules": _OP8_SQL, "op11_structure_repair": _OP11_SQL, "op12_phrase_mining": _OP12_SQL}

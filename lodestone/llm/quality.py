"""Quality rules with cross-document line frequency.

Each whole text is measured once (words, symbols, repeated lines and windows). Its
lines are normalised and hashed, and Spark counts in how many distinct texts of a
host each line stands. Lines above the host's limit are taken for the site's
template and removed; a document that little is left of is depleted and rejected.

A line counts toward the template only through texts that also hold something of
their own. Otherwise every line of a large family of near copies would be above the
limit and the whole family would go, while choosing one of such a family is the
near-duplicate operator's work. A line is a text's own unless it is frequent itself,
or its first or last window of ``GRAM`` words (by code points) is: an edited copy of
a frequent line shares one of the two nearly always. A text with ``OWN_WORDS`` words
in lines of its own counts, however much of it is template. A line is template if
more such texts than the limit hold it, and no fewer than ``OWN_SHARE`` of all that
do. Exact copies count once.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, free_names, with_computed

#: A line is above a host's limit if it is in more than this many of its distinct texts
MIN_DOCS = 5
#: and in more than this share of them.
MIN_SHARE = 0.002
#: Words of a window that tells edited copies of a line.
GRAM = 3
#: Words in lines of its own that make a text count toward the template.
OWN_WORDS = 5
#: Share of a template line's texts that must count.
OWN_SHARE = 0.5
#: A document is depleted if less than this share of its words is left.
LEFT_SHARE = 0.3

MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30
SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in windows of ``WINDOW`` words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    _, group, count = np.unique(mixed, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[group] > 1)
    if not len(again):
        return 0
    windows = [tuple(words[i : i + WINDOW]) for i in again.tolist()]  # equal hashes aren't proof
    times = Counter(windows)
    marks = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(again.tolist(), windows, strict=True):
        if times[w] > 1:
            marks[i] += 1
            marks[i + WINDOW] -= 1
    return int((np.cumsum(marks) > 0).sum())


def measure(text: str) -> tuple[int, int, int, int, int]:
    """The measures of one text, in the order of ``MEASURES``."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line in seen:
            repeated += bool(line.strip(SPACE))
        else:
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        repeated,
        repeated_words(words),
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def line_key(line: str) -> int | None:
    """Signed 64-bit hash of a line in lower case with white space collapsed; None without a word."""
    words = line.lower().encode("utf-8", "surrogatepass").split()
    return _hash(b" ".join(words)) if words else None


def _hash(content: bytes) -> int:
    import xxhash

    value = xxhash.xxh64_intdigest(content)
    return value - (1 << 64) if value >> 63 else value


def line_prints(text: str) -> dict[int, list[int]]:
    """key -> [words, key of the first window, key of the last] of the lines of a text that have a word.

    Windows are of the lower-case line; a line of fewer than ``GRAM`` words has its own key for both.
    """
    found: dict[int, list[int]] = {}
    for line in text.split("\n"):
        words = line.lower().encode("utf-8", "surrogatepass").split()
        if words:
            key = _hash(b" ".join(words))
            if key in found:
                found[key][0] += len(words)
            elif len(words) < GRAM:
                found[key] = [len(words), key, key]
            else:
                windows = [b" ".join(w) for w in zip(*(words[i:] for i in range(GRAM)), strict=False)]
                found[key] = [len(words), _hash(b"\0" + min(windows)), _hash(b"\1" + max(windows))]
    return found


_LINES = "array<struct<key: bigint, words: int, low: bigint, high: bigint>>"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Rows (doc_id, host, text_key, the measures, base_failed, lines): one per document row.

    ``lines`` has key, words and window keys of each distinct line with a word;
    ``text_key`` stands for the text. Null texts are taken as empty, a null host
    as a host of its own.
    """

    def rows(texts: list) -> tuple:
        values = [measure(t) for t in texts]
        failed = [base_failed(n, r) for n, *_, r in values]
        lines = [[{"key": k, "words": w, "low": lo, "high": hi} for k, (w, lo, hi) in line_prints(t).items()] for t in texts]
        return (*(list(x) for x in zip(*values, strict=True)), failed, lines)

    text = F.coalesce(F.col(text_col), F.lit(""))
    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.xxhash64(text).alias("text_key"),
        text.alias("text"),
    )
    line = pa.list_(pa.struct([("key", pa.int64()), ("words", pa.int32()), ("low", pa.int64()), ("high", pa.int64())]))
    new = [*((m, "long", pa.int64()) for m in MEASURES), ("base_failed", "boolean", pa.bool_()), ("lines", _LINES, line)]
    return with_computed(chosen, [F.col("text")], new, rows).drop("text")


def template_lines(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(distinct texts, template lines): written tables (host, text_key, n_words, lines) and (host, key)."""
    texts = scratch.keep(rows.dropDuplicates(["host", "text_key"]).select("host", "text_key", "n_words", "lines"), "texts")
    limits = scratch.keep(texts.groupBy("host").agg(F.greatest(F.lit(float(MIN_DOCS)), F.count(F.lit(1)) * F.lit(MIN_SHARE)).alias("limit")), "limits")
    lines = texts.select("host", "text_key", "n_words", F.explode("lines").alias("line")).select("host", "text_key", "n_words", "line.*")
    marks = F.explode(F.array_distinct(F.array("key", "low", "high"))).alias("mark")
    counts = texts.select("host", "text_key", F.explode("lines").alias("line")).select("host", F.explode(F.array_distinct(F.array("line.key", "line.low", "line.high"))).alias("mark"))
    counts = counts.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MIN_DOCS)
    above = scratch.keep(counts.join(limits, "host").where("n > limit").select("host", "mark", "limit"), "above")
    # words of a text in lines that are frequent, or edited copies of frequent ones
    shared = lines.select("host", "text_key", "n_words", "key", "words", marks).join(above.select("host", "mark"), ["host", "mark"])
    shared = shared.select("host", "text_key", "n_words", "key", "words").distinct()
    own = shared.groupBy("host", "text_key").agg((F.first("n_words") - F.sum("words") >= OWN_WORDS).alias("counts"))
    own = scratch.keep(own, "own")
    held = lines.select("host", "text_key", "key").join(above.withColumnRenamed("mark", "key"), ["host", "key"]).join(own, ["host", "text_key"])
    template = held.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("counts").cast("int")).alias("n_own"), F.first("limit").alias("limit"))
    template = template.where((F.col("n_own") > F.col("limit")) & (F.col("n_own") >= F.col("n") * OWN_SHARE)).select("host", "key")
    return texts, scratch.keep(template, "template")


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Rows (doc_id, the measures, base_failed, words_left, kept), one per document row.

    ``words_left``: words outside template lines. Repeated rows get equal results.
    A null text has no words and fails; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.keep(measured(docs, id_col, text_col, host_col), "rows")
    texts, template = template_lines(rows, scratch)
    removed = scratch.keep(
        texts.select("host", "text_key", F.explode("lines").alias("line"))
        .select("host", "text_key", "line.key", "line.words")
        .join(template, ["host", "key"])
        .groupBy("host", "text_key")
        .agg(F.sum("words").alias("removed")),
        "removed",
    )
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    return (
        rows.drop("lines")
        .join(removed, ["host", "text_key"], "left")
        .select(
            "doc_id",
            *MEASURES,
            "base_failed",
            left.alias("words_left"),
            (~F.col("base_failed") & (left >= F.col("n_words") * LEFT_SHARE)).alias("kept"),
        )
    )


#: Template lines are sent to the tasks if they are at most so many (16 bytes each).
BROADCAST_LINES = 500_000


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """The kept documents without their template lines, in the columns of ``docs``.

    ``chars_col``, where the table has it, becomes the code points of the new text.
    Up to ``BROADCAST_LINES`` template lines go to every task; more are joined to
    the documents by host and text instead, with the same result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    rows = scratch.keep(measured(docs, id_col, text_col, host_col), "rows")
    texts, template = template_lines(rows, scratch)
    text, host = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    host_name, key_name, lines_name, new_name, keep_name = free_names(docs, "own_host", "own_key", "own_lines", "new_text", "keep_row")
    tagged = docs.select("*", host.alias(host_name), F.xxhash64(text).alias(key_name))
    if template.count() <= BROADCAST_LINES:
        shared = spark.sparkContext.broadcast({(r["host"], r["key"]) for r in template.collect()})
        tagged = tagged.withColumn(lines_name, F.lit(None).cast("array<bigint>"))
    else:
        shared = None
        hits = (
            texts.select("host", "text_key", F.explode("lines.key").alias("key"))
            .join(template, ["host", "key"])
            .groupBy(F.col("host").alias(host_name), F.col("text_key").alias(key_name))
            .agg(F.collect_list("key").alias(lines_name))
        )
        tagged = tagged.join(scratch.keep(hits, "hits"), [host_name, key_name], "left")

    def cleaned(wholes: list, hosts: list, templates: list) -> tuple:
        new, keep = [], []
        for whole, own_host, lines in zip(wholes, hosts, templates, strict=True):
            n_words, *_, n_repeat = measure(whole)
            if base_failed(n_words, n_repeat):
                new.append(None)
                keep.append(False)
                continue
            drop = set(lines or ())
            split = whole.split("\n")
            keys = [line_key(x) for x in split]
            rest = [x for x, k in zip(split, keys, strict=True) if k is None or not (k in drop or (shared is not None and (own_host, k) in shared.value))]
            left = n_words if len(rest) == len(split) else len("\n".join(rest).encode("utf-8", "surrogatepass").split())
            new.append(None if len(rest) == len(split) else "\n".join(rest))  # null: as it is
            keep.append(left >= n_words * LEFT_SHARE)
        return new, keep

    made = with_computed(tagged, [text, F.col(host_name), F.col(lines_name)], [(new_name, "string", pa.string()), (keep_name, "boolean", pa.bool_())], cleaned)
    changed = F.col(new_name)
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    columns[text_col] = F.coalesce(changed, F.col(text_col))
    if chars_col and chars_col in columns:
        columns[chars_col] = F.when(changed.isNull(), F.col(chars_col)).otherwise(F.length(changed).cast(docs.schema[chars_col].dataType))
    return made.where(F.col(keep_name)).select(*(x.alias(c) for c, x in columns.items()))

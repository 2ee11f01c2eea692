"""Phrase collocations: candidates by sketch upper bounds, exact counts by automata.

1. Each task adds the phrases of its texts (one to four words, within pieces) to a count-min
   sketch of bytes that stop at 255; Spark adds the tasks' sketches cell by cell. The sketch
   has a bounded size, so it is broadcast. Its counts are never below the true ones.
2. Each task takes its texts in blocks. The block's phrases whose bound reaches the least
   count, and whose first and last words but one do so too, are compiled into an automaton
   guarded by blanks on both sides, which scans the block and counts all matches, overlapping
   ones included. Hashes choose what is counted, strings are what is counted: no collision can
   change a count.
3. Spark sums the counts by language and phrase, and only then the least count applies.

No automaton holds more than the phrases of one block, whatever the corpus. With a corpus far
beyond the sketch's size the bounds let more phrases through: more rows to sum, the same result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch

LEAST, LONGEST, COVERED, TOP = 30, 4, 0.8, 2000
#: Language of rows that name none.
UNKNOWN = "und"
#: Cells of each of the sketch's two rows, a byte each: from 2^16 for small corpora to 2^25 (64 MB in all).
FEWEST_CELLS, MOST_CELLS = 16, 25
#: Bytes of text for which there is a cell, below the bound.
BYTES_A_CELL = 16
#: Bytes of text that are counted at once.
BLOCK = 1 << 20
#: The word counts of languages are broadcast if they are at most so many.
BROADCAST_LANGUAGES = 100_000
#: Cells of the sketch that make a row between tasks.
CHUNK = 4096
FULL = 255

_DELIMITERS = b".,;:!?\n\x0b\x0c\r"
#: Lower case for A-Z, line feeds for what ends a piece, blanks for tabs.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 10 if c in _DELIMITERS else 32 if c == 9 else c for c in range(256))
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """(language, plain text) of about ``size`` bytes each; longer texts are cut where a piece ends, so phrases stay whole."""
    open_: dict[str, list[bytes]] = {}
    held: Counter[str] = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, rest = lang.as_py(), text.as_py().translate(_PLAIN)
            while rest:
                end = rest.find(b"\n", size) if len(rest) > size else -1
                part, rest = (rest, b"") if end < 0 else (rest[:end], rest[end + 1 :])
                open_.setdefault(lang, []).append(part)
                held[lang] += len(part)
                if held[lang] >= size:
                    yield lang, b"\n".join(open_.pop(lang))
                    held.pop(lang)
                elif held.total() >= 4 * size:  # many languages, each with little
                    yield from ((x, b"\n".join(parts)) for x, parts in open_.items())
                    open_, held = {}, Counter()
    yield from ((x, b"\n".join(parts)) for x, parts in open_.items())


def _tokens(text: bytes) -> list[bytes]:
    """Words of a block, with a line feed between pieces."""
    return [t for t in text.replace(b"\n", b" \n ").split(b" ") if t]


def _numbered(tokens: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of the tokens in order of appearance, the line feed's being 0, and the tokens by number."""
    number = {b"\n": 0}
    ids = np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.int64, len(tokens))
    return ids, list(number)


def _hashes(lang: str, ids: np.ndarray, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For one word, two words ... each: (hash of the phrase that begins at a token, whether one does)."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    own = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))[ids]
    whole, now = ids != 0, own.copy()
    yield _mixed(now, 1), whole
    for k in range(2, LONGEST + 1):
        if len(ids) < k:
            return
        now = now[:-1] * _STEP + own[k - 1 :]
        whole = whole[:-1] & (ids[k - 1 :] != 0)
        yield _mixed(now, k), whole


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * (_MIX + np.uint64(2 * k))
    h ^= h >> np.uint64(29)
    return h * _STEP


def _cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A cell in each row of the sketch."""
    return (h >> np.uint64(64 - bits)).astype(np.uint32), ((h >> np.uint64(7)) & np.uint64((1 << bits) - 1)).astype(np.uint32) + np.uint32(1 << bits)


def sketch(texts: DataFrame, bits: int, scratch: Scratch) -> np.ndarray:
    """Upper bounds of the counts of all phrases, stopping at 255: two rows of 2^bits bytes.

    A task makes one sketch of all its texts, so there are as many as the cluster has cores.
    """

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(2 << bits, np.uint8)
        for lang, text in _blocks(batches, BLOCK):
            ids, words = _numbered(_tokens(text))
            for h, whole in _hashes(lang, ids, words):
                for row in _cells(h[whole], bits):
                    at, n = np.unique(row, return_counts=True)
                    cells[at] = np.minimum(FULL, cells[at] + np.minimum(n, FULL))
        rows = cells.reshape(-1, CHUNK)
        some = np.flatnonzero(rows.any(axis=1))
        for i in range(0, len(some), 256):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 256]), pa.array([rows[j].tobytes() for j in some[i : i + 256]])], ["chunk", "cells"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for chunk, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(cells.as_buffer(), np.uint8).astype(np.uint16)
                if chunk == now:
                    total = np.minimum(FULL, total + more)
                    continue
                if now is not None:
                    yield _chunk_row(now, total)
                now, total = chunk, more
        if now is not None:
            yield _chunk_row(now, total)

    spark = texts.sparkSession
    parts = scratch.keep(texts.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(filled, "chunk long, cells binary"), "sketches")
    merged = scratch.keep(parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(added, "chunk long, cells binary"), "sketch")
    out = np.zeros((max(1, (2 << bits) // CHUNK), CHUNK), np.uint8)
    for row in merged.toLocalIterator():
        out[row["chunk"]] = np.frombuffer(row["cells"], np.uint8)
    scratch.drop(parts, merged)
    return out.reshape(-1)


def _chunk_row(chunk: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([total.astype(np.uint8).tobytes()])], ["chunk", "cells"])


def _candidates(lang: str, tokens: list[bytes], cells: np.ndarray, bits: int, least: int) -> list[list[bytes]]:
    """Different phrases of a block whose bounds reach ``least``, by number of words."""
    ids, words = _numbered(tokens)
    out, before, n_before = [], None, 0
    for k, (h, whole) in enumerate(_hashes(lang, ids, words), 1):
        first, second = _cells(h, bits)
        bound = np.minimum(cells[first], cells[second]) >= least
        bound &= whole
        if k > 1:  # both the phrase without its last and that without its first word must reach it
            bound &= (before[:-1] >= 0) & (before[1:] >= 0)
        at = np.flatnonzero(bound)
        # a phrase is told apart by the number of its beginning and its last word: exact, without hashes
        code = ids[at] if k == 1 else before[at] * len(words) + ids[at + k - 1]
        _, where, number = np.unique(code, return_index=True, return_inverse=True)
        before = np.full(len(h), -1, np.int64)
        before[at] = number
        out.append([b" ".join(tokens[i : i + k]) for i in at[where].tolist()])
    return out


def counted(texts: DataFrame, cells: np.ndarray, bits: int, least: int) -> DataFrame:
    """(lang, phrase, words, f): exact counts of all phrases that may reach ``least``; the phrase "" counts all words."""
    shared = texts.sparkSession.sparkContext.broadcast(cells)
    bound = min(least, FULL)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _blocks(batches, BLOCK):
            tokens = _tokens(text)
            phrases, sizes, automaton = [""], [0], ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, found in enumerate(_candidates(lang, tokens, shared.value, bits, bound), 1):
                for phrase in found:
                    automaton.add_word(f" {phrase.decode()} ", len(phrases))
                    phrases.append(phrase.decode())
                    sizes.append(k)
            n = np.zeros(len(phrases), np.int64)
            n[0] = len(tokens) - tokens.count(b"\n")
            if len(phrases) > 1:
                automaton.make_automaton()
                line = b" %b " % b" ".join(tokens)
                matches = Counter(map(itemgetter(1), automaton.iter(line.decode())))
                n[list(matches)] = list(matches.values())
            for i in range(0, len(phrases), 10_000):
                part = slice(i, i + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases[part])), pa.array(phrases[part]), pa.array(sizes[part], pa.int32()), pa.array(n[part])], ["lang", "phrase", "words", "f"])

    found = texts.mapInArrow(scanned, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))


def counts(docs: DataFrame, scratch: Scratch, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, words, f) of all phrases of one to four words with ``least`` occurrences; "" counts all words."""
    texts = _texts(docs, lang_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_CELLS, max(FEWEST_CELLS, (size // BYTES_A_CELL).bit_length()))
    return scratch.keep(counted(texts, sketch(texts, bits, scratch), bits, least), "counts")


def _part(first: int, n: int):
    """Words ``first`` (from 1) and on, ``n`` of them, of the column ``phrase``."""
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, covered: float = COVERED, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases that stay, two to four words of ``least`` occurrences or more.

    Words are what blanks and tabs separate within pieces; ``.,;:!?`` and line breaks end
    pieces; A-Z count as a-z. Each phrase has the cut of the lowest score
    floor(2,000,000 a / (l + r)), the first of equal ones; l and r count its two parts. A
    phrase goes if a longer one that holds it has ``covered`` of its occurrences. All numbers
    are by language; null is ``und``. Null and empty texts hold nothing, repeated rows count
    each, other columns don't matter, and an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    f = counts(docs, scratch, least, lang_col, text_col)
    candidates = f.where("words >= 2")
    cuts = [F.struct(F.lit(k).alias("k"), _part(1, k).alias("left"), F.when(F.col("words") > k, _part(k + 1, LONGEST)).alias("right")) for k in range(1, LONGEST)]
    cut = candidates.select("lang", "phrase", "f", F.explode(F.filter(F.array(*cuts), lambda c: c["right"].isNotNull())).alias("cut")).select("lang", "phrase", "f", "cut.*")
    parts = f.where("words >= 1 and words < 4")
    for side, count in (("left", "l"), ("right", "r")):
        named = parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(count))
        cut = scratch.keep(cut.join(named, ["lang", side]), f"with_{side}")  # written, so that hot parts are split
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(7, 0)) * CAST(f AS DECIMAL(20, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + r) AS BIGINT)")
    best = cut.groupBy("lang", "phrase", "f").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    inner = [F.when((F.col("words") > k) & (F.col("words") >= i + k - 1), _part(i, k)) for k in range(2, LONGEST) for i in range(1, LONGEST - k + 2)]
    inner = F.filter(F.array(*inner), lambda p: p.isNotNull())
    held = candidates.where("words > 2").select("lang", F.col("f").alias("longer"), F.explode(inner).alias("phrase"))
    most = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    percent = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("f").cast("decimal(20,0)") * round(100 * covered)
    words = f.where("phrase = ''").select("lang", F.col("f").alias("n"))
    words = F.broadcast(words) if words.count() <= BROADCAST_LANGUAGES else words
    kept = best.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~percent)
    return kept.join(words, "lang").select("lang", "phrase", F.col("f").alias("a"), F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language by score, then count, both descending, then phrase; ``rank`` from 1.

    Ranks within 64 shares of each language come first, so no task ranks more than a share of all and 64 heads.
    """
    order = [F.desc("score"), F.desc("a"), "phrase"]
    shares = found.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    heads = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top).drop("share", "rank")
    out = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


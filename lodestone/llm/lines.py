"""Fuzzy line deduplication across documents.

Every line that isn't blank takes part. Lines are normalised; exact repeats of a
normalised line are one node throughout. Different lines long enough to be told
apart are also linked if their edit similarity reaches ``SIMILARITY``: they meet
in the buckets of a MinHash signature over their character n-grams, so scripts
without spaces count like any other, and are verified there. Connected lines form
a group, of which one occurrence stays: that of the smallest document id, first line.

Bucket entries are dealt out as packed blocks of numbers, never as rows: most buckets
hold one line, and such entries go no further. Of the rest, lines whose sketches are
near form candidate groups, and only their texts are fetched, each once. A group is
verified as a whole, likeliest pairs first: lines already known to be connected need
no further proof. A group of more than ``TILE`` lines is verified in tiles, first inside
each tile, then between tiles; one of more than ``GROUP`` lines so in each of its buckets.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import minhash
from lodestone.llm.common import PIECE, Scratch, components, free_names, plain, with_computed

#: Lines of fewer words and of fewer characters go as exact repeats only.
MIN_WORDS = 5
MIN_CHARS = 16
SIMILARITY = 0.8
#: Characters of a gram, minima of a signature, and minima that two lines must share to meet.
GRAM = 7
HASHES = 33
ROWS = 3
#: Bits in which the sketches of lines may differ. Lines without a common gram differ in 32 +- 4 of 64.
BUDGET = 21
#: Minima that lines must share to be compared: of similarity 0.8 all but few share 18 of 33, others 3.
LEAST = 11
TILE = 512
#: Lines of a candidate group up to which it is dealt out in tiles as a whole, and closed in one task.
GROUP = 8192
#: Characters that are normalised, or whose grams are hashed, at once.
SLICE_CHARS = 1_000_000
#: Lines whose bucket entries a task packs at once.
PACKED_LINES = 100_000
#: Bits of the map of wanted lines, at most (32 MB). Beyond some tens of millions of lines it lets others through, which a join drops.
MAP_BITS = 1 << 28


class _Letters(dict):
    """Translation of characters: letters, digits and line breaks stay, all others become a space."""

    def __missing__(self, code: int) -> int:
        self[code] = code if code == 10 or chr(code).isalnum() else 32
        return self[code]


_LETTERS = _Letters()


@functools.cache
def _table(kind: type) -> np.ndarray:
    """For each code point of up to 16 bits, or of any, what it becomes in a normalised line, before runs are shortened: itself, 0 or a space."""
    out = np.full(0x10000 if kind is np.uint16 else 0x110000, 32, kind)
    for code in range(len(out)):
        c = chr(code)
        if c.isalnum():
            out[code] = 48 if c.isdecimal() else code
    out[10] = 10
    return out


def normalised_lines(text: str) -> list[str]:
    """Of each line of a text its runs of letters and digits in lower case, a space apart, each number in them as 0."""
    text = text.lower()
    coding, table = "utf-16-le", _table(np.uint16)
    codes = np.frombuffer(text.encode(coding, "surrogatepass"), np.uint16)
    if len(codes) > len(text):
        coding, table = "utf-32-le", _table(np.uint32)
        codes = np.frombuffer(text.encode(coding, "surrogatepass"), np.uint32)
    codes = table[codes]
    space, zero, end = codes == 32, codes == 48, codes == 10
    keep = np.ones(len(codes), bool)
    keep[:1] = ~space[:1]
    keep[1:] = ~((space[1:] & (space[:-1] | end[:-1])) | (zero[1:] & zero[:-1]))
    codes = codes[keep]
    # of a run of spaces the first is left, at a line's end too
    keep = codes != 32
    keep[:-1] |= codes[1:] != 10
    keep[-1:] = codes[-1:] != 32
    return codes[keep].tobytes().decode(coding, "surrogatepass").split("\n")


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SLICE_CHARS`` characters in all."""
    at = 0
    while at < len(sizes):
        upto, size = at + 1, sizes[at]
        while upto < len(sizes) and size + sizes[upto] <= SLICE_CHARS:
            size += sizes[upto]
            upto += 1
        yield at, upto
        at = upto


def read_lines(texts: list[str]) -> Iterator[tuple[list[int], list[int], list[str | None]]]:
    """For each text (line numbers, line keys, normalised lines) of the lines that aren't blank; None for those too short to be fuzzy.

    A short line's key keeps its numbers, which may be all that it says; that of a
    line without letters or digits is of its characters.
    """
    import xxhash

    for lo, hi in _slices([len(t) for t in texts]):
        made = iter(normalised_lines("\n".join(texts[lo:hi])))
        for text in texts[lo:hi]:
            numbers, keys, norms = [], [], []
            for i, line in enumerate(text.split("\n")):
                own = norm = next(made)
                if len(norm) < MIN_CHARS and norm.count(" ") < MIN_WORDS - 1:
                    if not line or line.isspace():
                        continue
                    norm, own = None, "\0" + (" ".join(line.lower().translate(_LETTERS).split()) or "\0" + " ".join(line.split()))
                numbers.append(i)
                keys.append(xxhash.xxh3_64_intdigest(own.encode("utf-8", "surrogatepass")))
                norms.append(norm)
            yield numbers, keys, norms


def line_keys(text: str) -> tuple[list[int], np.ndarray, list[str | None]]:
    """What :func:`read_lines` gives of one text, keys as signed numbers."""
    ((numbers, keys, norms),) = read_lines([text])
    return numbers, np.array(keys, np.uint64).view(np.int64), norms


def line_signatures(norms: list[str]) -> np.ndarray:
    """MinHash signatures of normalised lines over their grams of ``GRAM`` characters; a shorter line is one gram."""
    sizes = np.fromiter(map(len, norms), np.int64, len(norms))
    # filled up by line breaks, no gram reaches from one line into the next
    padded = "".join(norm if len(norm) >= GRAM else norm.ljust(GRAM, "\n") for norm in norms)
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.maximum(sizes, GRAM)
    grams = np.zeros(max(0, len(codes) - GRAM + 1), np.uint32)
    for k in range(GRAM):
        np.multiply(grams, np.uint32(0x9E3779B1), out=grams)
        np.add(grams, codes[k : k + len(grams)], out=grams)
    grams ^= grams >> np.uint32(15)
    grams *= np.uint32(0x85EBCA77)
    grams ^= grams >> np.uint32(13)
    starts = np.cumsum(sizes) - sizes
    own = np.ones(len(codes), bool)
    for k in range(1, GRAM):  # grams that begin in a line's last characters
        own[starts + sizes - k] = False
    own = own[: len(grams)]
    counts = sizes - GRAM + 1
    return minhash.signatures(grams[own], np.cumsum(counts) - counts, HASHES)


def edit_distance(a: str, b: str, most: float = float("inf")) -> int:
    """Levenshtein distance, bit-parallel over whole strings (Myers, 1999; Hyyrö, 2003); any number above ``most`` if it is more."""
    same = len(os.path.commonprefix([a, b]))
    a, b = a[same:], b[same:]
    same = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - same], b[: len(b) - same]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    bit = 1
    for c in a:
        where[c] = where.get(c, 0) | bit
        bit <<= 1
    full, high, score = bit - 1, bit >> 1, len(a)
    up, down, left = full, 0, len(b)
    for c in b:
        if score - left > most:  # each character left can take one off at best
            return score - left
        left -= 1
        eq = where.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        # "& full ^ full" inverts within the string; ~ would make negative numbers, which are slow
        plus, minus = down | (horizontal | up) & full ^ full, up & horizontal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus = plus << 1 | 1
        up, down = (minus << 1 | (vertical | plus) & full ^ full) & full, plus & vertical
    return score


def _aligned(x: list[str], y: list[str], most: float) -> bool:
    """Whether replacing runs of a few words for others takes at most ``most`` characters: then so does editing."""
    i = j = cost = 0
    n, m = len(x), len(y)
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for di, dj in _STEPS:
            if i + di < n and j + dj < m and x[i + di] == y[j + dj]:
                break
        else:
            break
        cost += max(sum(map(len, x[i : i + di])) + di, sum(map(len, y[j : j + dj])) + dj)
        if cost > most:
            return False
        i, j = i + di, j + dj
    return cost + max(sum(map(len, x[i:])) + n - i, sum(map(len, y[j:])) + m - j) <= most


#: Words to pass over in either line until both go on alike, the fewest first.
_STEPS = [(1, 1), (1, 0), (0, 1), (2, 2), (2, 0), (0, 2), (2, 1), (1, 2), (3, 3)]


def similar(a: str, b: str) -> bool:
    """Whether the edit distance is at most a share ``1 - SIMILARITY`` of the longer line."""
    most = (1 - SIMILARITY) * max(len(a), len(b)) + 1e-9
    if abs(len(a) - len(b)) > most:
        return False
    return _aligned(a.split(" "), b.split(" "), most) or edit_distance(a, b, most) <= most


def signatures(norms: list[str]) -> np.ndarray:
    """Signatures of normalised lines, hashed in bounded slices."""
    out = [np.zeros((0, HASHES), np.uint32)]
    out += [line_signatures(norms[lo:hi]) for lo, hi in _slices([len(n) for n in norms])]
    return np.concatenate(out)


def _lists(sizes, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)), values)


def _key(docs: DataFrame, id_col: str, text_col: str) -> list:
    """Columns that tell document rows apart: (no_id, id_key, text_key)."""
    no_id = F.col(id_col).isNull()
    return [no_id.alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("id_key"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key")]


_ROW = "no_id boolean, id_key long, text_key long, n_lines int, found array<struct<no: int, line: long>>"
_FOUND = pa.list_(pa.struct([("no", pa.int32()), ("line", pa.int64())]))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (no_id, id_key, text_key, n_lines, found) for each document row, and (family, node, label) for lines with likely company; the others null.

    ``found``: (no, line) of lines that aren't blank. See :func:`minhash.company` for the rest.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, waiting, dealt = set(), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                part = batch.slice(at, PIECE)
                read = list(read_lines(part.column(3).to_pylist()))
                sizes = [len(own) for own, *_ in read]
                numbers, lines = (np.array([x for own in read for x in own[k]], t) for k, t in ((0, np.int32), (1, np.uint64)))
                found = pa.StructArray.from_arrays([pa.array(numbers), pa.array(lines.view(np.int64))], ["no", "line"])
                slots = pa.array((np.arange(dealt, dealt + len(read)) * 2654435761 % minhash.SLOTS).astype(np.int32))
                dealt += len(read)
                nothing = pa.nulls(len(read), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sizes, pa.int32()), _lists(sizes, found), slots, nothing], names=names)
                # a line's copies are packed once
                new = {k: n for _, keys, norms in read for k, n in zip(keys, norms, strict=True) if n is not None and k not in seen}
                if new:
                    seen.update(new)
                    signed = signatures(list(new.values()))
                    waiting.append(minhash.entries(np.fromiter(new, np.uint64, len(new)).view(np.int64), signed, np.fromiter(map(len, new.values()), float), ROWS))
                if len(seen) >= PACKED_LINES:
                    yield from packed(waiting)
                    seen, waiting = set(), []
        yield from packed(waiting)

    def packed(waiting: list) -> Iterator[pa.RecordBatch]:
        for slots, blocks in minhash.blocks(waiting):
            nothing = [pa.nulls(len(slots), t) for t in (pa.bool_(), pa.int64(), pa.int64(), pa.int32(), _FOUND)]
            yield pa.RecordBatch.from_arrays([*nothing, slots, blocks], names=names)

    names = ["no_id", "id_key", "text_key", "n_lines", "found", "slot", "block"]
    chosen = docs.select(*_key(docs, id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return minhash.company(chosen.mapInArrow(rows, f"{_ROW}, slot int, block binary"), _ROW, TILE, BUDGET, SIMILARITY)


def _bits(keys: np.ndarray, numbers: np.ndarray, size: int) -> np.ndarray:
    """Places of lines in a map of ``size`` bits, a power of two."""
    return minhash.mixed(keys.view(np.uint64) + numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(size - 1)


def _wanted(places: DataFrame) -> np.ndarray:
    """A map of the lines at ``places`` (no_id, id_key, text_key, no), in bytes: it has a bit for each of them, and some by chance."""
    size = min(MAP_BITS, max(1 << 16, 1 << (16 * places.count()).bit_length()))

    def numbered(keys: list, numbers: list) -> tuple:
        return (pa.array(_bits(np.array(keys, np.int64), np.array(numbers, np.int64), size).astype(np.int64)),)

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, np.uint8)
        bits[table["bit"].to_numpy() & 0xFFFF] = 1
        return pa.table({"piece": table["piece"][:1], "bits": pa.array([np.packbits(bits).tobytes()])})

    placed = with_computed(places.select(_place_key().alias("key"), "no"), [F.col("key"), F.col("no")], [("bit", "long", pa.int64())], numbered)
    out = np.zeros(size >> 3, np.uint8)
    pieces = placed.select("bit").distinct().withColumn("piece", F.shiftright("bit", 16))
    for r in pieces.groupBy("piece").applyInArrow(pack, "piece long, bits binary").toLocalIterator():
        out[r["piece"] << 13 : (r["piece"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return out


def _place_key():
    return F.xxhash64("no_id", "id_key", "text_key")


def _line_texts(docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``places`` (no_id, id_key, text_key, no, ...), each with its normalised line ``own``. Texts stay where they are read; only lines move."""
    shared = docs.sparkSession.sparkContext.broadcast(_wanted(places))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                part = batch.slice(at, PIECE)
                texts = part.column(4).to_pylist()
                counts = np.array([t.count("\n") + 1 for t in texts])
                doc = np.repeat(np.arange(len(texts)), counts)
                no = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                bit = _bits(part.column(3).to_numpy()[doc], no, 8 * len(bits))
                hit = np.flatnonzero(bits[bit >> np.uint64(3)] >> (7 - (bit & np.uint64(7)).astype(np.uint8)) & 1)
                if not len(hit):
                    continue
                doc, no = doc[hit], no[hit]
                split, own = {d: texts[d].split("\n") for d in np.unique(doc).tolist()}, []
                chosen = [split[d][n] for d, n in zip(doc.tolist(), no.tolist(), strict=True)]
                for lo, hi in _slices([len(c) for c in chosen]):
                    own += normalised_lines("\n".join(chosen[lo:hi]))
                taken = part.select(["no_id", "id_key", "text_key"]).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(no.astype(np.int32)), pa.array(own, pa.string())], names=[*key, "own"])

    key = ["no_id", "id_key", "text_key", "no"]
    keyed = docs.select(*_key(docs, id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = keyed.select("no_id", "id_key", "text_key", _place_key().alias("key"), "text").mapInArrow(read, "no_id boolean, id_key long, text_key long, no int, own string")
    return found.join(places, key)


def line_groups(docs: DataFrame, lines: DataFrame, met: DataFrame, scratch: Scratch, id_col: str, text_col: str = "text") -> DataFrame:
    """Rows (node, component): line keys that are fuzzy repeats of others, with their group's key.

    ``lines``: (line, at, component, size), written: lines of candidate groups of ``size`` lines. ``met``: (family, node), the buckets where they met.
    """
    texts = scratch.keep(_line_texts(docs, lines.select("at.*", F.col("line").alias("node"), "component", "size"), id_col, text_col).select("node", "component", "size", "own"), "texts")

    def verify(batches: Iterator) -> Iterator:
        for part in minhash.verified_groups(batches, similar, signatures, SIMILARITY, LEAST):
            yield plain(part)

    small = texts.where(F.col("size") <= TILE).select("component", "node", "own")
    small = small.repartition("component").sortWithinPartitions("component", "node").mapInPandas(verify, "node long, component long")
    fp = F.lit(0).cast("long").alias("fp")
    middle = texts.where((F.col("size") > TILE) & (F.col("size") <= GROUP)).select(F.col("component").alias("family"), "node", fp, "own")
    if not middle.isEmpty():
        small = small.union(minhash.closed(minhash.family_links(middle, scratch, TILE, BUDGET, similar, signatures, LEAST)))
    large = texts.where(F.col("size") > GROUP).select("node", fp, "own")
    if large.isEmpty():
        return small
    own = scratch.keep(met.join(large.select("node").distinct(), "node", "left_semi").select("family", "node"), "met")
    placed = scratch.keep(minhash.once_each(own).join(large.dropDuplicates(["node"]), "node").select("family", "node", "fp", "own"), "placed")
    return small.union(components(minhash.verified_links(placed, scratch, TILE, BUDGET, similar, signatures, LEAST), scratch))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (no_id, id_key, text_key, n_lines, removed), one per document row.

    ``n_lines``: lines that aren't blank. ``removed``: (line, kept_doc, kept_line) of the
    lines to remove, by line: number from 0, and the occurrence that stays (its
    document null if that has no id). Of a group, the occurrence in the document of
    the smallest id stays; rows with a null id come last, of equal ids the one with
    the smaller text hash is first; rows equal in both are one document. Lines of
    fewer than ``MIN_WORDS`` words and ``MIN_CHARS`` characters go as exact repeats only.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    key = ["no_id", "id_key", "text_key"]
    rows = scratch.keep(occurrences(docs, id_col, text_col), "rows")
    rows, met = rows.where("family IS NULL").select(*key, "n_lines", "found"), rows.where("family IS NOT NULL").select("family", "node", "label")
    near = scratch.keep(components(met, scratch, "node", "label"), "near")
    near = near.join(near.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select(F.col("node").alias("line"), "component", "size")
    found = rows.select(*key, F.explode("found").alias("f")).select(*key, "f.no", "f.line")
    at = F.struct(*key, "no")
    lines = found.groupBy("line").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("n"))
    # a line without copies and without company stays where it is
    lines = scratch.keep(lines.join(near, "line", "left").where((F.col("n") > 1) | F.col("component").isNotNull()), "lines")
    groups = scratch.keep(line_groups(docs, lines.where(F.col("component").isNotNull()), met, scratch, id_col, text_col), "groups")
    first = lines.drop("component").join(groups, lines["line"] == groups["node"], "left").select("line", F.coalesce("component", "line").alias("group"), "component", "at", "n")
    first = scratch.keep(first.where((F.col("n") > 1) | F.col("component").isNotNull()).select("line", "group", "at"), "first")
    keepers = first.groupBy("group").agg(F.min("at").alias("kept"))
    repeated = scratch.keep(first.join(keepers, "group").select("line", "kept"), "repeated")
    removed = (
        found.select(*key, "no", "line").join(repeated, "line")
        .where(at != F.col("kept"))
        .select(*key, F.struct(F.col("no").alias("line"), F.when(~F.col("kept.no_id"), F.col("kept.id_key")).alias("kept_doc"), F.col("kept.no").alias("kept_line")).alias("r"))
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set("r")).alias("removed"))
    )
    removed = scratch.keep(removed, "removed")
    none = F.array().cast("array<struct<line: int, kept_doc: bigint, kept_line: int>>")
    return rows.select(*key, "n_lines").join(removed, key, "left").select(*key, "n_lines", F.coalesce("removed", none).alias("removed"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_lines, n_removed, removed), one per document row; see :func:`repeats`. Any long is an id."""
    doc_id = F.when(~F.col("no_id"), F.col("id_key"))
    return repeats(docs, id_col, text_col).select(doc_id.alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without repeated lines, in its columns; documents of which nothing but white space is left go.

    Documents that lost no line stay as they are, null and empty texts too.
    ``chars_col``, where the table has it, becomes the code points of the new text.
    """
    key = ["no_id", "id_key", "text_key"]
    names = free_names(docs, *key, "gone")
    gone = repeats(docs, id_col, text_col).where(F.size("removed") > 0).select(*(F.col(k).alias(n) for k, n in zip(key, names, strict=False)), F.col("removed.line").alias(names[3]))
    gone = gone.dropDuplicates(names[:3])
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(_key(docs, id_col, text_col), names, strict=False)))
    lost = F.col(names[3])
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(lost, i)), "\n")
    out = keyed.join(gone, names[:3], "left").withColumn(text_col, F.when(lost.isNull(), F.col(text_col)).otherwise(left))
    out = out.where(lost.isNull() | F.col(text_col).rlike(r"\S"))
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(lost.isNull(), F.col(chars_col)).otherwise(F.length(text_col).cast(docs.schema[chars_col].dataType)))
    return out.select(*(F.col(c) for c in docs.columns))

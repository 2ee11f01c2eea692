"""SimHash near-duplicates of documents, linked by a binary trie self-join.

``fingerprints`` hashes the word shingles of each whole text; ``near_duplicates``
links fingerprints that differ in a few bits and labels the connected groups.

All distinct fingerprints make one binary trie, and pairs of its nodes are traversed
together from the pair (root, root) down. A pair carries the bits in which its two
prefixes differ so far; it is dropped once they exceed the error budget, since no
fingerprint below can make up for them. Spark traverses the top, ``STRIDE`` bits a
round: a table of open node pairs is joined with the nodes' children. A pair whose
nodes hold at most ``TILE`` fingerprints each is handed to a task, which goes on bit by
bit. No node is ever whole in a task beyond that size, however many fingerprints crowd
below one prefix.

Tasks return a spanning star of each linked group they see, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, components, link_labels, with_computed

SEED = 42
BITS = 64
#: Bits that Spark goes down in a round; divides ``BITS``.
STRIDE = 4
#: Fingerprints of a node that a task takes at most.
TILE = 16384
#: Pairs of nodes that a task holds at once.
FRONT = 1 << 18
#: Pairs of fingerprints below which a pair of nodes is compared outright.
LEAF = 32


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one text; see :func:`fingerprints`."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return 0
    # bytes.lower and bytes.split know ASCII only: A-Z, and space, \t, \n, \v, \f, \r.
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = len(parts) - words + 1
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """Rows (doc_id, fp): fp is the fingerprint's 64 bits as a signed long.

    A-Z are lower-cased; words are runs of anything but ASCII white space; shingles
    of ``words`` words, repeats included, are joined by spaces and hashed by XXH64
    (seed 42). A text of fewer words is one shingle. Null texts and texts without
    a word get 0. A bit is set if it is set in more than half of the hashes.
    """

    def hashed(texts: list) -> tuple:
        return (pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)),)

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_computed(ids, [F.col("text")], [("fp", "long", pa.int64())], hashed).drop("text")


def _leaf_pairs(alo, ahi, blo, bhi):
    """Index pairs of each pair of ranges, in slices of a bounded number."""
    sizes = (ahi - alo) * (bhi - blo)
    at = 0
    while at < len(sizes):
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 1_000_000, "right")))
        n, width = sizes[at:upto], (bhi - blo)[at:upto]
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(width, n)
        yield np.repeat(alo[at:upto], n) + offset // width, np.repeat(blo[at:upto], n) + offset % width
        at = upto


def trie_links(left: np.ndarray, right: np.ndarray | None, depth: int, spent: int, budget: int, seen: dict | None = None) -> np.ndarray:
    """Labels that connect the fingerprints below a pair of trie nodes within ``budget`` bits.

    ``left``, ``right``: ascending fingerprints of two nodes that lie ``depth`` bits
    deep and differ in ``spent`` bits so far; ``right`` is None for a node with itself.
    Returns an index per fingerprint, of ``left``, then ``right``; equal ones are
    connected. ``seen``, if given, counts the node pairs visited and pruned.
    """
    words = left if right is None else np.concatenate([left, right])
    labels, n = np.arange(len(words)), len(left)
    whole = (0, n, 0, n) if right is None else (0, n, n, len(words))
    stack = [(BITS - 1 - depth, *(np.array([x]) for x in (*whole, spent)))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, alo, ahi, blo, bhi, cost = stack.pop()
        if len(alo) > FRONT:  # depth first in halves, so that the open pairs stay bounded
            half = len(alo) // 2
            stack += [(bit, *(x[half:] for x in (alo, ahi, blo, bhi, cost))), (bit, *(x[:half] for x in (alo, ahi, blo, bhi, cost)))]
            continue
        small = ((ahi - alo) * (bhi - blo) <= LEAF) if bit >= 0 else np.ones(len(alo), bool)
        for i, j in _leaf_pairs(alo[small], ahi[small], blo[small], bhi[small]):
            near = (np.bitwise_count(words[i] ^ words[j]) <= budget) & (i != j)
            if near.any():
                link_labels(labels, i[near], j[near])
        alo, ahi, blo, bhi, cost = (x[~small] for x in (alo, ahi, blo, bhi, cost))
        if not len(alo):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((words >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        own = ones[bit]
        amid, bmid = ahi - (own[ahi] - own[alo]), bhi - (own[bhi] - own[blo])
        children = [
            (alo, amid, blo, bmid, cost, None),
            (amid, ahi, bmid, bhi, cost, None),
            (alo, amid, bmid, bhi, cost + 1, None),
            (amid, ahi, blo, bmid, cost + 1, alo != blo),  # of a node with itself, this is the one before
        ]
        kept: list[list[np.ndarray]] = [[], [], [], [], []]
        for *child, only in children:
            there = (child[1] > child[0]) & (child[3] > child[2])
            if only is not None:
                there &= only
            ok = there & (child[4] <= budget)
            if seen is not None:
                seen["visited"] = seen.get("visited", 0) + int(there.sum())
                seen["pruned"] = seen.get("pruned", 0) + int((there & ~ok).sum())
            for out, x in zip(kept, child, strict=True):
                out.append(x[ok])
        stack.append((bit - 1, *(np.concatenate(x) for x in kept)))
    return labels


def _prefix(fp: Column, depth: int) -> Column:
    return F.shiftrightunsigned(fp, BITS - depth)


def node_pairs(prints: DataFrame, scratch: Scratch, budget: int) -> list[tuple[int, DataFrame]]:
    """(depth, rows (a, b, spent), written) of the pairs of trie nodes that are left to tasks.

    ``prints``: distinct rows (fp), written. ``a`` and ``b`` are prefixes of ``depth``
    bits, a <= b or, as longs, in either order but once; each holds at most ``TILE``
    fingerprints, and they differ in ``spent`` bits, no more than ``budget``.
    """
    fp = F.col("fp")
    n = prints.count()
    if n <= TILE:
        root = scratch.spark.createDataFrame([(0, 0, 0)], "a long, b long, spent int")
        return [(0, scratch.keep(root, "pairs"))]
    opened = scratch.keep(scratch.spark.createDataFrame([(0, 0, 0)], "a long, b long, spent int"), "opened")
    out, depth = [], 0
    while not opened.isEmpty():
        parents = opened.select(F.col("a").alias("parent")).union(opened.select("b")).distinct()
        depth += STRIDE
        below = prints.select(_prefix(fp, depth).alias("node"), (_prefix(fp, depth - STRIDE) if depth > STRIDE else F.lit(0).cast("long")).alias("parent"))
        nodes = below.groupBy("parent", "node").agg(F.count(F.lit(1)).alias("n")).join(parents, "parent", "left_semi")
        nodes = scratch.keep(nodes, "nodes")
        x, y = (nodes.select(F.col("parent").alias(k), F.col("node").alias(f"{k}_node"), F.col("n").alias(f"{k}_n")) for k in "ab")
        spent = (F.col("spent") + F.bit_count(F.col("a_node").bitwiseXOR(F.col("b_node"))) - F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).cast("int")
        # of a node with itself, each pair of children is met once
        children = opened.join(x, "a").join(y, "b").where((F.col("a") != F.col("b")) | (F.col("a_node") <= F.col("b_node")))
        children = children.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), spent.alias("spent"), (F.greatest("a_n", "b_n") <= TILE).alias("ready")).where(F.col("spent") <= budget)
        children = scratch.keep(children, "children")
        out.append((depth, children.where("ready").select("a", "b", "spent")))
        opened = children.where(~F.col("ready")).select("a", "b", "spent")
    return out


def fingerprint_links(prints: DataFrame, scratch: Scratch, budget: int = 4) -> DataFrame:
    """Edges (a, b) between fingerprints that connect all of them within ``budget`` bits.

    ``prints``: distinct rows (fp), written, not a plan. Exact for any ``budget``.
    """

    def linked(depth: int):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    part = batch.slice(i, 1)
                    a, b = part.column(0)[0].as_py(), part.column(1)[0].as_py()
                    left, right = (part.column(k).flatten().to_numpy().view(np.uint64) for k in (3, 4))
                    words = np.concatenate([left, right]) if a != b else left
                    labels = trie_links(left, right if a != b else None, depth, part.column(2)[0].as_py(), budget)
                    moved = np.flatnonzero(labels != np.arange(len(labels)))
                    words = words.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(words[moved]), pa.array(words[labels[moved]])], names=["a", "b"])

        return rows

    spark, out = scratch.spark, None
    tasks = 4 * spark.sparkContext.defaultParallelism
    unsigned = lambda x: x.bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  signed order of these is the unsigned one
    for depth, pairs in node_pairs(prints, scratch, budget):
        n = pairs.count()
        if not n:
            continue
        node = _prefix(F.col("fp"), depth) if depth else F.lit(0).cast("long")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        packed = prints.select(node.alias("node"), unsigned(F.col("fp")).alias("fp")).join(wanted, "node", "left_semi")
        packed = packed.groupBy("node").agg(F.transform(F.sort_array(F.collect_list("fp")), unsigned).alias("fps"))  # at most TILE each
        packed = scratch.keep(packed, "packed")
        x, y = (packed.select(F.col("node").alias(k), F.col("fps").alias(f"{k}_fps")) for k in "ab")
        dealt = pairs.join(x, "a").join(y, "b").select("a", "b", "spent", "a_fps", "b_fps").repartition(min(n, tasks), "a", "b")
        links = dealt.mapInArrow(linked(depth), "a long, b long")
        out = links if out is None else out.unionByName(links)
    return out.distinct() if out is not None else spark.createDataFrame([], "a long, b long")


def text_groups(docs: DataFrame, text_col: str = "text", words: int = 4, budget: int = 4) -> DataFrame:
    """Rows (text_key, link), one per different text: texts of one ``link`` are connected within ``budget`` bits, by the same join.

    ``text_key`` is the hash of the whole text, null being empty.
    """
    scratch = Scratch(docs.sparkSession, "simhash-texts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text"))
    rows = scratch.keep(fingerprints(keyed, words=words).distinct(), "rows")
    prints = scratch.keep(rows.select("fp").distinct(), "prints")
    groups = components(fingerprint_links(prints, scratch, budget), scratch)
    return rows.join(groups, rows["fp"] == groups["node"], "left").select(F.col("doc_id").alias("text_key"), F.coalesce("component", "fp").alias("link"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, budget: int = 4) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per document row.

    ``component_id`` is the smallest id reachable over links of at most ``budget``
    differing fingerprint bits. Repeated rows and exact copies share a fingerprint
    and are one node of the join. Documents without a word have fingerprint zero
    and link like any other. Any long is an id. A row with a null id takes part; if
    no document of its group has an id, ``component_id`` is null. Columns
    beyond the two named are not read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, id_col, text_col, words), "rows")
    prints = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    groups = components(fingerprint_links(prints.select("fp"), scratch, budget), scratch)
    grouped = prints.join(groups, prints["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    grouped = scratch.keep(grouped, "grouped")
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = scratch.keep(grouped.join(least, "component").select("fp", "component_id"), "labelled")
    return rows.join(labelled, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Near-duplicate documents by the Jaccard similarity of their word shingles.

Texts meet in the buckets of a MinHash signature over their shingles and are linked
where the shingles they share reach ``SIMILARITY`` of those that either has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import minhash
from lodestone.llm.common import Scratch, components, free_names, with_computed

WORDS = 5
SIMILARITY = 0.8
#: Minima that two texts must share to meet: at the threshold all but 0.0002 of them do.
ROWS = 4
#: Bits in which sketches may differ; at the threshold they differ in 6.4 +- 2.4.
BUDGET = 20
TILE = 128


def shingles(text: str) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of a text's shingles; of fewer words there is one, of none none.

    Words are runs of anything but ASCII white space, A-Z in lower case.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    grams = (b" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))) if words else ()
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9


def text_key(text_col: str):
    """Column: a hash of the whole text, null being empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", linked: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, component_id, text_key, group), one per document row; ``component_id``: the smallest id of the linked group.

    Texts of the same words are one node, and so are all texts without a word. A row
    with a null id takes part; if no document of its group has an id, ``component_id``
    is null. ``group`` tells groups apart where ids can't, ``text_key`` the rows of one id.
    ``linked``: rows (text_key, link) of texts that belong together whatever their shingles; their
    groups and those of shingles are joined into one where they meet.
    """
    scratch = Scratch(docs.sparkSession, "shingles")
    text = F.coalesce(F.col(text_col), F.lit(""))

    def signed(texts: list) -> tuple:
        import xxhash

        sets = [shingles(t) for t in texts]
        sizes = np.array([len(s) for s in sets])
        fp, keys = np.zeros(len(sets), np.int64), [[]] * len(sets)
        if sizes.any():
            found = minhash.signatures(np.concatenate(sets), (np.cumsum(sizes) - sizes)[sizes > 0])
            fp[sizes > 0] = minhash.sketches(found).view(np.int64)
            for i, own in zip(np.flatnonzero(sizes).tolist(), minhash.buckets(found, ROWS).tolist(), strict=True):
                keys[i] = own
        node = [xxhash.xxh3_64_intdigest(b" ".join(t.encode("utf-8", "surrogatepass").lower().split())) for t in texts]
        return pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(fp), sizes.tolist(), keys

    longs = pa.list_(pa.int64())
    new = [("node", "long", pa.int64()), ("fp", "long", pa.int64()), ("size", "int", pa.int32()), ("buckets", "array<long>", longs)]
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), text.alias("text"))
    rows = scratch.keep(with_computed(keyed, [F.col("text")], new, signed).drop("text"), "rows")
    nodes = scratch.keep(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("text_key").alias("text_key"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("buckets").alias("buckets")), "nodes")
    met = minhash.met_in_buckets(nodes.select("node", "fp", "size", "buckets"), scratch, TILE, BUDGET, SIMILARITY)
    wanted = scratch.keep(nodes.join(met.select("node").distinct(), "node").select("node", "text_key"), "wanted")

    def owned(texts: list) -> tuple:
        return ([shingles(t).view(np.int64) for t in texts],)

    own = docs.select(text_key(text_col).alias("text_key"), text.alias("text")).join(wanted, "text_key").select("node", "text").dropDuplicates(["node"])
    own = scratch.keep(with_computed(own, [F.col("text")], [("own", "array<long>", longs)], owned).drop("text"), "own")
    placed = scratch.keep(met.join(own, "node").join(nodes.select("node", "fp"), "node").select("family", "node", "fp", "own"), "placed")
    links = minhash.verified_links(placed, scratch, TILE, BUDGET, similar).select("a", "b")
    if linked is not None:
        held = scratch.keep(nodes.select("node", "text_key").join(linked, "text_key").select("node", "link"), "held")
        least = held.groupBy("link").agg(F.min("node").alias("least"))
        links = links.union(held.join(least, "link").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    groups = components(links, scratch)
    grouped = nodes.select("node", "rep").join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("group"), "rep")
    grouped = scratch.keep(grouped, "grouped")
    first = scratch.keep(grouped.groupBy("group").agg(F.min("rep").alias("component_id")), "first")
    labelled = scratch.keep(grouped.join(first, "group").select("node", "component_id", "group"), "labelled")
    return rows.select("doc_id", "node", "text_key").join(labelled, "node").select("doc_id", "component_id", "text_key", "group")


def one_per_group(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that lead their group by ``groups``, the result of :func:`near_duplicates`: one per group.

    Of each group the row of the smallest id stays, rows without an id last, then of the
    smallest text key; of rows equal in both, one. Rows of one id but different groups are
    different documents, and so are rows without an id.
    """
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    lead_id, lead_key, own_key = free_names(docs, "lead_id", "lead_key", "own_key")
    lead = groups.groupBy("group").agg(F.min(place).alias("lead")).select(F.col("lead.doc_id").alias(lead_id), F.col("lead.text_key").alias(lead_key))
    keyed = docs.withColumn(own_key, text_key(text_col))
    same = keyed[id_col].cast("long").eqNullSafe(lead[lead_id]) & (keyed[own_key] == lead[lead_key])
    return keyed.join(lead, same, "left_semi").dropDuplicates([id_col, own_key]).drop(own_key)

"""Texts against texts by the words they share: a stated set of items against all documents, in packs.

Documents are packed where they are read, some thousand to a row with their words as numbers;
items are dealt into blocks of a row each. A task meets one pack and one block at a time and
answers with what counts, so no pair of a word is ever a row of Spark's and no text is shuffled.
Documents whose id is null or stands in several rows are few and need their rows put together
first: they alone go through joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import cut

#: Documents of a pack and items of a block at most, and words of a pack beyond which it is closed.
PACK, BLOCK, WORDS = 4096, 256, 4_000_000
#: Numbers that a task works on at once.
CELLS = 4_000_000


def by_id(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: those whose id is their own, and the rows of ids that are null or found more than once."""
    ids = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull())
    repeated = cut(ids.select(F.col(key).alias("__id")))
    same = docs[key].eqNullSafe(repeated["__id"])
    return docs.join(repeated, same, "left_anti"), docs.join(repeated, same, "left_semi")


def _packs(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """Rows (ids, lengths, codes, terms): the words of up to ``PACK`` documents, each as its place among ``terms``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column("w")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, before = batch.column("id").to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
            at = 0
            while at < len(ids):
                upto = min(at + PACK, max(at + 1, int(np.searchsorted(before, before[at] + WORDS))))
                coded = batch.column("w").slice(at, upto - at).flatten().dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
                row = [ids[at:upto].astype(np.int64).tobytes(), lengths[at:upto].tobytes(), codes.tobytes()]
                terms = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in row), terms], names=["ids", "lengths", "codes", "terms"])
                at = upto

    return docs.select(F.col(key).cast("long").alias("id"), words.alias("w")).mapInArrow(pack, "ids binary, lengths binary, codes binary, terms array<string>")


def _blocks(items: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row for up to about ``BLOCK`` items: (block), their rows (key, columns)."""
    n = -(-items.select(key).distinct().count() // BLOCK) or 1
    return items.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("at")).agg(F.collect_list(F.struct(key, *columns)).alias("block")).drop("at")


def _met(docs: DataFrame, blocks: DataFrame, answer, schema: str) -> DataFrame:
    """What ``answer(block, ids, lengths, codes, terms)`` gives of each pack and block."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths, codes = (np.frombuffer(batch.column(c)[i].as_py(), d) for c, d in (("ids", np.int64), ("lengths", np.int64), ("codes", np.int32)))
                yield answer(batch.column("block")[i].values, ids, lengths, codes, batch.column("terms")[i].values)

    return docs.crossJoin(blocks).mapInArrow(meet, schema)


def _first(order: tuple, item: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` rows of each item in the order of keys, the last one counting most."""
    rows = np.lexsort((*order, item))
    runs = item[rows]
    return rows[np.arange(len(rows)) - np.searchsorted(runs, runs) < k]


def best_scores(items: DataFrame, docs: DataFrame, item_key: str, doc_key: str, words: Column, k: int) -> DataFrame:
    """Rows (item, doc, dot, overlap) that hold each item's best ``k`` documents by ``dot`` and by ``overlap``, smaller ids first where equal.

    ``items``: rows (item, term, tf), each item and term once. ``dot`` sums the products of counts,
    ``overlap`` is how many terms are shared. Ids of ``docs`` are their own and not null.
    """
    kind = items.schema[item_key].dataType.simpleString()

    def answer(block, ids, lengths, codes, terms):
        names, term, tf = (block.field(c) for c in (item_key, "term", "tf"))
        names, term = names.dictionary_encode("encode"), term.dictionary_encode()
        weights = np.zeros((len(term.dictionary), len(names.dictionary)), np.int64)
        weights[term.indices.to_numpy(), names.indices.to_numpy()] = tf.to_numpy()
        code = pc.fill_null(pc.index_in(terms, value_set=term.dictionary), -1).to_numpy().astype(np.int64)[codes]
        doc = np.repeat(np.arange(len(ids)), lengths)
        pairs, counts = np.unique((doc * len(weights) + code)[code >= 0], return_counts=True)
        doc, code = np.divmod(pairs, max(1, len(weights)))
        dot, overlap = (np.zeros((len(ids), weights.shape[1]), np.int64) for _ in range(2))
        starts = np.flatnonzero(np.diff(doc, prepend=-1))  # the first pair of each document
        at = 0
        while at < len(starts):
            last = max(at + 1, int(np.searchsorted(starts, starts[at] + CELLS // weights.shape[1], "right")) - 1) if at + 1 < len(starts) else at + 1
            lo, hi = starts[at], starts[last] if last < len(starts) else len(pairs)
            held, own = weights[code[lo:hi]], starts[at:last]
            overlap[doc[own]] = np.add.reduceat((held > 0).astype(np.int32), own - lo, axis=0)
            dot[doc[own]] = np.add.reduceat(held * counts[lo:hi, None], own - lo, axis=0)
            at = last
        found = []
        for score in (dot, overlap):
            # what reaches the k-th greatest, its equals included, is all that can be among the best
            kth = np.partition(score, len(ids) - k, axis=0)[len(ids) - k] if k < len(ids) else np.zeros(score.shape[1], np.int64)
            d, i = np.nonzero((score >= kth) & (score > 0))
            best = _first((ids[d], -score[d, i]), i, k)
            found.append(d[best] * weights.shape[1] + i[best])
        d, i = np.divmod(np.unique(np.concatenate(found)), max(1, weights.shape[1]))
        return pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(i)), pa.array(ids[d]), pa.array(dot[d, i]), pa.array(overlap[d, i])], names=[item_key, doc_key, "dot", "overlap"])

    return _met(_packs(docs, doc_key, words), _blocks(items, item_key, "term", "tf"), answer, f"{item_key} {kind}, {doc_key} long, dot long, overlap long")


def shared_runs(items: DataFrame, docs: DataFrame, item_key: str, doc_key: str, words: Column, n: int) -> DataFrame:
    """Rows (item, doc, grade): how many different runs of ``n`` words an item shares with a document.

    ``items``: rows (item, w) of word lists. Ids of ``docs`` are their own and not null.
    """
    kind = items.schema[item_key].dataType.simpleString()
    powers = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(n)], np.uint64)

    def runs(codes, owner):
        """(owner, codes) of the runs that lie within one owner and hold known words only."""
        if len(codes) < n:
            return np.zeros(0, np.int64), np.zeros((0, n), np.int64)
        bad = np.concatenate(([0], np.cumsum(codes < 0)))
        good = np.flatnonzero((bad[n:] == bad[:-n]) & (owner[n - 1 :] == owner[: len(owner) - n + 1]))
        return owner[good], codes[good[:, None] + np.arange(n)]

    def answer(block, ids, lengths, codes, terms):
        names, said = block.field(item_key), block.field("w")
        term = said.flatten().dictionary_encode()
        sizes = pc.fill_null(pc.list_value_length(said), 0).to_numpy(zero_copy_only=False)
        owner = names.dictionary_encode("encode").indices.to_numpy()
        labels = names.dictionary_encode("encode").dictionary
        # rows of one item are kept apart where runs are made and put together where they are told apart
        row, held = runs(term.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes))
        held = np.unique(np.column_stack((owner[row], held)), axis=0)
        marks = (held[:, 1:].astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64)
        held = held[order := np.argsort(marks)]
        marks = marks[order]
        code = pc.fill_null(pc.index_in(terms, value_set=term.dictionary), -1).to_numpy().astype(np.int64)[codes]
        doc, asked = runs(code, np.repeat(np.arange(len(ids)), lengths))
        mark = (asked.astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64)
        lo, hi = np.searchsorted(marks, mark), np.searchsorted(marks, mark, "right")
        at = np.repeat(np.arange(len(mark)), hi - lo)
        met = np.arange(len(at)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[at]
        same = (held[met, 1:] == asked[at]).all(axis=1)  # runs of one mark may still differ
        both = np.unique(doc[at[same]] * max(1, len(held)) + met[same])
        d, run = np.divmod(both, max(1, len(held)))
        pairs, grade = np.unique(d * max(1, len(labels)) + held[run, 0], return_counts=True)
        d, i = np.divmod(pairs, max(1, len(labels)))
        return pa.RecordBatch.from_arrays([labels.take(pa.array(i)), pa.array(ids[d]), pa.array(grade.astype(np.int64))], names=[item_key, doc_key, "grade"])

    return _met(_packs(docs, doc_key, words), _blocks(items, item_key, "w"), answer, f"{item_key} {kind}, {doc_key} long, grade long")

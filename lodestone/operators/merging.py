"""Greedy merging of similar rows without a fold: the first independent set in order, round by round.

In order of importance and last access a row absorbs all later ones that are similar to it and
not absorbed yet. So a row is a primary as soon as no earlier similar row is left that is one or
may become one, and it is absorbed as soon as an earlier similar one is a primary. Each round
settles all rows of which that can be said. Rows meet in blocks of vectors; a task holds two
blocks and answers with rows, never with pairs. Copies of a vector are one row from the start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import cut

BLOCK = 4096
_PACKED = "grp string, block int, first binary, second binary, ids binary, unit binary"


def _packed(rows: DataFrame, block: int) -> DataFrame:
    """Rows (grp, first, second, id, vector) as blocks of at most about ``block``, dealt by a hash of the id."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack([np.asarray(v, np.float64) for v in part["vector"]])
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        columns = {c: part[c].to_numpy(np.float64).tobytes() for c in ("first", "second")}
        return pd.DataFrame([{"grp": part["grp"].iloc[0], "block": int(part["block"].iloc[0]), **columns, "ids": part["id"].to_numpy(np.int64).tobytes(), "unit": unit.tobytes()}])

    sizes = rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return dealt.groupBy("grp", "block").applyInPandas(pack, _PACKED)


def _side(row, side: str) -> tuple[np.ndarray, ...]:
    first, second = (np.frombuffer(getattr(row, f"{side}_{c}"), np.float64) for c in ("first", "second"))
    ids = np.frombuffer(getattr(row, f"{side}_ids"), np.int64)
    return first, second, ids, np.frombuffer(getattr(row, f"{side}_unit"), np.float64).reshape(len(ids), -1)


def _met(primary: DataFrame, later: DataFrame, threshold: float, half: bool) -> DataFrame:
    """(id, first, second, primary_id): for each row of ``later`` the earliest similar earlier row of ``primary``, block by block."""

    def earliest(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in part.itertuples():
            p, q = _side(row, "p"), _side(row, "q")
            for a, b in ((p, q), (q, p)) if half and row.p_block != row.q_block else ((p, q),):
                place = np.lexsort((np.concatenate([a[2], b[2]]), np.concatenate([a[1], b[1]]), np.concatenate([a[0], b[0]])))
                rank = np.empty(len(place), np.int64)
                rank[place] = np.arange(len(place))
                ra, rb = rank[: len(a[2])], rank[len(a[2]) :]
                by_order = np.argsort(ra)
                near = (b[3] @ a[3][by_order].T >= threshold) & (ra[by_order][None, :] < rb[:, None]) & (a[2][by_order][None, :] != b[2][:, None])
                hit = np.flatnonzero(near.any(axis=1))
                best = by_order[near[hit].argmax(axis=1)]
                out.append(pd.DataFrame({"id": b[2][hit], "first": a[0][best], "second": a[1][best], "primary_id": a[2][best]}))
        return pd.concat(out)

    side = lambda df, s: df.select("grp", *(F.col(c).alias(f"{s}_{c}") for c in ("block", "first", "second", "ids", "unit")))
    pairs = side(primary, "p").join(side(later, "q"), "grp")
    pairs = pairs.where("p_block <= q_block") if half else pairs
    # every pair of blocks has a key of its own, so a hot group is spread over tasks
    return pairs.groupBy("grp", "p_block", "q_block").applyInPandas(earliest, "id long, first double, second double, primary_id long")


def primaries(memories: DataFrame, group: str, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(grp, id, primary_id) of ``memories`` (id, importance, accessed_at, embedding): who absorbs each; a primary itself.

    Order: importance, last access, both descending and nulls last, then id; ids are unique.
    Similar: a cosine of ``threshold`` or more in the same group, null groups being one. Null
    and zero vectors are like none and stay. All others of a group are of one length.
    """
    vector = F.col("embedding").cast("array<double>")
    last = lambda c: F.coalesce(-F.col(c).cast("double"), F.lit(float("inf")))
    rows = memories.select(F.col(group).cast("string").alias("grp"), F.col("id").cast("long").alias("id"), last("importance").alias("first"), last("accessed_at").alias("second"), vector.alias("vector"))
    rows = rows.withColumn("grp", F.coalesce(F.concat(F.lit("="), "grp"), F.lit("")))
    some = F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    rows = cut(rows.withColumn("mark", F.when(some, F.sha2(F.array_join(F.col("vector").cast("array<string>"), ","), 256))))
    # copies: the first one stands for all, as they are similar to the same rows and to it
    kept = rows.where("mark IS NOT NULL").groupBy("grp", "mark").agg(F.min(F.struct("first", "second", "id")).alias("rep"), F.first("vector").alias("vector"))
    kept = cut(kept.select("grp", "mark", "rep.*", "vector"))
    left, chosen = kept.drop("mark"), None
    while not left.isEmpty():
        packed = cut(_packed(left, block))
        waits = cut(_met(packed, packed, threshold, half=True).select("id").distinct())
        new, rest = cut(left.join(waits, "id", "left_anti")), cut(left.join(waits, "id", "left_semi"))
        chosen = new if chosen is None else chosen.unionByName(new)
        if rest.isEmpty():
            break
        gone = _met(cut(_packed(new, block)), cut(_packed(rest, block)), threshold, half=False).select("id").distinct()
        left = cut(rest.join(gone, "id", "left_anti"))
    alone = rows.where("mark IS NULL").select("grp", "id", F.col("id").alias("primary_id"))
    if chosen is None:
        return _named(alone)
    chosen = cut(chosen)
    others = kept.join(chosen.select("id"), "id", "left_anti")
    found = _met(cut(_packed(chosen, block)), cut(_packed(others, block)), threshold, half=False)
    absorbed = found.groupBy("id").agg(F.min(F.struct("first", "second", "primary_id"))["primary_id"].alias("primary_id"))
    by = kept.select("grp", "mark", "id").join(absorbed, "id", "left").select("grp", "mark", F.coalesce("primary_id", "id").alias("primary_id"))
    return _named(rows.join(by, ["grp", "mark"]).select("grp", "id", "primary_id").union(alone))


def _named(found: DataFrame) -> DataFrame:
    return found.select(F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).alias("grp"), "id", "primary_id")


def merge_similar(memories: DataFrame, group: str, threshold: float = 0.9, metadata: str | None = None) -> DataFrame:
    """(grp, primary_id, importance, access_count, merged): memories left after merging, see :func:`primaries`.

    Importance is the largest, access counts are added, ``merged`` counts the memories. With
    ``metadata``, a column of maps, their union is added: of equal keys the primary's value
    counts, else that of the first memory in order.
    """
    placed = cut(primaries(memories, group, threshold))
    kept = [F.col("importance").cast("double").alias("importance"), F.col("access_count").cast("long").alias("access_count"), F.col("accessed_at").cast("double").alias("accessed_at")]
    own = memories.select(F.col("id").cast("long").alias("id"), *kept, *([F.col(metadata).alias("entries")] if metadata else []))
    joined = placed.join(own, "id")
    out = joined.groupBy("grp", "primary_id").agg(F.max("importance").alias("importance"), F.sum("access_count").alias("access_count"), F.count(F.lit(1)).alias("merged"))
    if metadata is None:
        return out
    order = F.struct((F.col("id") != F.col("primary_id")).alias("other"), (-F.col("importance")).alias("i"), (-F.col("accessed_at")).alias("a"), "id")
    entries = joined.select("primary_id", order.alias("place"), F.explode("entries").alias("key", "value"))
    first = entries.groupBy("primary_id", "key").agg(F.min(F.struct("place", "value"))["value"].alias("value"))
    united = first.groupBy("primary_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))
    return out.join(united, "primary_id", "left").select(*out.columns, "metadata")

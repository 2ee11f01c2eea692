"""Near-duplicate vectors by quantised tile products with error bounds.

Unit vectors are quantised to int8 with a scale of their own. The norm of what
quantising lost bounds the error of every product: for unit vectors x, y with
quantised forms p, q, |x.y - p.q| <= |x - p| + |y - q| + |x - p| |y - q|. Spark deals
the distinct vectors into blocks and multiplies pairs of blocks. A pair whose bound
stays below the threshold is settled, one that stays above it too; only pairs whose
interval holds the threshold are computed again from the full vectors, in double
precision.

Tasks count links and return a spanning star of what they have linked, so a large
family of copies costs no more rows than it has members. Equal vectors are one node.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, components, link_labels

THRESHOLD = 0.9
#: Vectors of a block.
BLOCK = 2048
#: Allowance for rounding in the bounds themselves.
SLACK = 1e-9


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes int8, scale, error) of the rows' unit vectors; error is the norm of unit - scale * codes, rounded up."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - scale[:, None] * codes, axis=1) + SLACK
    return codes, scale, error


def tile_products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes. Sums below 2**24 are exact in float32; longer vectors are summed piece by piece."""
    step = (1 << 24) // (127 * 127)
    out = np.zeros((len(p), len(q)), np.float64)
    for at in range(0, p.shape[1], step):
        out += p[:, at : at + step].astype(np.float32) @ q[:, at : at + step].astype(np.float32).T
    return out


def compare(a: dict, b: dict | None, threshold: float) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """One pair of blocks, or one block with itself: (links counted per node, star edges, pairs to compute in full)."""
    same = b is None
    b = a if same else b
    counts = np.zeros(len(a["node"])), np.zeros(len(b["node"]))
    nodes = a["node"] if same else np.concatenate([a["node"], b["node"]])
    labels = np.arange(len(nodes))
    unsure = []
    for lo in range(0, len(a["node"]), 512):
        rows = slice(lo, lo + 512)
        near = tile_products(a["codes"][rows], b["codes"]) * a["scale"][rows, None] * b["scale"]
        error = a["error"][rows, None] + b["error"] + a["error"][rows, None] * b["error"] + SLACK
        possible = near + error >= threshold
        if same:
            possible &= np.arange(len(b["node"])) > np.arange(lo, lo + len(near))[:, None]
        i, j = np.nonzero(possible)
        sure = near[i, j] - error[i, j] >= threshold
        unsure.append((a["node"][i[~sure] + lo], b["node"][j[~sure]]))
        i, j = i[sure] + lo, j[sure]
        np.add.at(counts[0], i, b["weight"][j])
        np.add.at(counts[1], j, a["weight"][i])
        link_labels(labels, i, j if same else j + len(a["node"]))
    total = counts[0] + counts[1] if same else np.concatenate(counts)
    moved = labels != np.arange(len(labels))
    pick = total > 0
    return (
        pd.DataFrame({"a": nodes[pick], "b": total[pick].astype(np.int64)}),
        pd.DataFrame({"a": nodes[moved], "b": nodes[labels[moved]]}),
        pd.DataFrame({"a": np.concatenate([x for x, _ in unsure]), "b": np.concatenate([y for _, y in unsure])}),
    )


def _packed(distinct: DataFrame, blocks: int) -> DataFrame:
    """One row per block: its nodes, weights, codes, scales and errors as bytes."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        codes, scale, error = quantise(np.stack(part["vector"].to_numpy()).astype(np.float64))
        row = {"block": int(part["block"].iloc[0]), "node": part["node"].to_numpy(np.int64).tobytes(), "weight": part["weight"].to_numpy(np.int64).tobytes()}
        return pd.DataFrame([row | {"codes": codes.tobytes(), "scale": scale.tobytes(), "error": error.tobytes()}])

    dealt = distinct.select(F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), "node", "weight", "vector")
    return dealt.groupBy("block").applyInPandas(pack, "block int, node binary, weight binary, codes binary, scale binary, error binary")


def _unpacked(row) -> dict:
    node = np.frombuffer(row.node, np.int64)
    return {
        "node": node,
        "weight": np.frombuffer(row.weight, np.int64),
        "codes": np.frombuffer(row.codes, np.int8).reshape(len(node), -1),
        "scale": np.frombuffer(row.scale, np.float64),
        "error": np.frombuffer(row.error, np.float64),
    }


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of ``vectors``.

    Two vectors are linked if their cosine in double precision is at least
    ``threshold``. ``n_links`` counts the other rows linked to a row, equal vectors
    and repeated rows included; ``component_id`` is the smallest id reachable.
    Vectors that are null, empty or zero, or hold a null or non-finite component,
    link with nothing, and so do vectors of different lengths with each other. A
    null id takes part in links; ``component_id`` is null if no row of the
    component has an id, and ``kept`` is false for a null id.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = scratch.keep(rows.select("vec_id", F.when(F.coalesce(finite, F.lit(False)), v).alias("vector")), "rows")
    usable = rows.where(F.col("vector").isNotNull())
    # numbers, not hashes, tell vectors apart; the written table keeps them
    found = usable.groupBy("vector").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    distinct = scratch.keep(found.select("vector", F.monotonically_increasing_id().alias("node"), "weight", "least"), "distinct")
    per_size = distinct.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = edges = None
    for size in per_size:  # vectors of one length; a table has one or few
        own = distinct.where(F.size("vector") == size["size"])
        c, e = _links(own, size["n"], threshold, scratch)
        counts = c if counts is None else counts.unionByName(c)
        edges = e if edges is None else edges.unionByName(e)
    if counts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    groups = scratch.keep(components(edges, scratch), "groups")
    linked = counts.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = distinct.join(linked, "node", "left").join(groups, "node", "left").select("node", "vector", "weight", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    nodes = scratch.keep(nodes, "nodes")
    least = scratch.keep(nodes.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    labelled = scratch.keep(nodes.join(least, "component").select("vector", F.xxhash64("vector").alias("key"), (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id"), "labelled")
    found = rows.select("vec_id", "vector", F.xxhash64("vector").alias("key"), F.col("vector").isNull().alias("alone"))
    component = F.when(F.col("alone"), F.col("vec_id")).otherwise(F.col("component_id"))
    return found.join(labelled, ["key", "vector"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )


def _links(distinct: DataFrame, n: int, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((node, links), edges (a, b)) among distinct vectors of one length; weights count."""
    blocks = -(-n // BLOCK)
    packed = scratch.keep(_packed(distinct, blocks), "packed")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    dealt = packed.select("*", other).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "weight", "codes", "scale", "error")

    def multiply(part: pd.DataFrame) -> pd.DataFrame:
        tiles = [_unpacked(r) for r in part.sort_values("block").itertuples()]
        if len(tiles) == 1 and part["i"].iloc[0] != part["j"].iloc[0]:
            return pd.DataFrame({"kind": [], "a": [], "b": []})  # the other block is empty
        found = compare(tiles[0], tiles[1] if len(tiles) > 1 else None, threshold)
        return pd.concat([f.assign(kind=k) for k, f in enumerate(found)])[["kind", "a", "b"]]

    # the one block (i, i) stands once in its pair
    found = scratch.keep(dealt.groupBy("i", "j").applyInPandas(multiply, "kind int, a long, b long"), "found")
    vector = distinct.select("node", "weight", "vector")
    x, y = (vector.select(F.col("node").alias(k), F.col("weight").alias(f"{k}_weight"), F.col("vector").alias(f"{k}_vector")) for k in "ab")
    norm = {k: F.sqrt(F.aggregate(f"{k}_vector", F.lit(0.0), lambda s, z: s + z * z)) for k in "ab"}
    dot = F.aggregate(F.zip_with("a_vector", "b_vector", lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    unsure = found.where("kind = 2").select("a", "b").join(x, "a").join(y, "b")
    full = scratch.keep(unsure.where(dot / (norm["a"] * norm["b"]) >= threshold).select("a", "b", "a_weight", "b_weight"), "full")
    counts = (
        found.where("kind = 0")
        .select(F.col("a").alias("node"), F.col("b").alias("links"))
        .unionByName(full.select(F.col("a").alias("node"), F.col("b_weight").alias("links")))
        .unionByName(full.select(F.col("b").alias("node"), F.col("a_weight").alias("links")))
    )
    return counts, found.where("kind = 1").select("a", "b").unionByName(full.select("a", "b"))

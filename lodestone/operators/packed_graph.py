"""Weighted graphs as packed blocks of links, for rounds over all vertices without a shuffle.

A vertex's links lie in one block, a row of Spark's that is written once. In a round every
block meets what is known of the vertices, a few numbers each, sent to all tasks, and answers
with numbers for its own vertices. So this is for graphs of a bounded number of vertices
(``community.BROADCAST_VERTICES``), of any number of links.

Vertices are numbered from 0; ``names`` has the numbers, in rising order, that they have in the
graph which all came from, and labels are such numbers too, so that equals are settled by the
order of ids on each level.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import cut

#: Ends of links in a block, but for those of one vertex, which are never parted.
BLOCK = 1 << 18
#: Digits of a gain that count: sums of weights may differ in their last bits.
DIGITS = 9
_PACKED = "verts binary, counts binary, ends binary, weights binary"


@dataclass
class Packed:
    """Blocks (verts, counts, ends, weights) without loops; loops, degrees and names by vertex."""

    blocks: DataFrame
    names: np.ndarray
    loops: np.ndarray
    degree: np.ndarray

    @property
    def twice(self) -> float:
        return float(self.degree.sum()) or 1.0

    def sweep(self, kernel: Callable, *state) -> tuple[np.ndarray, np.ndarray]:
        """What ``kernel`` (block, *state) says of each vertex: a whole number, -1 where it has no links, and a weight."""
        spark = self.blocks.sparkSession
        sent = spark.sparkContext.broadcast(state)

        def run(batches):
            for part in batches:
                for row in part.itertuples():
                    number, weight = kernel(_unpacked(row), *sent.value)
                    yield pd.DataFrame([{"verts": row.verts, "number": number.astype(np.int32).tobytes(), "weight": weight.astype(np.float64).tobytes()}])

        numbers, weights = np.full(len(self.names), -1, np.int64), np.zeros(len(self.names))
        for row in self.blocks.mapInPandas(run, "verts binary, number binary, weight binary").collect():
            at = np.frombuffer(row["verts"], np.int32)
            numbers[at], weights[at] = np.frombuffer(row["number"], np.int32), np.frombuffer(row["weight"], np.float64)
        sent.destroy()
        return numbers, weights


@dataclass
class _Block:
    """``verts`` in rising order; links from ``start`` on are a vertex's; ``of``: whose each link is, as a place in ``verts``."""

    verts: np.ndarray
    start: np.ndarray
    of: np.ndarray
    ends: np.ndarray
    weights: np.ndarray


def _unpacked(row) -> _Block:
    verts, counts, ends = (np.frombuffer(x, np.int32) for x in (row.verts, row.counts, row.ends))
    of = np.repeat(np.arange(len(verts)), counts)
    return _Block(verts, np.concatenate([[0], np.cumsum(counts)[:-1]]), of, ends, np.frombuffer(row.weights, np.float64))


def packed(links: DataFrame, names: np.ndarray, loops: np.ndarray) -> Packed:
    """A graph of written ``links`` (a, b, weight) between different ones of ``names``, numbered from 0."""
    blocks = -(-2 * links.count() // BLOCK) or 1

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((part["b"].to_numpy(), part["a"].to_numpy()))
        verts, counts = np.unique(part["a"].to_numpy(), return_counts=True)
        rows = {"verts": verts, "counts": counts, "ends": part["b"].to_numpy()[order]}
        weights = part["weight"].to_numpy(np.float64)[order]
        return pd.DataFrame([{k: v.astype(np.int32).tobytes() for k, v in rows.items()} | {"weights": weights.tobytes()}])

    ends = links.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    both = ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    dealt = both.withColumn("block", F.pmod("a", F.lit(blocks))).repartition(2 * blocks, "block")
    graph = Packed(cut(dealt.groupBy("block").applyInPandas(pack, _PACKED)), names, loops, 2 * loops)
    graph.degree = graph.sweep(_strength)[1] + 2 * loops
    return graph


def _strength(block: _Block) -> tuple[np.ndarray, np.ndarray]:
    return block.start * 0, np.add.reduceat(block.weights, block.start)


def _summed(of: np.ndarray, key: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, key, sum of weights) for each pair of them, in their order."""
    wide = of.astype(np.int64) << 32 | key
    order = np.argsort(wide, kind="stable")
    wide = wide[order]
    first = np.flatnonzero(np.concatenate([[True], wide[1:] != wide[:-1]])) if len(wide) else np.zeros(0, np.int64)
    sums = np.add.reduceat(weights[order], first) if len(first) else np.zeros(0)
    return (wide[first] >> 32).astype(np.int64), wide[first] & 0xFFFFFFFF, sums


def _best(of: np.ndarray, key: np.ndarray, gain: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` the first key of the largest gain, and that gain: -1 and minus infinity where there is none; rows come in order of ``of`` and ``key``."""
    best, most = np.full(n, -1, np.int64), np.full(n, -np.inf)
    if len(of):
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        most[of[first]] = np.maximum.reduceat(gain, first)
        top = np.flatnonzero(gain == most[of])
        who, at = np.unique(of[top], return_index=True)
        best[who] = key[top[at]]
    return best, most


def _choice(block: _Block, label, totals, degree, twice) -> tuple[np.ndarray, np.ndarray]:
    """The label of the largest gain, its own among equals, then the smallest; and the weight of links to its own."""
    of, key, inside = _summed(block.of, label[block.ends], block.weights)
    own, weight = label[block.verts], degree[block.verts]
    stays = key == own[of]
    at_home = np.zeros(len(own))
    at_home[of[stays]] = inside[stays]
    of, key, inside = of[~stays], key[~stays], inside[~stays]
    best, most = _best(of, key, np.round(inside - weight[of] * totals[key] / twice, DIGITS), len(own))
    return np.where(most > np.round(at_home - weight * (totals[own] - weight) / twice, DIGITS), best, own), at_home


def _leaving(block: _Block, part, community) -> tuple[np.ndarray, np.ndarray]:
    """The weight of links to other parts of the same community."""
    mine = block.verts[block.of]
    away = (community[mine] == community[block.ends]) & (part[mine] != part[block.ends])
    return block.start * 0, np.add.reduceat(np.where(away, block.weights, 0.0), block.start)


def _joining(block: _Block, part, community, moves, stands, totals, degree, twice) -> tuple[np.ndarray, np.ndarray]:
    """For those that move the part of the largest positive gain, -1 where there is none."""
    mine = block.verts[block.of]
    met = moves[mine] & (community[mine] == community[block.ends]) & stands[part[block.ends]]
    of, key, inside = _summed(block.of[met], part[block.ends[met]], block.weights[met])
    gain = np.round(inside - degree[block.verts[of]] * totals[key] / twice, DIGITS)
    good = gain > 0
    return _best(of[good], key[good], gain[good], len(block.verts))[0], np.zeros(len(block.verts))


def _lowest(block: _Block, low, label) -> tuple[np.ndarray, np.ndarray]:
    """The lowest number among its neighbours' of the same label, or its own where one is of another."""
    mine = block.verts[block.of]
    near = np.where(label[mine] == label[block.ends], low[block.ends], low[mine])
    return np.minimum.reduceat(near, block.start), np.zeros(len(block.verts))


def moves(graph: Packed, turns: np.ndarray, rounds: int, label: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """(label, modularity after each round), see ``community.local_moves``; ``turns`` has a bit for each round."""
    best, history, settled, twice = label, [], False, graph.twice
    for i in range(rounds + 1):
        names, at = np.unique(label, return_inverse=True)
        totals = np.bincount(at, graph.degree, len(names))
        chosen, inside = graph.sweep(_choice, at.astype(np.int32), totals, graph.degree, twice)
        chosen = np.where(chosen < 0, at, chosen)
        history.append((inside.sum() + 2 * graph.loops.sum()) / twice - (graph.degree * totals[at]).sum() / (twice * twice))
        if i == 0 or history[-1] > max(history[:-1]) + 1e-12:
            best = label
        if i == rounds or settled or i >= 5 and max(history[-5:]) <= max(history[:-5]) + 1e-12:
            break
        settled = bool((chosen == at).all())  # no vertex would rather be elsewhere, whoever's turn it is
        label = names[np.where(turns >> i & 1 != 0, chosen, at)]
    return best, history


def refined(graph: Packed, odd: np.ndarray, rounds: int, label: np.ndarray) -> np.ndarray:
    """Parts of communities, named after one of theirs, see ``community.refine``; ``odd`` settles who may move in which round."""
    n, twice = len(graph.names), graph.twice
    community = np.unique(label, return_inverse=True)[1].astype(np.int32)
    whole = np.bincount(community, graph.degree)[community]
    part, idle = np.arange(n, dtype=np.int32), 0
    for i in range(rounds):
        out = np.bincount(part, graph.sweep(_leaving, part, community)[1], n)
        totals, sizes = np.bincount(part, graph.degree, n), np.bincount(part, minlength=n)
        # a part lies in one community, that of the vertex it is named after
        sound = (sizes > 0) & (np.round(out - totals * (whole - totals) / twice, DIGITS) >= 0)
        moving = sound & (sizes == 1) & ((odd + i) % 2 == 0)
        chosen = graph.sweep(_joining, part, community, moving, sound & ~moving, totals, graph.degree, twice)[0]
        idle = idle + 1 if (chosen < 0).all() else 0
        if idle == 2:  # neither half has anything to join
            break
        part = np.where(chosen < 0, part, chosen).astype(np.int32)
    return graph.names[part]


def connected(graph: Packed, label: np.ndarray) -> np.ndarray:
    """The lowest vertex of each label's connected part, see ``community.connected``."""
    label = np.unique(label, return_inverse=True)[1].astype(np.int32)
    low = np.arange(len(label), dtype=np.int64)
    while True:
        near = graph.sweep(_lowest, low, label)[0]
        hop = np.where(near < 0, low, np.minimum(near, low))
        # a vertex tells its old root of its new one, then follows its root's root
        down = hop.copy()
        np.minimum.at(down, low, hop)
        after = down[down]
        if (after == low).all():
            return graph.names[low]
        low = after


def merged(graph: Packed, label: np.ndarray) -> Packed:
    """The graph of labels: weights between two added up, those within one its loop."""
    names, at = np.unique(label, return_inverse=True)
    at = at.astype(np.int32)
    sent = graph.blocks.sparkSession.sparkContext.broadcast(at)

    def run(batches):
        for part in batches:
            for row in part.itertuples():
                block = _unpacked(row)
                mine = block.verts[block.of]
                once = mine < block.ends
                a, b = sent.value[mine[once]], sent.value[block.ends[once]]
                low, high, weight = _summed(np.minimum(a, b), np.maximum(a, b), block.weights[once])
                yield pd.DataFrame({"a": low, "b": high, "weight": weight})

    links = cut(graph.blocks.mapInPandas(run, "a long, b long, weight double").groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    sent.destroy()
    inner = links.where("a = b").toPandas()
    loops = np.bincount(at, graph.loops, len(names)) + np.bincount(inner["a"].to_numpy(np.int64), inner["weight"].to_numpy(np.float64), len(names))
    return packed(links.where("a <> b"), names, loops)

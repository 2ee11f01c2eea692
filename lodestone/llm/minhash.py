"""MinHash signatures: buckets in which similar sets meet, and a 64-bit sketch of each set.

A set's signature has ``HASHES`` minima. Runs of ``rows`` of them are the buckets:
two sets of Jaccard similarity j share one with probability 1 - (1 - j^rows)^(HASHES // rows).
One bit of each minimum makes up the sketch: two sets differ in about 32 (1 - j) of its bits.
Sets that share a bucket are verified there and become links, never rows of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, link_labels, plain

HASHES = 64
_MASK = (1 << 64) - 1


def _constants() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and masks drawn by splitmix64 from a fixed seed."""
    out, state = [], 42
    for _ in range(2 * HASHES):
        state = (state + 0x9E3779B97F4A7C15) & _MASK
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    drawn = np.array(out, np.uint64)
    return (drawn[:HASHES] | np.uint64(1)).astype(np.uint32), drawn[HASHES:].astype(np.uint32)


_FACTORS, _XORS = _constants()


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled, so that all its bits depend on all of the input's."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def signatures(values: np.ndarray, starts: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Signatures (sets x ``hashes``) of sets of hashed ``values``; set i runs from ``starts[i]`` and none is empty."""
    out = np.empty((len(starts), hashes), np.uint32)
    ends, at = np.append(starts[1:], len(values)), 0
    while at < len(starts):  # slices that stay in the processor's cache
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + 16_384, "right")))
        piece, first = values[starts[at] : ends[upto - 1]].astype(np.uint32, copy=False), starts[at:upto] - starts[at]
        buffer = np.empty_like(piece)
        for j in range(hashes):
            np.bitwise_xor(piece, _XORS[j], out=buffer)
            np.multiply(buffer, _FACTORS[j], out=buffer)
            out[at:upto, j] = np.minimum.reduceat(buffer, first)
        at = upto
    return out


def sketches(found: np.ndarray) -> np.ndarray:
    """64 bits of the minima, as 64-bit numbers: the first bit of each, then the second of each, and so on."""
    scrambled = mixed(found.astype(np.uint64))
    n = found.shape[1]
    bits = np.empty((len(found), HASHES), np.uint8)
    for at in range(0, HASHES, n):
        level, upto = np.uint64(at // n), min(n, HASHES - at)
        bits[:, at : at + upto] = (scrambled[:, :upto] >> level) & np.uint64(1)
    return np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def buckets(found: np.ndarray, rows: int) -> np.ndarray:
    """Signed 64-bit bucket keys (sets x minima // rows); keys of different runs differ."""
    out = np.empty((len(found), found.shape[1] // rows), np.uint64)
    for k in range(out.shape[1]):
        key = np.full(len(found), k + 1, np.uint64)
        for j in range(k * rows, (k + 1) * rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + found[:, j].astype(np.uint64))
        out[:, k] = key
    return out.view(np.int64)


def _joined(near_to, sets: list, labels: np.ndarray, split: int, similar) -> np.ndarray:
    """Labels after verifying pairs; across ``split`` only, if there is one.

    ``near_to(i, lo)``: which of the sets from ``lo`` on are near enough to set i to be compared.
    """
    _, labels = np.unique(labels, return_inverse=True)  # a copy: numbers of groups
    for i in range(split if split else len(sets)):
        lo = split if split else i + 1
        near = np.flatnonzero(near_to(i, lo)) + lo
        near = near[labels[near] != labels[i]]
        while len(near):
            j, near = near[0], near[1:]
            if similar(sets[i], sets[j]):
                labels[labels == labels[j]] = labels[i]
                near = near[labels[near] != labels[i]]
    _, first, group = np.unique(labels, return_index=True, return_inverse=True)
    return first[group]


def _near_by(prints: np.ndarray, budget: int, minima: np.ndarray | None, least: int):
    """The test of :func:`_joined` by sketches, or by the number of equal minima where they are given."""
    if minima is None:
        return lambda i, lo: np.bitwise_count(prints[lo:] ^ prints[i]) <= budget
    return lambda i, lo: (minima[lo:] == minima[i]).sum(axis=1) >= least


def _whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, bounds): sorted batches cut so that no group of equal ``by`` is torn, and where groups begin, and the end."""
    held = None
    for part in batches:
        part = part if held is None else pd.concat([held, part], ignore_index=True)
        keys = part[by].to_numpy()
        begin = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
        held = part.iloc[begin[-1] :].reset_index(drop=True)
        if len(begin) > 1:
            yield part.iloc[: begin[-1]].reset_index(drop=True), begin
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def verified_links(placed: DataFrame, scratch: Scratch, tile: int, budget: int, similar, minima_of=None, least: int = 0) -> DataFrame:
    """Edges (a, b) of :func:`family_links`, each once."""
    return family_links(placed, scratch, tile, budget, similar, minima_of, least).select("a", "b").distinct()


def closed(links: DataFrame) -> DataFrame:
    """Rows (node, component) of edges (family, a, b) that lie within families, a family to a task: for families of bounded size."""

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, bounds in _whole_groups(batches, ["family"]):
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                nodes, at = np.unique(part[["a", "b"]].to_numpy()[lo:hi], return_inverse=True)
                left, right = at.reshape(-1, 2).T
                yield pd.DataFrame({"node": nodes, "component": nodes[link_labels(np.arange(len(nodes)), left, right)]})

    return links.repartition("family").sortWithinPartitions("family").mapInPandas(close, "node long, component long")


def family_links(placed: DataFrame, scratch: Scratch, tile: int, budget: int, similar, minima_of=None, least: int = 0) -> DataFrame:
    """Edges (family, a, b) that connect all nodes of one family that are ``similar`` and within ``budget`` bits.

    ``minima_of``, if given, makes the signatures of a list of values of ``own``; then
    ``least`` equal minima are asked for instead, which tells more than a sketch.

    ``placed``: rows (family, node, fp, own), written; a node may be in many families.
    ``similar`` compares two values of ``own``. A family of more than ``tile`` nodes is
    dealt out: each tile by itself, then pairs of tiles.
    """
    own = placed.schema["own"].dataType.simpleString()
    sizes = scratch.keep(placed.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")), "sizes")
    dealt = placed.join(sizes, "family").select("family", "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"), "node", "fp", "own")

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, bounds in _whole_groups(batches, ["family", "tile"]):
            prints, sets, labels = part["fp"].to_numpy().view(np.uint64), part["own"].tolist(), np.arange(len(part))
            minima = minima_of(sets) if minima_of else None
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                near_to = _near_by(prints[lo:hi], budget, None if minima is None else minima[lo:hi], least)
                if hi - lo == 2:
                    if near_to(0, 1)[0] and similar(sets[lo], sets[lo + 1]):
                        labels[lo + 1] = lo
                elif hi - lo > 2:
                    labels[lo:hi] = lo + _joined(near_to, sets[lo:hi], labels[lo:hi], 0, similar)
            part["label"] = part["node"].to_numpy()[labels]
            # whole families need no second look, but for their links
            part = part[((part["tiles"] > 1) | (part["label"] != part["node"])).to_numpy()]
            if len(part):
                yield plain(part[["family", "tiles", "tile", "node", "fp", "own", "label"]])

    by = ("family", "tile")
    tiled = dealt.repartition(*by).sortWithinPartitions(*by, "node").mapInPandas(inside, f"family long, tiles int, tile int, node long, fp long, own {own}, label long")
    tiled = scratch.keep(tiled, "tiled")
    scratch.drop(sizes)

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, bounds in _whole_groups(batches, ["family", "i", "j"]):
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                group = part.iloc[lo:hi]
                split = int((group["tile"] == group["tile"].iloc[0]).sum())
                if split == hi - lo:
                    continue
                sets = group["own"].tolist()
                near_to = _near_by(group["fp"].to_numpy().view(np.uint64), budget, minima_of(sets) if minima_of else None, least)
                labels = _joined(near_to, sets, group["label"].to_numpy(), split, similar)
                node = group["node"].to_numpy()
                moved = node[labels] != node
                yield pd.DataFrame({"family": group["family"].to_numpy()[moved], "a": node[moved], "b": node[labels[moved]]})

    crossed = (
        tiled.where("tiles > 1")
        .select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        .where("other <> tile")
        .select("family", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "fp", "own", "label")
    )
    by = ("family", "i", "j")
    links = crossed.repartition(*by).sortWithinPartitions(*by, "tile", "node").mapInPandas(between, "family long, a long, b long")
    return links.union(tiled.where("node <> label").select("family", F.col("node").alias("a"), F.col("label").alias("b")))


#: Sets of a group whose pairs are put in order at once; in larger groups pairs are taken row by row, in passes of falling shares of equal minima.
ORDERED = 128
PASSES = (0.8, 0.65, 0.55, 0.45, 0)


def _group_labels(sets: list, minima: np.ndarray, similar, ratio: float, least: int) -> np.ndarray:
    """For each set the number of the first one to which ``similar`` pairs connect it."""
    n, size = len(sets), np.fromiter(map(len, sets), float, len(sets))
    labels = np.arange(n)
    if n > ORDERED:
        bounds = [minima.shape[1] + 1, *(max(least, int(share * minima.shape[1])) for share in PASSES)]
    else:
        bounds = [minima.shape[1] + 1, least]
    for above, upto in zip(bounds[:-1], bounds[1:], strict=True):
        left, right, equal = [], [], []
        for i in range(n - 1):
            rest = np.flatnonzero(labels[i + 1 :] != labels[i]) + i + 1
            same, z = (minima[rest] == minima[i]).sum(axis=1), size[rest]
            near = (same >= upto) & (same < above) & (np.minimum(z, size[i]) >= ratio * np.maximum(z, size[i]) - 1e-6)
            rest, same = rest[near], same[near]
            if n <= ORDERED:
                left.append(np.full(len(rest), i))
                right.append(rest)
                equal.append(same)
                continue
            rest = rest[np.argsort(-same, kind="stable")]
            while len(rest):
                j, rest = rest[0], rest[1:]
                if similar(sets[i], sets[j]):
                    a, b = sorted((labels[i], labels[j]))
                    labels[labels == b] = a
                    rest = rest[labels[rest] != a]
        if left:
            order = np.argsort(-np.concatenate(equal), kind="stable")
            for i, j in zip(np.concatenate(left)[order].tolist(), np.concatenate(right)[order].tolist(), strict=True):
                if labels[i] != labels[j] and similar(sets[i], sets[j]):
                    a, b = sorted((labels[i], labels[j]))
                    labels[labels == b] = a
    return labels


def verified_groups(batches: Iterator[pd.DataFrame], similar, minima_of, ratio: float, least: int) -> Iterator[pd.DataFrame]:
    """Rows (node, component): of sorted rows (component, node, own) the nodes with others to which ``similar`` pairs connect them.

    Pairs of ``least`` equal minima are compared, those of the most first, and only if
    nothing connects the two yet, so a group of n similar sets takes n - 1 proofs.
    """
    for part, bounds in _whole_groups(batches, ["component"]):
        nodes, sets, labels = part["node"].to_numpy(), part["own"].tolist(), np.arange(len(part))
        minima = minima_of(sets)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            labels[lo:hi] = lo + _group_labels(sets[lo:hi], minima[lo:hi], similar, ratio, least)
        shared = np.bincount(labels, minlength=len(part))[labels] > 1
        out = pd.DataFrame({"node": nodes[shared], "component": nodes[labels[shared]]}).drop_duplicates("node")
        if len(out):
            yield out


#: Buckets are dealt out by the first bits of their keys.
SLOTS = 4096
#: Entries of buckets that are compared at once, about.
ENTRIES = 200_000
#: An entry of a bucket: the next 32 bits of its key, the node, its sketch, and the logarithm of its size in steps of a 2048th.
_ENTRY = np.dtype([("key", "<u4"), ("node", "<i8"), ("fp", "<u8"), ("size", "<u2")])


def entries(nodes: np.ndarray, signed: np.ndarray, sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, entries) of all buckets of ``nodes`` with the signatures ``signed``."""
    keys = buckets(signed, rows).view(np.uint64)
    out = np.empty(keys.shape, _ENTRY)
    out["key"] = (keys >> np.uint64(20)).astype(np.uint32)
    out["node"], out["fp"], out["size"] = nodes[:, None], sketches(signed)[:, None], np.log(sizes * 1.0)[:, None] * 2048
    return (keys >> np.uint64(52)).astype(np.uint16).ravel(), out.ravel()


def blocks(waiting: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(slots, blocks): what :func:`entries` gave, packed into one block a slot."""
    if not waiting:
        return
    slots, own = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
    order = np.argsort(slots, kind="stable")
    slots, own = slots[order], own[order]
    begin = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))
    bounds = np.append(begin, len(slots))
    for at in range(0, len(begin), 256):
        cut = bounds[at : at + 257]
        piece = pa.py_buffer(own[cut[0] : cut[-1]].tobytes())
        offsets = pa.py_buffer(((cut - cut[0]) * _ENTRY.itemsize).astype(np.int32).tobytes())
        yield pa.array(slots[cut[:-1]].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, offsets, piece])


def _met(held: list[tuple[int, bytes]], tile: int, budget: int, ratio: float) -> dict[str, np.ndarray]:
    """family, node, label: nodes with likely company in the whole slots ``held``, linked to a label by their family's near pairs."""
    own = np.frombuffer(b"".join(b for _, b in held), _ENTRY)
    slots = np.repeat(np.array([s for s, _ in held], np.uint64), [len(b) // _ENTRY.itemsize for _, b in held])
    family = slots << np.uint64(32) | own["key"]
    order = np.argsort(family)
    ordered = family[order]
    same = ordered[1:] == ordered[:-1]
    met = np.concatenate((same, [False])) | np.concatenate(([False], same))
    own, family = own[order[met]], ordered[met]
    order = np.lexsort((own["node"], family))
    own, family = own[order], family[order]
    # copies of a node that other tasks have sent
    new = np.concatenate(([True], (family[1:] != family[:-1]) | (own["node"][1:] != own["node"][:-1])))[: len(own)]
    own, family = own[new], family[new]
    begin = np.flatnonzero(np.concatenate(([True], family[1:] != family[:-1])))[: len(own)]
    lengths = np.diff(np.append(begin, len(own)))
    labels, company = np.arange(len(own)), np.zeros(len(own), bool)
    fp, size, most = own["fp"].copy(), own["size"].astype(np.int64), int(-np.log(ratio) * 2048) + 2
    for n in np.unique(lengths[lengths > 1]).tolist():
        starts = begin[lengths == n]
        if n > tile:  # left as they are
            for at in starts.tolist():
                labels[at : at + n], company[at : at + n] = at, True
            continue
        i, j = np.triu_indices(n, 1)
        many = max(1, 2_000_000 // len(i))
        for at in range(0, len(starts), many):
            left, right = ((starts[at : at + many, None] + k).ravel() for k in (i, j))
            near = (np.bitwise_count(fp[left] ^ fp[right]) <= budget) & (np.abs(size[left] - size[right]) <= most)
            left, right = left[near], right[near]
            company[left] = company[right] = True
            link_labels(labels, left, right)
    return {"family": family[company].view(np.int64), "node": own["node"][company], "label": own["node"][labels[company]]}


def company(dealt: DataFrame, ddl: str, tile: int, budget: int, ratio: float) -> DataFrame:
    """Rows ``ddl`` of ``dealt`` as they are, and (family, node, label) for nodes with likely company in a bucket; the others null.

    ``dealt``: ``ddl``, slot, block; a row has a block of :func:`blocks` or the rest.
    Company is likely if sketches differ in ``budget`` bits at most and the smaller size
    is ``ratio`` of the larger at least. Near pairs connect a node to the label of its
    family; in buckets of more than ``tile`` nodes all are taken for near.
    """
    own = len(dealt.columns) - 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def found() -> Iterator[pa.RecordBatch]:
            if held:
                made = _met(held, tile, budget, ratio)
                count = len(made["node"])
                if count:
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(count, t) for t in types), *(pa.array(made[k]) for k in added)], names=[*names, *added])

        for batch in batches:
            names, types = batch.schema.names[:own], batch.schema.types[:own]
            block = batch.column(own + 1)
            rest = batch.filter(block.is_null())
            if rest.num_rows:
                yield pa.RecordBatch.from_arrays([*rest.columns[:own], *(pa.nulls(rest.num_rows, pa.int64()) for _ in added)], names=[*names, *added])
            sent = batch.filter(block.is_valid())
            for slot, bytes_ in zip(sent.column(own).to_pylist(), sent.column(own + 1).to_pylist(), strict=True):
                if n >= ENTRIES and slot != held[-1][0]:
                    yield from found()
                    held, n = [], 0
                held.append((slot, bytes_))
                n += len(bytes_) // _ENTRY.itemsize
        yield from found()

    added = ["family", "node", "label"]
    return dealt.repartition("slot").sortWithinPartitions("slot").mapInArrow(rows, ", ".join([ddl, *(f"{k} long" for k in added)]))


def once_each(met: DataFrame) -> DataFrame:
    """Rows (family, node) of ``met``, written: of families with the same nodes one is enough."""
    alike = met.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.bit_xor(F.xxhash64("node")).alias("who"))
    return met.join(alike.groupBy("n", "low", "who").agg(F.min("family").alias("family")).select("family"), "family")


#: Keys of buckets with company are broadcast if they are at most so many (16 bytes each, twice that as a hash table).
BROADCAST_BUCKETS = 500_000


def met_in_buckets(signed: DataFrame, scratch: Scratch, tile: int, budget: int, ratio: float) -> DataFrame:
    """Rows (family, node), written: nodes of ``signed`` in the buckets where they have likely company.

    ``signed``: rows (node, fp, size, buckets) of distinct nodes. Company is likely if
    sketches differ in ``budget`` bits at most and the smaller size is ``ratio`` of the
    larger at least. Of buckets with the same nodes one is enough. Buckets of more than
    ``tile`` nodes are left as they are: they are dealt out where they are verified.
    """
    keyed = signed.select("node", "fp", "size", F.explode("buckets").alias("family"))
    crowded = scratch.keep(keyed.groupBy("family").count().where("count > 1").select("family"), "crowded")
    few = crowded.count() <= BROADCAST_BUCKETS
    all_met = scratch.keep(keyed.join(F.broadcast(crowded) if few else crowded, "family").select("family", "node", "fp", "size"), "all_met")
    scratch.drop(crowded)
    alike = all_met.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.bit_xor(F.xxhash64("node")).alias("who"))
    alone = scratch.keep(alike.groupBy("n", "low", "who").agg(F.min("family").alias("family")).select("family", "n"), "alone")

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, bounds in _whole_groups(batches, ["family"]):
            fp, size, keep = part["fp"].to_numpy().view(np.uint64), part["size"].to_numpy(float), np.zeros(len(part), bool)
            lengths = np.diff(bounds)
            lo = bounds[:-1][lengths == 2]
            keep[lo] = (np.bitwise_count(fp[lo] ^ fp[lo + 1]) <= budget) & (np.minimum(size[lo], size[lo + 1]) >= ratio * np.maximum(size[lo], size[lo + 1]))
            keep[lo + 1] = keep[lo]
            for lo, hi in zip(bounds[:-1][lengths > 2].tolist(), bounds[1:][lengths > 2].tolist(), strict=True):
                f, z = fp[lo:hi], size[lo:hi]
                near = (np.bitwise_count(f[:, None] ^ f) <= budget) & (np.minimum(z[:, None], z) >= ratio * np.maximum(z[:, None], z))
                np.fill_diagonal(near, False)
                keep[lo:hi] = near.any(axis=1)
            if keep.any():
                yield part.loc[keep, ["family", "node"]]

    dealt = all_met.join(alone, "family")
    small = dealt.where(F.col("n") <= tile).select("family", "node", "fp", "size").repartition("family").sortWithinPartitions("family").mapInPandas(likely, "family long, node long")
    met = scratch.keep(small.unionByName(dealt.where(F.col("n") > tile).select("family", "node")), "met")
    scratch.drop(all_met, alone)
    return met

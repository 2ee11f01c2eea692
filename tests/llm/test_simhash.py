import random

import pytest

from lodestone.llm import simhash

SCHEMA = "doc_id long, text string"


def brute(rows):
    """doc_id -> (fingerprint, component) by comparing all pairs."""
    import xxhash

    def fp(text):
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in "\t\n\v\f\r"}).split(" ") if w]
        if not words:
            return 0
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [(d, fp(t)) for d, t in rows]
    comp = {d: d for d, _ in prints}
    changed = True
    while changed:
        changed = False
        for a, x in prints:
            for b, y in prints:
                if (x ^ y).bit_count() <= 4 and comp[a] > comp[b]:
                    comp[a], changed = comp[b], True
    return {(d, f"{x:016x}", comp[d]) for d, x in prints}


def texts(seed=1, n=60):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    out = []
    for _ in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 200))]
        out.append(" ".join(words))
        for _ in range(rnd.choice((0, 0, 3))):
            copy = list(words)
            if copy:
                copy[rnd.randrange(len(copy))] = "edited"
            out.append("\n".join(copy).upper())
    return out


def test_matches_brute_force(spark):
    rows = list(enumerate(["", None, " \n", "one", "One", "two words", "x" * 100_000, "ä Ä é", "Ä ä é", *texts()]))
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in got.collect()} == brute(rows)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def crowded(seed=5):
    """Families of fingerprints a few bits apart, and others."""
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(3)]
    values = {b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3))) for b in base for _ in range(60)}
    return sorted(values | {rnd.getrandbits(64) for _ in range(50)})


def groups_of(values, links):
    comp = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if (comp[a], comp[b]) != (low, low):
                comp[a] = comp[b] = low
                changed = True
    return comp


@pytest.mark.parametrize(("tile", "budget"), [(8, 4), (60, 9), (16384, 0)])
def test_node_pairs_are_traversed_by_spark_and_tasks(spark, monkeypatch, tile, budget):
    monkeypatch.setattr(simhash, "TILE", tile)
    values = crowded()
    scratch = simhash.Scratch(spark, "test")
    prints = scratch.keep(spark.createDataFrame([(signed(v),) for v in values], "fp long"), "prints")
    found = [(r["a"], r["b"]) for r in simhash.fingerprint_links(prints, scratch, budget).collect()]
    near = [(signed(x), signed(y)) for i, x in enumerate(values) for y in values[:i] if (x ^ y).bit_count() <= budget]
    own = [signed(v) for v in values]
    assert groups_of(own, found) == groups_of(own, near)


def test_inner_nodes_are_visited_and_pruned():
    import numpy as np

    rnd = random.Random(3)
    values = sorted({rnd.getrandbits(64) for _ in range(4000)})
    values = np.array(sorted({*values, *(v ^ 1 << rnd.randrange(64) for v in values[::10])}), np.uint64)
    seen = {}
    labels = simhash.trie_links(values, None, 0, 0, 4, seen)
    near = np.array([[(int(x) ^ int(y)).bit_count() <= 4 for y in values[:300]] for x in values[:300]])
    assert seen["visited"] > 10 * len(values) and seen["pruned"] > len(values)
    assert all(labels[i] == labels[j] for i, j in zip(*np.nonzero(near)))
    assert len(set(labels.tolist())) == len(values) - 400


def test_any_long_is_an_id(spark):
    ids = [(1 << 53) + 1, None, (1 << 60) + 3, 1 << 62, -(1 << 60) - 1, (1 << 63) - 1]
    docs = spark.createDataFrame([(d, f"some words of text {i} that differ {i * i} quite {i * 7} well") for i, d in enumerate(ids)], SCHEMA).coalesce(1)
    got = simhash.near_duplicates(docs).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(map(str, ids))
    assert all(r["component_id"] == r["doc_id"] for r in got)


def test_edges_of_the_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(7, "a b c d e", "z"), (7, "a b c d e", "z"), (None, "a b c d e", "z"), (None, "quite another text here", "z"), (9, None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string"))
    found = sorted(((r["doc_id"], r["component_id"]) for r in got.collect()), key=str)
    assert found == sorted([(7, 7), (7, 7), (None, 7), (None, None), (9, 9)], key=str)

import math

import numpy as np
import pytest

from lodestone.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def brute(rows):
    """(id, links, component, kept) per row, from all pairs in double precision."""
    def ok(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    vs = [np.array(v, np.float32).astype(float) if ok(v) else None for _, v in rows]
    n = len(rows)
    links = [[j for j in range(n) if i != j and vs[i] is not None and vs[j] is not None and len(vs[i]) == len(vs[j]) and vs[i] @ vs[j] / (np.linalg.norm(vs[i]) * np.linalg.norm(vs[j])) >= 0.9] for i in range(n)]
    out, seen = [], [None] * n
    for i in range(n):
        if seen[i] is None:
            stack, group = [i], {i}
            while stack:
                for j in links[stack.pop()]:
                    if j not in group:
                        group.add(j)
                        stack.append(j)
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            for k in group:
                seen[k] = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), seen[i], rows[i][0] is not None and rows[i][0] == seen[i]))
    return out


def vectors(n=260, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    centres = rng.normal(size=(25, dim))
    for i in range(n):
        v = centres[rng.integers(25)] + rng.normal(size=dim) * rng.choice([0, 0.05, 0.25, 0.35, 2.0])
        out.append((i, (v * rng.choice([1e-3, 1, 1e3])).astype(np.float32).tolist()))
    nan, inf = float("nan"), float("inf")
    out += [(n, None), (n + 1, [0.0] * dim), (n + 2, [nan] * dim), (n + 3, [inf] + [1.0] * (dim - 1)), (n + 4, [None] + [1.0] * (dim - 1)), (n + 5, []), (n + 6, [1.0, 2.0]), (n + 7, [1.0, 2.1])]
    out += [(None, out[0][1]), (3, out[3][1]), (None, [5.0, -1.0, 3.0]), (None, None)] + [(1000 + i, out[5][1]) for i in range(20)]
    return out


@pytest.mark.parametrize("block", [embeddings.BLOCK, 40])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors()
    got = embeddings.near_duplicates(spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA))
    assert sorted(map(str, map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect()))) == sorted(map(str, brute(rows)))


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 1500)) * rng.choice([1e-6, 1, 1e6], size=(200, 1))
    codes, scale, error = embeddings.quantise(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = codes.astype(np.int64) @ codes.astype(np.int64).T
    assert (embeddings.tile_products(codes, codes) == exact).all()
    near = exact * scale[:, None] * scale
    assert (np.abs(unit @ unit.T - near) <= error[:, None] + error + error[:, None] * error).all()


def test_edges_of_the_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None), (2, []), (None, None)]
    got = embeddings.near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, False)]))

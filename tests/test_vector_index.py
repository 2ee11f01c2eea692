"""The index on disk against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import vector_index

SCHEMA = "id long, v array<double>"


def clustered(n=1200, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 16))
    return [v.tolist() for v in centres[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, 16))]


def brute(rows, asks, k):
    ids = np.array([i for i, v in rows if v is not None and any(v)])
    unit = np.array([v / np.linalg.norm(v) for i, v in rows if v is not None and any(v)])
    out = {}
    for i, v in asks:
        if v is None or not any(v):
            continue
        sims = np.round(unit @ (v / np.linalg.norm(v)), 6)
        near = [j for j in np.lexsort((ids, -sims)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(sims[j])) for j in near]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["similarity"]))
    return out


def test_index_is_exact_with_all_lists_and_reads_less_with_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 50)  # lists of several blocks
    rows = list(enumerate(clustered())) + [(5000, None), (5001, [0.0] * 16)]
    df = spark.createDataFrame(rows, SCHEMA)
    folder = str(tmp_path / "index")
    vector_index.create(df.where("id % 3 <> 0"), "id", "v", folder, lists=16, sample=500)
    vector_index.append(df.where("id % 3 = 0"), "id", "v", folder)
    asks = df.where("id % 40 = 0 OR id >= 5000")
    want = brute(rows, [r for r in rows if r[0] % 40 == 0 or r[0] >= 5000], 5)
    assert found(vector_index.search(asks, "id", "v", folder, 16, 5)) == want
    few = found(vector_index.search(asks, "id", "v", folder, 4, 5))
    recall = np.mean([len({i for i, _ in few[q]} & {i for i, _ in own}) / len(own) for q, own in want.items()])
    assert recall >= 0.9
    files = [len(vector_index.blocks(spark, folder, list(range(n))).select(F.input_file_name()).distinct().collect()) for n in (2, 4, 16)]
    assert files[0] < files[1] < files[2]
    one = vector_index.search(df.where("id = 40"), "id", "v", folder, 2, 5)
    assert "PartitionFilters: [isnotnull(list" in one._jdf.queryExecution().toString() or "PartitionFilters: [list" in one._jdf.queryExecution().toString()


def test_empty_index_and_limits(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    vector_index.create(none, "id", "v", str(tmp_path / "none"), lists=4)
    ask = spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA)
    assert vector_index.search(ask, "id", "v", str(tmp_path / "none"), 4, 5).count() == 0
    vector_index.create(ask, "id", "v", str(tmp_path / "one"), lists=4)
    assert vector_index.search(ask, "id", "v", str(tmp_path / "one"), 4, 5).count() == 0  # itself only
    assert vector_index.search(none, "id", "v", str(tmp_path / "one"), 4, 5).count() == 0
    with pytest.raises(ValueError):
        vector_index.create(ask, "id", "v", str(tmp_path / "bad"), lists=0)


def test_slices_of_queries_keep_equals_in_order(spark):
    """More queries than a slice holds, equal similarities at the k-th place, and vectors without a direction."""
    from lodestone.operators import vector_search

    assert vector_search.ASKED < 300
    rows = [(i, [float(i % 3), 1.0, 0.0] if i % 7 else [0.0, 0.0, 0.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    unit = {i: [x / (sum(y * y for y in v) ** 0.5 or 1.0) for x in v] for i, v in rows}
    got = {}
    for r in vector_search.topk(df, df, "id", "v", 4, 0.5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["similarity"]))
    for q, own in unit.items():
        sims = sorted((-round(sum(a * b for a, b in zip(own, v, strict=True)), 6), i) for i, v in unit.items() if i != q)
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate([x for x in sims if -x[0] >= 0.5][:4])], q

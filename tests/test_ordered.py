"""Order-dependent operators against plain Python."""

import random

import numpy as np

from lodestone.operators import community, graph, merging, ordered, vector_search


def test_merge_similar_is_greedy_not_transitive(spark):
    # a ~ b and b ~ c, but not a ~ c: the chain is not one group
    a, b, c = [1.0, 0.0], [float(np.cos(0.4)), float(np.sin(0.4))], [float(np.cos(0.8)), float(np.sin(0.8))]
    rows = [("g", 1, 0.9, 5, 1, a), ("g", 2, 0.5, 5, 2, b), ("g", 3, 0.4, 5, 3, c), ("h", 4, 0.1, 1, 1, a), ("g", 5, 0.9, 4, 9, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "ctx string, id long, importance double, accessed_at int, access_count int, embedding array<double>")
    got = {(r["grp"], r["primary_id"]): (r["importance"], r["access_count"], r["merged"]) for r in merging.merge_similar(df, "ctx", 0.9).collect()}
    assert got == {("g", 1): (0.9, 3, 2), ("g", 3): (0.4, 3, 1), ("h", 4): (0.1, 1, 1), ("g", 5): (0.9, 9, 1)}


def greedy(rows, threshold):
    """The fold itself: (id, importance, accessed, vector) of one group."""
    rows = sorted(rows, key=lambda r: (-r[1], -r[2], r[0]))
    unit = [None if r[3] is None or not any(r[3]) else np.array(r[3]) / np.linalg.norm(r[3]) for r in rows]
    primary = {}
    for i, r in enumerate(rows):
        if r[0] not in primary:
            primary[r[0]] = r[0]
            if unit[i] is not None:
                for j in range(i + 1, len(rows)):
                    if rows[j][0] not in primary and unit[j] is not None and unit[i] @ unit[j] >= threshold:
                        primary[rows[j][0]] = r[0]
    return primary


def test_primaries_equal_the_fold(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in ("x", "y", None):
        angles = rng.uniform(0, 6, 60)  # dense on a circle: long chains of similar rows
        rows += [(g, len(rows) + i, float(rng.integers(0, 4)), int(rng.integers(0, 3)), [float(np.cos(a)), float(np.sin(a)), 0.0]) for i, a in enumerate(angles)]
    rows += [("x", 1000 + i, 1.0, 0, rows[i % 3][4]) for i in range(40)] + [("x", 2000, 9.0, 9, None), ("x", 2001, 9.0, 9, [0.0] * 3), ("y", 2002, 9.0, 9, None)]
    df = spark.createDataFrame(rows, "ctx string, id long, importance double, accessed_at int, embedding array<double>")
    expect = {}
    for g in ("x", "y", None):
        expect |= greedy([r[1:] for r in rows if r[0] == g], 0.9)
    for block in (4096, 13):
        got = merging.primaries(df, "ctx", 0.9, block).collect()
        assert {r["id"]: r["primary_id"] for r in got} == expect and len(got) == len(rows)
    assert merging.primaries(df.limit(0), "ctx").count() == 0


def test_merged_metadata(spark):
    rows = [("g", 1, 0.9, 5, 1, [1.0, 0.0], {"a": "1"}), ("g", 2, 0.5, 5, 2, [1.0, 0.1], {"a": "2", "b": "2"}), ("g", 3, 0.4, 5, 3, [1.0, 0.0], {"b": "3", "c": "3"}), ("g", 4, 0.4, 5, 3, [0.0, 1.0], None)]
    df = spark.createDataFrame(rows, "ctx string, id long, importance double, accessed_at int, access_count int, embedding array<double>, meta map<string,string>")
    got = {r["primary_id"]: (r["merged"], r["metadata"]) for r in merging.merge_similar(df, "ctx", 0.9, "meta").collect()}
    assert got == {1: (3, {"a": "1", "b": "2", "c": "3"}), 4: (1, None)}


def test_cache_replay_equals_a_cache(spark):
    from collections import OrderedDict

    rnd = random.Random(3)
    rows = [(c, i, rnd.choice("abcdefgh"), float(rnd.randint(0, 60))) for c in (1, 2, None) for i in range(120)]
    expect = {}
    for c in (1, 2, None):
        held = OrderedDict()
        for _, i, k, t in sorted((r for r in rows if r[0] == c), key=lambda r: (r[3], r[1])):
            if k in held and held[k] <= t:
                held.pop(k)
            expect[c, i] = k in held
            if k not in held:
                held[k] = t + 9
                for gone in [x for x, u in held.items() if u <= t]:
                    held.pop(gone)
            held.move_to_end(k)
            while len(held) > 4:
                held.popitem(last=False)
    df = spark.createDataFrame(rows, "c long, i long, k string, t double")
    assert {(r["c"], r["i"]): r["hit"] for r in ordered.cache_replay(df, "c", "k", "t", "i", 4, 9.0).collect()} == expect
    assert 50 < sum(expect.values()) < 300


def test_state_is_carried_over_batches(spark):
    import pyarrow as pa

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(500).selectExpr("IF(id % 5 = 4, NULL, id % 5) AS k", "id")
        got = ordered.carried(df, "k", ["id"], ["id"], list, lambda s, i: s.append(i) or len(s), ("n", "long", pa.int64())).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r["n"] == r["id"] // 5 + 1 for r in got) and len(got) == 500


def test_transcript_chunks(spark):
    rows = [("v", 1.0, 4.0, "a"), ("v", 5.0, 6.0, "b"), ("v", 11.0, 3.0, "c"), ("w", 0.0, 30.0, "d")]
    df = spark.createDataFrame(rows, "video string, start double, duration double, text string")
    got = [tuple(r) for r in ordered.transcript_chunks(df, "video", 10.0).orderBy("grp", "chunk").collect()]
    assert got == [("v", 0, 0.0, 11.0, "a b"), ("v", 1, 11.0, 14.0, "c"), ("w", 0, 0.0, 30.0, "d")]


def test_sliding_log_ignores_denied():
    rnd = random.Random(0)
    for _ in range(200):
        times = sorted(rnd.uniform(0, 50) for _ in range(40))
        allowed = []
        for t in times:
            allowed.append((t, sum(ok and t - 10 < x for x, ok in allowed) < 3))
        assert ordered.sliding_log(times, 10, 3) == [ok for _, ok in allowed]


def test_circuit_breaker(spark):
    rows = [(1, t, t, bad) for t, bad in [(0, True), (1, True), (2, True), (3, False), (40, True), (41, False), (42, True)]]
    df = spark.createDataFrame(rows, "k long, i long, t long, bad boolean")
    got = {r["i"]: r["rejected"] for r in ordered.circuit_breaker(df, "k", "t", "i", "bad", 3, 30.0).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 40: False, 41: False, 42: False}


def test_boundary_chunks_cover_the_text(spark):
    rnd = random.Random(1)
    texts = [None, "", "one", " ".join(f"w{i}{rnd.choice(['', '.', '?'])}{rnd.choice(['', chr(10) * 2]) if rnd.random() < 0.02 else ''}" for i in range(900))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ordered.boundary_chunks(df, "doc_id", "text", 60, 10).orderBy("doc_id", "chunk_index").collect()
    assert {r["doc_id"] for r in rows} == {2, 3}
    mine = [r for r in rows if r["doc_id"] == 3]
    assert mine[0]["start"] == 0 and mine[-1]["end"] == len(texts[3].rstrip())
    assert all(a["end"] > b["start"] > a["start"] for a, b in zip(mine, mine[1:], strict=False))
    assert all(texts[3][r["start"] : r["end"]].strip() == r["content"] for r in mine)


def test_greedy_parents(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 4, 3, 20, 1])], "doc_id long, chunk_index int, tokens int")
    got = [r["parent_index"] for r in ordered.greedy_parents(df, "doc_id", 10).orderBy("chunk_index").collect()]
    assert got == [0, 0, 1, 2, 3]


def test_label_propagation_finds_cliques(spark):
    edges = [(f"a{i}", f"a{j}", 1.0) for i in range(5) for j in range(i)] + [(f"b{i}", f"b{j}", 1.0) for i in range(5) for j in range(i)] + [("a0", "b0", 0.1)]
    links = spark.createDataFrame(edges, "a string, b string, weight double")
    labels = graph.label_propagation(links, 5)
    found = {r["id"]: r["label"] for r in labels.collect()}
    assert len({found[f"a{i}"] for i in range(5)}) == len({found[f"b{i}"] for i in range(5)}) == 1 and len(set(found.values())) == 2
    assert community.modularity(links, labels).first()["modularity"] > 0.4


def test_blocks_of_vectors_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(90)] + [(90, None), (91, [0.0] * 8)], "id long, v array<double>")
    runs = []
    for block in (4096, 16):
        monkeypatch.setattr(vector_search, "BLOCK", block)
        runs.append(sorted(map(tuple, vector_search.topk(df, df.where("id % 9 = 0"), "id", "v", 4, -1.0).collect())))
    assert runs[0] == runs[1] and len(runs[0]) == 40
    sims = df.alias("q").where("q.id = 9").crossJoin(df.alias("c")).select(vector_search.cosine("q.v", "c.v").alias("s"), "c.id").where("id <> 9 and s is not null")
    assert [r["id"] for r in sims.orderBy("s", ascending=False).limit(4).collect()] == [r[1] for r in sorted((r for r in runs[0] if r[0] == 9), key=lambda r: r[3])]


def test_chunks_leave_before_they_fill_a_task(spark, monkeypatch):
    text = " ".join(f"w{i}." for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, None), (None, "a b"), (3, "")], "doc long, text string").coalesce(1)
    whole = sorted(map(tuple, ordered.boundary_chunks(docs, "doc", "text", 8, 2).collect()), key=str)
    monkeypatch.setattr(ordered, "CHARS", 30)
    assert sorted(map(tuple, ordered.boundary_chunks(docs, "doc", "text", 8, 2).collect()), key=str) == whole
    assert "MapInArrow" in ordered.boundary_chunks(docs, "doc", "text")._jdf.queryExecution().executedPlan().toString()

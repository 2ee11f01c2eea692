"""Communities against plain Python: modularity, connectedness, levels."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.operators import community, packed_graph

SCHEMA = "a string, b string, weight double"


def modularity(edges, label):
    m, inside, degree = sum(w for *_, w in edges), 0.0, defaultdict(float)
    for a, b, w in edges:
        inside += w * (label[a] == label[b])
        degree[label[a]] += w
        degree[label[b]] += w
    return inside / m - sum((d / (2 * m)) ** 2 for d in degree.values())


def parts(edges, label):
    """Connected parts of each community, as sets of vertices."""
    near = defaultdict(set)
    for a, b, _ in edges:
        if label[a] == label[b]:
            near[a].add(b)
            near[b].add(a)
    left, out = set(label), []
    while left:
        own, todo = set(), [left.pop()]
        while todo:
            v = todo.pop()
            own.add(v)
            todo += near[v] & left
            left -= near[v]
        out.append(own)
    return out


def of(rows):
    return {r["id"]: r["label"] for r in rows}


def ring(n=30):
    edges = [(f"t{i:02}{x}", f"t{i:02}{y}", 1.0) for i in range(n) for x, y in ("ab", "bc", "ac")]
    return edges + [(f"t{i:02}c", f"t{(i + 1) % n:02}a", 1.0) for i in range(n)]


def random_graph(seed, groups=6, size=8):
    rnd = random.Random(seed)
    names = [(g, f"v{g}{i}") for g in range(groups) for i in range(size)]
    return [(x, y, float(rnd.randint(1, 3))) for i, (g, x) in enumerate(names) for h, y in names[:i] if rnd.random() < (0.6 if g == h else 0.03)]


def test_loops_count_for_degrees_only(spark):
    links = spark.createDataFrame([("x", "x", 3.0), ("x", "y", 1.0), ("y", "y", 3.0), ("y", "z", 1.0), ("z", "z", 3.0), ("z", "x", 1.0)], SCHEMA)
    labels = spark.createDataFrame([("x", "p"), ("y", "p"), ("z", "q")], "id string, label string")
    edges = [tuple(r) for r in links.collect()]
    assert community.modularity(links, labels).first()[0] == pytest.approx(modularity(edges, of(labels.collect())))
    _, history = community.local_moves(links, 4)
    assert max(history) == history[0] == pytest.approx(modularity(edges, {x: x for x in "xyz"}))


def test_ring_of_triangles_needs_a_second_level(spark):
    edges = ring()
    links = spark.createDataFrame(edges, SCHEMA)
    found = community.louvain(links).collect()
    levels = [of(r for r in found if r["level"] == n) for n in range(max(r["level"] for r in found) + 1)]
    scores = [modularity(edges, x) for x in levels]
    assert len(set(levels[0].values())) == 30 and scores[0] == pytest.approx(1 - 1 / 4 - 1 / 30)
    assert len(levels) > 1 and scores == sorted(scores) and scores[-1] > 0.79
    # triangles are merged whole
    assert all(len({levels[-1][f"t{i:02}{x}"] for x in "abc"}) == 1 for i in range(30))
    leiden = of(community.leiden(links).collect())
    assert modularity(edges, leiden) > 0.79 and len(parts(edges, leiden)) == len(set(leiden.values()))


@pytest.mark.parametrize("seed", [1])
def test_leiden_is_connected_and_no_worse(spark, seed):
    edges = random_graph(seed)
    links = spark.createDataFrame(edges, SCHEMA)
    planted = modularity(edges, {v: v[:2] for e in edges for v in e[:2]})
    louvain = modularity(edges, of(community.top_level(community.louvain(links)).collect()))
    found = of(community.leiden(links).collect())
    assert set(found) == {v for e in edges for v in e[:2]}
    assert len(parts(edges, found)) == len(set(found.values()))
    assert modularity(edges, found) >= max(planted, louvain) - 0.01


def test_refined_parts_are_connected_and_inside_their_communities(spark):
    edges = random_graph(3, groups=4)
    links = spark.createDataFrame(edges, SCHEMA)
    names = sorted({v for e in edges for v in e[:2]})
    # communities of two groups each, and one that has nothing to do with links
    given = {v: "odd" if i % 7 == 0 else str(int(v[1]) // 2) for i, v in enumerate(names)}
    refined = of(community.refine(links, spark.createDataFrame(list(given.items()), "id string, label string")).collect())
    assert set(refined) == set(names) and all(given[v] == given[refined[v]] for v in names)
    assert len(parts(edges, refined)) == len(set(refined.values())) < len(names)


def test_connected_splits_long_paths_and_keeps_lone_vertices(spark):
    order = random.Random(4).sample(range(100, 200), 100)
    edges = [(str(a), str(b), 1.0) for a, b in zip(order, order[1:], strict=False)]
    label = {str(v): "one" if i < 60 or i >= 70 else "two" for i, v in enumerate(order)} | {"lone": "one"}
    got = of(community.connected(spark.createDataFrame(list(label.items()), "id string, label string"), spark.createDataFrame(edges, SCHEMA)).collect())
    expect = {v: min(own) for own in parts(edges, label) for v in own}
    assert got == expect and len(set(got.values())) == 4


def test_hierarchy(spark):
    # eight cliques in two rows of four, strongly linked within a row, and one clique apart
    cliques = [[f"{g}{i}" for i in range(4)] for g in "abcdefghz"]
    edges = [(x, y, 1.0) for own in cliques for i, x in enumerate(own) for y in own[:i]]
    edges += [(f"{p}{i}", f"{q}{i}", 1.0) for row in ("abcd", "efgh") for p in row for q in row if p < q for i in range(2)] + [("a0", "e0", 1.0)]
    links = spark.createDataFrame(edges, SCHEMA)
    labels = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("label", F.substring("id", 1, 1))
    rows = community.hierarchy(links, labels).collect()
    low = {r["community"]: r for r in rows if r["level"] == 0}
    assert {c: (r["entity_count"], r["child_count"]) for c, r in low.items()} == {c: (4, 0) for c in "abcdefghz"}
    assert low["z"]["parent"] is None and len({low[c]["parent"] for c in "abcd"}) == len({low[c]["parent"] for c in "efgh"}) == 1
    assert low["a"]["parent"] != low["e"]["parent"]
    high = [r for r in rows if r["level"] == 1]
    assert sorted((r["community"], r["entity_count"], r["child_count"]) for r in high) == sorted((low[c]["parent"], 16, 4) for c in "ae")
    none = community.hierarchy(links.limit(0), labels).collect()
    assert len(none) == 9 and all(r["parent"] is None for r in none)


def test_packed_and_joined_graphs_agree(spark, monkeypatch):
    # ids out of order, weights that aren't whole, loops, a pair apart and links to nowhere
    rnd, drawn = random.Random(5), random_graph(5, groups=7, size=9)
    named = {v: f"{rnd.randrange(10**6)}{v}" for e in drawn for v in e[:2]}
    edges = [(named[a], named[b], w + rnd.random()) for a, b, w in drawn]
    edges += [(x, x, 0.5) for x in list(named.values())[::9]] + [("p", "q", 1.0), ("p", None, 1.0), ("lone", "lone", 2.0)]
    links = spark.createDataFrame(edges, SCHEMA)
    monkeypatch.setattr(packed_graph, "BLOCK", 64)

    def both():
        jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        before = jobs()
        rows = sorted(map(tuple, community.louvain(links, 2, 5).collect())), sorted(map(tuple, community.leiden(links, 2, 5).collect()))
        return rows, jobs() - before

    packed, few = both()
    monkeypatch.setattr(community, "BROADCAST_VERTICES", 10)
    joined, many = both()
    assert packed == joined and {r[1] for r in packed[0]} == {0, 1} and few < many / 2

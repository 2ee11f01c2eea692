"""Seeds, neighbourhoods and confidence against plain loops, with cuts so small that they bite."""

import random

import pytest

from lodestone.functions import classify
from lodestone.operators import grounding, history

WORDS = "alpha beta gamma delta the of hub".split()


@pytest.mark.parametrize("seed", [1, 2])
def test_cuts_change_nothing(spark, seed):
    rnd = random.Random(seed)
    names = {f"v{i:02d}": " ".join(rnd.sample(WORDS, rnd.randint(0, 3)) + ["hub"]) for i in range(40)} | {"v40": None}
    # one vertex that nearly all others touch, loops and repeated links
    links = [(f"v{rnd.randrange(41):02d}", f"v{rnd.randrange(41):02d}") for _ in range(45)] + [("v07", f"v{i:02d}") for i in range(0, 40)] + [(f"v{i:02d}", "v07") for i in range(0, 40, 3)] + [("v01", "v01"), ("v07", "v02")]
    asked = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(0, 3)))) for i in range(8)] + [(8, None), (9, "the of")]
    q = spark.createDataFrame(asked, "query_id long, question string")
    v = spark.createDataFrame(list(names.items()), "id string, name string")
    e = spark.createDataFrame([(a, b, "R") for a, b in links], "src string, dst string, rel string")
    chosen = grounding.seeds(q, v, classify.STOPWORDS, 3)
    found = grounding.entities(chosen, e, 2, 6)

    want_seeds, want = {}, {}
    for i, text in asked:
        terms = {w for w in (text or "").split() if len(w) > 2 and w not in classify.STOPWORDS}
        want_seeds[i] = sorted(k for k, n in names.items() if n and terms & set(n.split()))[:3]
        hop = dict.fromkeys(want_seeds[i], 0)
        for h in (1, 2):
            hop |= {b: h for a, b in links if hop.get(a) == h - 1 and b not in hop}
        want[i] = [(k, hop[k], n + 1) for n, k in enumerate(sorted(hop, key=lambda k: (hop[k], k))[:6])]
    got_seeds, got = {i: [] for i, _ in asked}, {i: [] for i, _ in asked}
    for r in chosen.collect():
        got_seeds[r["query_id"]].append(r["id"])
    for r in found.collect():
        got[r["query_id"]].append((r["id"], r["hop"], r["place"]))
    assert {i: sorted(s) for i, s in got_seeds.items()} == want_seeds
    assert {i: sorted(s, key=lambda x: x[2]) for i, s in got.items()} == want
    assert max(map(len, want.values())) == 6

    linked = grounding.relationships(found, e.distinct())
    inside = {i: {(a, b) for a, b in links if {a, b} <= {x[0] for x in want[i]}} for i, _ in asked}
    sure = {r["query_id"]: r for r in grounding.confidence(q, found, linked, v, 6).collect()}
    assert {i: (r["entities"], r["seeds"], r["relationships"]) for i, r in sure.items()} == {i: (len(want[i]), len(want_seeds[i]), len(inside[i])) for i, _ in asked}
    assert sure[8]["confidence"] == sure[9]["confidence"] == 0.0 and all(0 < sure[i]["confidence"] <= 1 for i in want if want[i])


def test_boost_of_similar_queries(spark):
    near = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 99)], "query_id long, id long")
    given = [(10, 1.0, 1.0)] * 6 + [(11, -0.5, 0.5)] * 6 + [(12, 1.0, 1.0)] * 4 + [(13, -1.0, 1.0)] * 50
    rows = spark.createDataFrame(given, "past long, score double, decay double")
    got = {r["query_id"]: tuple(r)[1:] for r in history.similar_boost(near, rows, "past", "score", "decay").collect()}
    assert got == {1: (2, 12, round(1 + 0.5 * (6 - 1.5) / 9, 6), 0.6, True), 2: (1, 4, 1.0, 0.4, False), 3: (1, 0, 1.0, 0.0, False)}

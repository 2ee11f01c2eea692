import random

import numpy as np

from lodestone.llm import mixing


def test_rates_match_a_local_solver(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.5, 0.2], size=120)
    w = rng.integers(1, 500, size=120)
    rows = spark.createDataFrame([(i, int(w[i]), p[i].tolist()) for i in range(120)], "doc_id long, n_tokens long, posterior array<double>")
    got = {r["doc_id"]: r["rate"] for r in mixing.fit_rates(rows, 3, {2: 0.0}, ridge=0.01, steps=80).collect()}
    share, now = w / w.sum(), (w @ p) / w.sum()
    target = now * [1, 1, 0] / now[:2].sum()
    rate = np.ones(120)
    for _ in range(20_000):  # plain projected gradient descent
        rate = np.maximum(0, rate - 0.5 * (p @ ((share * rate) @ p - target) + 0.01 * (rate - 1)))
    assert np.abs([got[i] for i in range(120)] - rate).max() < 5e-3
    assert min(got.values()) == 0.0


def test_all_targets_are_met_in_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.2, 0.4, 0.1], size=3000)
    w = rng.integers(1, 900, size=3000)
    rows = spark.createDataFrame([(i, int(w[i]), p[i].tolist()) for i in range(3000)], "doc_id long, n_tokens long, posterior array<double>")
    wanted = np.array([0.3, 0.7, 0.0])
    monkeypatch.setattr(mixing, "CELLS", 300)  # coarse ones
    rate = {r["doc_id"]: r["rate"] for r in mixing.fit_rates(rows, 3, dict(enumerate(wanted.tolist())), steps=6).collect()}
    rate = np.array([rate[i] for i in range(3000)])
    assert np.abs((w * rate) @ p / w.sum() - wanted).max() < 0.03 and rate.min() >= 0
    one = rate.copy()
    for _ in range(3000):  # a local descent from there finds nothing much better
        one = np.maximum(0, one - 0.5 * (p @ ((w / w.sum() * one) @ p - wanted) + mixing.RIDGE * (one - 1)))
    cost = lambda r: 0.5 * np.sum(((w * r) @ p / w.sum() - wanted) ** 2) + mixing.RIDGE / 2 * (w / w.sum()) @ (r - 1) ** 2
    assert cost(rate) <= cost(one) * 1.001


def corpus(n=600):
    rnd = random.Random(5)
    words = {d: [f"{d}{i}" for i in range(60)] for d in ("poor", "good", "vile", "any")}
    out = []
    for i in range(n):
        domain = i % 3
        own = words[("poor", "good", "vile")[domain]]
        out.append((i, " ".join(rnd.choice(own if rnd.random() < 0.2 else words["any"]) for _ in range(rnd.randint(40, 90))), domain))
    return out


def test_held_out_accuracy_and_totals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_LABELLED", 250)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(1000, None, "x"), (1001, "", "x"), (5, rows[5][1], "x"), (None, "any1", "x")], "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(i, d) for i, _, d in rows if i < 300] + [(None, 1), (2, None), (9999, 0)], "doc_id long, domain int")
    got = mixing.mix(docs, labels, {2: 0.0}).collect()
    assert len(got) == 604
    held = [r for r in got if r["doc_id"] is not None and 300 <= r["doc_id"] < 600]
    right = sum(int(np.argmax(r["posterior"])) == r["doc_id"] % 3 for r in held)
    assert right >= 0.9 * len(held)
    w, p, rate = (np.array([r[c] for r in got]) for c in ("n_tokens", "posterior", "rate"))
    assert (rate >= 0).all()
    assert abs((w * rate) @ p / w.sum() - np.array([*(((w @ p) / w.sum())[:2] / ((w @ p) / w.sum())[:2].sum()), 0])).max() < 0.06
    by_domain = [np.mean([r["rate"] for r in held if r["doc_id"] % 3 == d]) for d in range(3)]
    assert by_domain[2] < 0.3 < 1 < min(by_domain[:2])


def test_edges_of_the_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, domain int")
    assert mixing.mix(none, labels, {}).count() == 0
    unknown = mixing.mix(spark.createDataFrame([(2, "a b"), (None, None)], "doc_id long, text string"), labels, {1: 0.5}).collect()
    assert [(r["doc_id"], r["n_tokens"], r["posterior"], r["rate"]) for r in unknown] == [(2, 2, [0.5, 0.5], 1.0), (None, 1, [0.5, 0.5], 1.0)]
    one = mixing.mix(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), labels, {}).collect()
    assert [(r["n_tokens"], round(r["rate"], 6)) for r in one] == [(2, 1.0)]
    found = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["domain"] for r in mixing.label_domains(found).collect()} == {1: 2, 2: 0, 3: 1, 4: None}

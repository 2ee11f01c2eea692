"""Words shared with documents in packs, against plain counting."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ranking, term_search

ITEMS = [(1, "aaa bbb aaa ccc ddd"), (2, "bbb bbb eee fff ggg hhh"), (3, "zzz"), (4, None), (5, "")]
DOCS = [(i, " ".join("aaa bbb ccc ddd eee fff ggg hhh xy".split()[j % 9] for j in range(i % 7, i % 7 + i % 12))) for i in range(60)]
DOCS += [(60, None), (61, ""), (7, "aaa bbb aaa ccc"), (None, "bbb bbb"), (None, "eee fff ggg"), (7, "aaa bbb aaa eee")]


def _texts(rows):
    out = {}
    for key, text in rows:
        out.setdefault(key, []).append(text or "")
    return out


@pytest.fixture(params=[(4096, 256, 4_000_000, 4_000_000), (3, 2, 10, 7)])
def tables(spark, request, monkeypatch):
    for name, value in zip(("PACK", "BLOCK", "WORDS", "CELLS"), request.param, strict=True):
        monkeypatch.setattr(term_search, name, value)
    return spark.createDataFrame(ITEMS, "item long, text string"), spark.createDataFrame(DOCS, "doc long, text string").repartition(3)


def test_best_scores_hold_the_first_of_each_item(tables):
    counts = lambda texts: Counter(w for t in texts for w in t.split() if len(w) >= 3)
    want = {}
    for i, said in _texts(ITEMS).items():
        for d, texts in _texts(DOCS).items():
            q, c = counts(said), counts(texts)
            if both := q.keys() & c.keys():
                want[i, d] = (sum(q[w] * c[w] for w in both), len(both))
    got = {(r["item"], r["doc"]): (r["dot"], r["overlap"]) for r in ranking.best_scores(*tables, "item", "doc", "text", 4).collect()}
    assert got.items() <= want.items()
    for at in (0, 1):
        for i in (1, 2):
            first = sorted((-s[at], d) for (x, d), s in want.items() if x == i and d is not None)[:4]
            assert {(i, d) for _, d in first} <= got.keys()


def test_shared_passages_count_different_runs_of_an_id(tables):
    runs = lambda texts: {tuple(w[j : j + 3]) for t in texts for w in [t.split(" ")] for j in range(len(w) - 2)}
    want = {(i, d): len(n) for i, said in _texts(ITEMS).items() for d, texts in _texts(DOCS).items() if (n := runs(said) & runs(texts))}
    got = ranking.shared_passages(*tables, "item", "doc", 3).collect()
    assert len(got) == len(want) and {(r["item"], r["doc"]): r["grade"] for r in got} == want


def test_no_pair_of_a_word_is_a_row(tables, spark):
    """Of documents with ids of their own only the best of each pack leave their task."""
    items, docs = tables
    single, repeated = term_search.by_id(docs, "doc")
    assert single.count() == 61 and repeated.count() == 5
    plan = ranking.best_scores(items, single, "item", "doc", "text", 1)
    many = spark.createDataFrame([(i, "aaa bbb") for i in range(1000)], "doc long, text string").coalesce(1)
    assert ranking.best_scores(items, many, "item", "doc", "text", 1).where(F.col("item") == 1).count() <= 1000 // min(term_search.PACK, 5) + 1
    assert set(plan.columns) == {"item", "doc", "dot", "overlap"}

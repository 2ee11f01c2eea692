import random

import corpus_pipeline
from lodestone.llm import shingles


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stage_links_all_pairs_of_similar_shingles(spark, monkeypatch):
    monkeypatch.setattr(shingles, "TILE", 4)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    texts = ["", "one two", "ONE  two", "quite another short text"]
    for _ in range(25):
        base = [word() for _ in range(rnd.randint(60, 200))]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4):
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(len(copy))] = word()
            texts.append("\n".join(copy).upper())
    group = list(range(len(texts)))
    changed = True
    sets = [grams(t) for t in texts]
    links = [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if len(a & b) >= 0.8 * len(a | b)]
    while changed:
        changed = False
        for i, j in links:
            low = min(group[i], group[j])
            if (group[i], group[j]) != (low, low):
                group[i] = group[j] = low
                changed = True
    assert len(links) > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(docs).collect()} == dict(enumerate(group))
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert {r["doc_id"] for r in kept} == set(group)
    assert shingles.near_duplicates(docs.limit(0)).count() == 0

import random
import re
from collections import Counter

import numpy as np

from lodestone.llm import phrases, queries
from lodestone.llm.common import Scratch
from tests.oracle import compare


def brute(rows, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    out = []
    for (lang, *w), a in found.items():
        longer = [b for (x, *v), b in found.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        cuts = [(2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    by = {}
    for lang, score, a, phrase, left, right in sorted(out):
        by.setdefault(lang, []).append((lang, len(by.get(lang, [])) + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return [r for rows in by.values() for r in rows[:top]]


def texts(seed=0):
    rnd = random.Random(seed)
    words = ["The", "the", "a", "é", "ÉA", "new", "york", "x\x00y", " ", "日本", "'s"]
    out = [(None, None), ("en", ""), ("en", " \t "), ("fr", "...!?"), ("en", "lone")]
    for i in range(300):
        body = "".join(rnd.choice(words) + rnd.choice([" "] * 8 + ["\t", "  ", ". ", "\n", "\r", "\x0b", ";a "]) for _ in range(rnd.randint(1, 40)))
        out.append((rnd.choice(["en", "fr", None, "und"]), body + "in new york city " * rnd.randint(0, 2)))
    return out + [("en", "go go go go go")] * 100


SCHEMA = "lang string, text string, words int, phrase string"


def test_equals_brute_force(spark, monkeypatch):
    rows = texts()
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    runs = []
    for block, fewest, most, least in ((4 << 20, 16, 25, 5), (300, 6, 6, 5), (4 << 20, 16, 25, 300)):
        monkeypatch.setattr(phrases, "BLOCK", block)
        monkeypatch.setattr(phrases, "FEWEST_CELLS", fewest)
        monkeypatch.setattr(phrases, "MOST_CELLS", most)
        monkeypatch.setattr(phrases, "CHUNK", min(4096, 2 << fewest))
        found = phrases.ranked(phrases.collocations(docs, least)).collect()
        assert sorted(map(tuple, found)) == sorted(brute(rows, least))
        runs.append(found)
    assert len(runs[0]) > 50 and len(runs[2]) > 0


def test_sketch_is_never_below_the_counts_and_prunes(spark):
    docs = spark.createDataFrame([(*r, 1, "") for r in texts()], SCHEMA)
    cells = phrases.sketch(phrases._texts(docs, "lang", "text"), 16, Scratch(spark, "sketch"))
    assert cells.max() == 255 and (cells == 0).mean() > 0.5
    block = b"new york . in new york city".replace(b".", b"\n")
    tokens = phrases._tokens(block)
    ids, words = phrases._numbered(tokens)
    two = list(phrases._hashes("en", ids, words))[1]
    bound = np.minimum(*(cells[c] for c in phrases._cells(two[0], 16)))
    true = sum(" ".join(t.lower().split()).count("in new york city") for x, t in texts() if x == "en")
    assert bound[0] >= min(255, true) > 20 and not two[1][1]
    assert phrases._candidates("en", [b"never", b"seen"], cells, 16, 5) == [[], []]


def test_top_and_ties(spark):
    rows = [("en", f"w{i} v{i}. " * 30) for i in range(9)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = phrases.ranked(phrases.collocations(docs), top=4).collect()
    assert [(r["rank"], r["phrase"], r["score"]) for r in got] == [(i + 1, f"w{i} v{i}", 1_000_000) for i in range(4)]
    assert phrases.ranked(phrases.collocations(docs.limit(0))).count() == 0


def test_long_texts_are_cut_between_pieces():
    import pyarrow as pa

    text = b"one two three\n" * 1000 + b"x" * 500
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    blocks = list(phrases._blocks(iter([batch]), 100))
    assert len(blocks) > 100 and Counter(t for _, b in blocks for t in phrases._tokens(b) if t != b"\n") == Counter(text.split())
    assert all(len(b) < 700 for _, b in blocks)


def test_equals_sql(spark):
    ok, said = compare(spark, queries.op12_phrase_mining, queries.oracle_sql()["op12_phrase_mining"], "/root/testdata/sf0.01")
    assert ok, said

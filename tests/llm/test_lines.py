import random

import pandas as pd
import pytest

from lodestone.llm import lines, minhash

SCHEMA = "doc_id long, text string, n_chars long, text_key string"


def brute(rows):
    """doc_id -> removed (line, kept doc, kept line), by comparing all lines by edit similarity alone; and if any are similar."""
    found = []
    for d, t in rows:
        numbers, keys, norms = lines.line_keys(t or "")
        found += [(d, i, k, n) for i, k, n in zip(numbers, keys.tolist(), norms, strict=True)]
    norms = {k: n for *_, k, n in found if n is not None}
    keys = sorted({k for *_, k, _ in found})
    group = {k: k for k in keys}
    fuzzy = sorted(norms)
    links = [(a, b) for i, a in enumerate(fuzzy) for b in fuzzy[:i] if lines.similar(norms[a], norms[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            if (group[a], group[b]) != (low, low):
                group[a] = group[b] = low
                changed = True
    keep = {}
    for d, i, k, _ in found:
        keep[group[k]] = min(keep.get(group[k], (d, i)), (d, i))
    gone = {d: [] for d, _ in rows}
    for d, i, k, _ in found:
        if keep[group[k]] != (d, i):
            gone[d].append((i, *keep[group[k]]))
    return gone, bool(links)


def corpus(seed=7):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    line = lambda n: [rnd.choice(words) for _ in range(n)]
    base = [line(rnd.randint(5, 60)) for _ in range(12)]
    out = []
    for _ in range(80):
        text = []
        for _ in range(rnd.randint(0, 8)):
            x = list(rnd.choice(base)) if rnd.random() < 0.5 else line(rnd.randint(1, 30))
            if rnd.random() < 0.5:
                x[rnd.randrange(len(x))] += "s"
            text.append(" ".join(x) + rnd.choice(["", ".", "!"]))
        out.append("\n".join(text))
    out += [None, "", "\n\n", "one two three four", "Page 12 of 300 in all", "page 7 of 9, in all!", "z " * 20_000, "repeat this very line here\nrepeat this very line here"]
    return list(enumerate(out))


@pytest.mark.parametrize(("tile", "limit"), [(lines.TILE, minhash.BROADCAST_BUCKETS), (4, -1)])
def test_matches_brute_force(spark, monkeypatch, tile, limit):
    monkeypatch.setattr(lines, "TILE", tile)
    monkeypatch.setattr(minhash, "BROADCAST_BUCKETS", limit)
    rows = corpus()
    gone, fuzzy = brute(rows)
    assert fuzzy and any(gone.values())
    docs = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], SCHEMA)
    got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in lines.report(docs).collect()}
    assert got == gone
    kept = {r["doc_id"]: r for r in lines.dedup(docs).collect()}
    for d, t in rows:
        left = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in {g[0] for g in gone[d]})
        if not gone[d]:
            assert kept[d]["text"] == t
        elif left.strip():
            assert (kept[d]["text"], kept[d]["n_chars"], kept[d]["text_key"]) == (left, len(left), "clash")
        else:
            assert d not in kept


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rnd = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 14))) for _ in range(2))
        assert lines.edit_distance(a, b) == plain(a, b)


def test_any_long_is_an_id(spark):
    ids = [(1 << 53) + 1, None, (1 << 60) + 3, 1 << 62, -(1 << 60) - 1]
    docs = spark.createDataFrame([(d, f"one line that all of these texts share\nand {'abcde'[i]} of its own {'vwxyz'[i] * 30}", i) for i, d in enumerate(ids)], "doc_id long, text string, gone int").coalesce(1)
    got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in lines.report(docs).collect()}
    assert got == {d: [] if d == min(x for x in ids if x) else [(0, -(1 << 60) - 1, 0)] for d in ids}
    assert {(r["doc_id"], r["gone"]) for r in lines.dedup(docs).collect()} == {(d, i) for i, d in enumerate(ids)}


def test_words_replaced_in_place_are_within_the_distance():
    rnd = random.Random(2)
    for _ in range(500):
        a = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 20))]
        b = [w if rnd.random() < 0.85 else "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for w in a]
        x, y = " ".join(a), " ".join(b)
        assert lines.similar(x, y) == (lines.edit_distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9)


def test_repeated_and_nameless_rows(spark):
    text = "the very same line of text here\nand one more line of its own"
    rows = [(5, text), (5, text), (None, text), (9, "THE very same line, of text here!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_removed"]) for r in lines.report(docs).collect()) == [("5", 2, 0), ("5", 2, 0), ("9", 1, 1), ("None", 2, 2)]
    assert [r["doc_id"] for r in lines.dedup(docs).collect()] == [5, 5]
    assert lines.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert lines.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fuzzy_repeats_are_found_by_edit_similarity_alone(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 8)))
    rows, n = [], 0
    for size in (8, 12, 20):
        for _ in range(60):
            base = [word() for _ in range(size)]
            copy = list(base)
            copy[rnd.randrange(size)] = word()
            if lines.similar(" ".join(base), " ".join(copy)):
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
                n += 1
    removed = lines.report(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed = 1").count()
    assert n > 150 and removed >= 0.95 * n


def test_short_and_unspaced_lines_take_part(spark):
    rows = [
        (1, "All rights reserved.\nchapter 1\n* * *\n這是一個沒有空格的很長的句子用來測試模糊比對的功能\n短い行"),
        (2, "all rights reserved\nchapter 2\n* * *\n這是一個沒有空格的很長的句子用來測試模糊比對的作用\n短い行"),
        (3, "Chapter 1"),
    ]
    got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(0, 1, 0), (2, 1, 2), (3, 1, 3), (4, 1, 4)], 3: [(0, 1, 1)]}


def test_lines_without_company_move_little(spark, monkeypatch):
    """Bucket keys went through two shuffles and whole texts through one; now blocks of entries go through one, and candidate lines."""
    monkeypatch.setattr(minhash, "BROADCAST_BUCKETS", -1)
    rnd = random.Random(5)
    line = lambda: "".join(rnd.choice("abcdefghij ") for _ in range(300))
    texts = ["\n".join(line() for _ in range(10)) for _ in range(400)]
    texts.append("\n".join(t.split("\n")[3][:-4] + "wxyz" for t in texts[:5]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).localCheckpoint()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(k, -1)
    try:
        before = written()
        removed = lines.report(docs).where("n_removed > 0").select("doc_id", "n_removed").collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        moved = written() - before
    finally:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)
    assert [tuple(r) for r in removed] == [(400, 5)]
    assert moved < 1.5 * sum(map(len, texts)), moved / sum(map(len, texts))


@pytest.mark.parametrize("ordered", [minhash.ORDERED, 2])
def test_a_group_takes_one_proof_a_line(monkeypatch, ordered):
    monkeypatch.setattr(minhash, "ORDERED", ordered)
    base = "a line of some length that many texts hold with one word of their own at its end namely "
    own = [base + x for x in ("alpha", "bravo", "charlie", "delta", "echo", "foxtrot")] + ["another line that is like none of the others but has the same group number as they have"]
    asked = []

    def similar(a, b):
        asked.append((a, b))
        return lines.similar(a, b)

    part = pd.DataFrame({"component": 1, "node": range(10, 10 + len(own)), "own": own})
    (out,) = minhash.verified_groups(iter([part]), similar, lines.signatures, lines.SIMILARITY, lines.LEAST)
    assert out.to_numpy().tolist() == [[n, 10] for n in range(10, 16)] and len(asked) == 5


def test_normalised_lines():
    text = "  A1\u0663\u06644b\u00a0 C--d_e \n\n12 300\n \u0130x \U0001d7d8\U0001d7d9 \u4e2d\u6587 "
    assert lines.normalised_lines(text) == ["a0b c d e", "", "0 0", "i x 0 \u4e2d\u6587"]
    assert lines.normalised_lines(text.split("\U0001d7d8")[0]) == ["a0b c d e", "", "0 0", "i x"]
    assert lines.normalised_lines("") == [""]


@pytest.mark.parametrize("group", [2, 1000])
def test_groups_beyond_a_task_are_verified_in_tiles(spark, monkeypatch, group):
    monkeypatch.setattr(lines, "TILE", 2)
    monkeypatch.setattr(lines, "GROUP", group)
    rows = corpus(8)
    got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)[0]

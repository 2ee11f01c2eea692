import random
import re
from collections import Counter, defaultdict

from lodestone.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = text.split("\n")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines)),
        len(marked),
    )


def brute_kept(rows):
    """doc_id -> (words left, kept), counting lines of all distinct texts with plain dicts."""
    norm = lambda x: " ".join(w.lower() for w in WORD.findall(x))

    def marks(line):
        words = line.split(" ")
        windows = [" ".join(words[i : i + quality.GRAM]).encode() for i in range(len(words) - quality.GRAM + 1)]
        return {("line", line)} | ({("low", min(windows)), ("high", max(windows))} if windows else set())

    texts = {(s or "", t or "") for _, t, s in rows}
    size = Counter(h for h, _ in texts)
    limit = {h: max(quality.MIN_DOCS, n * quality.MIN_SHARE) for h, n in size.items()}
    held = {x: [(norm(y), len(WORD.findall(y))) for y in x[1].split("\n") if norm(y)] for x in texts}
    count = Counter((x[0], m) for x in texts for k in {k for k, _ in held[x]} for m in marks(k))
    above = {k for k, n in count.items() if n > limit[k[0]]}
    own = defaultdict(int)
    for x in texts:
        n = sum(w for k, w in held[x] if not any((x[0], m) in above for m in marks(k)))
        if n >= quality.OWN_WORDS:
            for k in {k for k, _ in held[x]}:
                own[x[0], k] += 1
    template = {(h, m[1]) for h, m in above if m[0] == "line" and own[h, m[1]] > limit[h] and own[h, m[1]] >= quality.OWN_SHARE * count[h, m]}
    out = {}
    for d, t, s in rows:
        x = (s or "", t or "")
        n, *_, r = brute_measures(t)
        left = sum(w for k, w in held[x] if (x[0], k) not in template)
        out[d] = (left, not (n < 20 or 100 * r > 30 * n) and left >= n * quality.LEFT_SHARE)
    return out


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghiä") for _ in range(rnd.randint(2, 7)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    rows, boiler, family = [], [sentence(9) for _ in range(4)], [sentence(12) for _ in range(6)]
    rows += [(None, None), ("", None), (" \n\t", "a"), ("x" * 50_000, "a"), ("# * $ % & | < > " * 20, "a"), ("same line here\n" * 40, "a"), ("word " * 5000, None)]
    for i in range(90):  # own text with the site's lines
        rows.append(("\n".join([boiler[0].upper(), *(sentence(15) for _ in range(rnd.randint(1, 4))), *boiler[1 : rnd.randint(1, 4)]]), "a"))
    for i in range(70):  # a family of near copies: nothing of its own but a word
        rows.append(("\n".join([*family, sentence(3)]), "a"))
    rows += [("\n".join(boiler), "a"), ("\n".join(boiler), "b"), ("\n".join([*boiler, *boiler[:2], sentence(4)]), "a")]
    rows += rows[7:12] * 15  # exact copies
    return [(i, t, s) for i, (t, s) in enumerate(rows)]


def test_depletion_rejects_boilerplate_and_spares_families():
    rows = corpus()
    found = brute_kept(rows)
    boiler = rows[7 + 90 + 70 : 7 + 90 + 72]
    assert [found[d][1] for d, _, s in boiler] == [False, True]  # of host a all template, of host b unknown
    assert sum(found[d][1] for d, _, _ in rows[97:167]) == 70  # the family's lines are not template
    heavy = []
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    shared = [" ".join(word() for _ in range(40)) for _ in range(3)]
    for i in range(60):  # nine tenths of every page are the site's
        heavy.append((i, "\n".join([*shared, " ".join(word() for _ in range(13))]), "h"))
    assert not any(kept for _, kept in brute_kept(heavy).values())


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "clash") for d, t, s in rows], SCHEMA)


def test_matches_brute_force(spark):
    rows = corpus()
    expected = brute_kept(rows)
    assert {k for _, k in expected.values()} == {True, False}
    found = {r["doc_id"]: r for r in quality.assess(frame(spark, rows)).collect()}
    assert len(found) == len(rows)
    for d, t, _ in rows:
        r, m = found[d], brute_measures(t)
        assert tuple(r[x] for x in quality.MEASURES) == m
        assert r["base_failed"] == (m[0] < 20 or 100 * m[4] > 30 * m[0])
        assert (r["words_left"], r["kept"]) == expected[d], d


def test_clean_applies_the_verdict_both_ways(spark, monkeypatch):
    rows = corpus()
    expected = brute_kept(rows)
    texts = {d: t for d, t, _ in rows}
    runs = []
    for limit in (quality.BROADCAST_LINES, -1):
        monkeypatch.setattr(quality, "BROADCAST_LINES", limit)
        out = quality.clean(frame(spark, rows))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
        runs.append({r["doc_id"]: r["text"] for r in out.collect()})
    assert runs[0] == runs[1]
    assert set(runs[0]) == {d for d, (_, kept) in expected.items() if kept}
    assert all(len(WORD.findall(t)) == expected[d][0] for d, t in runs[0].items())
    assert any(t != texts[d] for d, t in runs[0].items())


def test_any_long_is_an_id_and_names_may_clash(spark):
    ids = [(1 << 53) + 1, None, (1 << 60) + 3, 1 << 62, -(1 << 60) - 1]
    rows = [(d, " ".join(f"word{i}{j}" for j in range(30)), None, "s", None if i == 1 else (1 << 60) + i) for i, d in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own_host string, source string, own_lines long").coalesce(1)
    assert sorted(map(str, (r["doc_id"] for r in quality.assess(docs).collect()))) == sorted(map(str, ids))
    assert sorted(map(str, quality.clean(docs).collect())) == sorted(map(str, docs.collect()))


def test_empty_table_and_repeated_rows(spark):
    assert quality.assess(frame(spark, [])).count() == 0
    assert quality.clean(frame(spark, [])).count() == 0
    rows = [(1, "a b " * 3, "s"), (1, "a b " * 3, "s"), (2, None, None)]
    assert sorted((r["doc_id"], r["kept"]) for r in quality.assess(frame(spark, rows)).collect()) == [(1, False), (1, False), (2, False)]

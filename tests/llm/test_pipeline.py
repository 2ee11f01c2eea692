import hashlib
import random

import corpus_pipeline
from lodestone.llm import bpe, lines, quality, shingles, simhash
from lodestone.llm.common import Scratch
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_quality import brute_kept
from tests.llm.test_simhash import brute as brute_groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(8)
    words = {k: [k + "".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(150)] for k in "xyz"}
    line = lambda k: " ".join(rnd.choice(words[k if rnd.random() < 0.5 else "x"]) for _ in range(12))
    rows = []
    for i in range(90):
        kind = "xyz"[i % 3]
        rows.append("\n".join(line(kind) for _ in range(rnd.randint(3, 6))))
    shared = line("x")
    rows += [rows[3], rows[4].upper(), rows[5] + " again", rows[6] + "\n" + shared, rows[9][::-1] + "\n" + shared, "short", None, ""]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)]


def test_each_stage_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "MIN_DOCS", 10**6)  # template lines have tests of their own
    folder = str(tmp_path)
    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 3 != 0), int(i % 3 == 2)) for i in range(0, 90, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    scratch, docs, seen = Scratch(spark, "test"), corpus_pipeline.table(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, folder), name)
        seen.append(docs.collect())
    texts = [{r["doc_id"]: r["text"] for r in s} for s in seen[:-1]]
    assert all(s.schema == corpus_pipeline.table(spark, folder, "documents").schema for s in [docs.sparkSession.read.parquet(f"{folder}/documents.parquet")])
    kept = brute_kept([(d, t, s) for d, t, _, s, _ in rows])
    assert texts[0] == {d: t for d, t, *_ in rows if kept[d][1]}
    gone, _ = brute_lines(sorted(texts[0].items()))
    left = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in {g[0] for g in gone[d]}) for d, t in texts[0].items()}
    assert texts[1] == {d: t for d, t in left.items() if t.strip()} and any(gone.values())
    assert texts[2] == {d: texts[1][d] for d, _, c in brute_groups(sorted(texts[1].items())) if d == c}
    assert set(texts[3]) <= set(texts[2]) and all(texts[2][d] == t for d, t in texts[3].items())
    toxic = [d for d in texts[2] if d < 90 and d % 3 == 2]
    assert sum(d in texts[3] for d in toxic) <= 0.1 * len(toxic)
    assert sum(d in texts[3] for d in texts[2] if d not in toxic) >= 0.9 * (len(texts[2]) - len(toxic))
    for r in seen[-1]:
        assert r["decoded_sha256"] == hashlib.sha256(texts[3][r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == r["n_tokens"] > 0
    assert {r["doc_id"] for r in seen[-1]} == set(texts[3])
    assert all(r["n_chars"] == len(r["text"]) for s in seen[:-1] for r in s)
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, again.collect())) == sorted(map(str, seen[-1]))


def test_empty_table_and_long_ids(spark, tmp_path):
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], COLUMNS).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    some = str(tmp_path / "some")
    ids = [(1 << 53) + 1, None, (1 << 60) + 3, 1 << 62, -(1 << 60) - 1]
    rows = [(d, " ".join("abcde"[i] * 3 + "klmnopqrst"[j % 10] + "uvw"[j // 10] for j in range(30)), "en", "s", 1 if d else None) for i, d in enumerate(ids)]
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{some}/documents.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{some}/labels.parquet")
    assert sorted(map(str, (r["doc_id"] for r in corpus_pipeline.run(spark, some).collect()))) == sorted(map(str, ids))


def test_ids_are_not_rows_and_names_clash(spark, tmp_path):
    """Repeated ids of different texts, null ids, and columns that stages use themselves."""
    folder, rnd = str(tmp_path), random.Random(2)
    text = lambda: "\n".join(" ".join("".join(rnd.choice("abcdefghijklm") for _ in range(6)) for _ in range(12)) for _ in range(4))
    one, two, three, four, five = (text() for _ in range(5))
    rows = [(1, one), (5, one + " "), (5, two), (5, two), (None, one), (None, three), (None, three + " "), (None, four), (7, five), (6, five)]
    extra = [(d, t, "en", "s", len(t), float(i), f"k{i}", i, "x", "y") for i, (d, t) in enumerate(rows)]
    spark.createDataFrame(extra, COLUMNS + ", label double, __id string, text_key long, component_id string, `group` string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = corpus_pipeline.table(spark, folder, "documents")
    kept = corpus_pipeline.near_dedup(spark, docs, folder)
    assert kept.columns == docs.columns
    found = sorted((str(r["doc_id"]), r["text"].strip()) for r in kept.collect())
    assert found == sorted([("1", one), ("5", two), ("None", three), ("None", four), ("6", five)])
    mixed = corpus_pipeline.mix_sources(spark, docs, folder)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)
    # lines that others hold go before, so of each text one row is left for the later stages
    out = corpus_pipeline.run(spark, folder).collect()
    hashes = [hashlib.sha256(t.encode()).hexdigest() for t in (one, two, three, four, five)]
    assert sorted(r["decoded_sha256"] for r in out) == sorted(hashes)


def test_near_copies_by_fingerprints_and_by_shingles(spark, tmp_path):
    """Both ways count: a text whose repeats rule its fingerprint, and one that shares shingles but few bits; groups of either meet."""
    rnd, folder = random.Random(4), str(tmp_path)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(6))
    said, more = [word() for _ in range(100)], [word() for _ in range(60)]
    repeated = said * 40
    loose = [*said, *(word() for _ in range(12))]
    texts = [" ".join(repeated), " ".join(repeated + more), " ".join(loose), " ".join(said), " ".join(word() for _ in range(120))]
    prints = [simhash.fingerprint(t) for t in texts]
    sets = [shingles.shingles(t) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 4 and not shingles.similar(sets[0], sets[1])
    assert (prints[2] ^ prints[3]).bit_count() > 4 and shingles.similar(sets[2], sets[3])
    spark.createDataFrame([(i + 1, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    docs = corpus_pipeline.table(spark, folder, "documents")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()) == [1, 5]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "encode"]
    assert lines.MIN_WORDS == 5 and bpe.LEXICON_WORDS <= 1 << 16

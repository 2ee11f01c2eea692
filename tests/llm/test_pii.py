import hashlib
import math
import random
import re
from collections import Counter

from lodestone.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def brute(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS.values()) for m in re.finditer(p, text) if valid(list(PATTERNS)[k], m[0]))


def test_patterns_match_brute_force():
    rnd = random.Random(2)
    atoms = ["@", "a", "b.c", ".", "-", " ", "1", "23", "255", "256", "+", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.1", "x@y.z", "+1 (555) 123-4567", "é", "_", "%", "\n", "007"]
    for _ in range(4000):
        text = "".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 25)))
        assert [(s, k, e) for s, e, k in pii.base_spans(text)] == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "1 " * 150_000):
        pii.base_spans(text)


def test_disclosing_terms(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
    rows = []
    for i in range(300):
        words = [word() for _ in range(30)]
        if i < 6:
            words += ["Zebrastein", "common", "mail", "ann@example.org,"]
        elif i < 9:
            words += ["zebrastein's", "common", "10.1.2.3"]
        elif i % 3 == 0:
            words += ["common", f"user{i}@example.org"]
        rows.append((i, " ".join(words)))
    rows += [(900 + i, rows[0][1]) for i in range(5)] + [(5, rows[5][1]), (None, None), (950, "")]
    found = {}
    for r in pii.detect(spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string")).collect():
        found[r["doc_id"]] = [(s["start"], s["end"], s["kind"]) for s in r["spans"]]
    texts = {t or "" for _, t in rows}
    held = {t: (pii.entities(t, pii.base_spans(t)), {w for w, _, _ in pii.terms(t, pii.base_spans(t))}) for t in texts}
    n_e, n_t, n_te = Counter(), Counter(), Counter()
    for e, w in held.values():
        n_e.update(e)
        n_t.update(w)
        n_te.update((x, y) for x in e for y in w)
    n = len(texts)
    telling = {p for p, c in n_te.items() if c >= pii.SUPPORT and (p[0].split(":")[0] not in pii.OWNERS or math.log2(n / n_e[p[0]]) >= pii.OWNER_BITS) and math.log2(n * c / (n_t[p[1]] * n_e[p[0]])) >= pii.DISCLOSURE * math.log2(n / n_e[p[0]])}
    assert ("email:ann@example.org", "zebrastein") in telling and not any(t == "common" for _, t in telling)
    names = list(PATTERNS)
    for d, t in rows:
        t = t or ""
        base = [(s, e, names[k]) for s, k, e in brute(t)]
        extra = [(s, e, "term") for w, s, e in pii.terms(t, pii.base_spans(t)) if any((x, w) in telling for x in held[t][0])]
        assert found[d] == sorted(base + extra, key=lambda x: (x[0], [*names, "term"].index(x[2]))), d


def test_both_ways_of_counting_terms_agree(spark, monkeypatch):
    rows = [(i, f"secret{i % 2} word{i} shared bob@site{i % 2}.org") for i in range(12)] + [(i, f"word{i} shared other") for i in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = []
    for limit in (pii.BROADCAST_TERMS, -1):
        monkeypatch.setattr(pii, "BROADCAST_TERMS", limit)
        runs.append(sorted(map(str, pii.detect(docs).collect())))
    assert runs[0] == runs[1]
    assert "term" in runs[0][0]


def test_rare_values_count_toward_their_owners(spark):
    rows = [(i, f"write to Lee at person{i}@lee.example for more word{i}") for i in range(4)] + [(10 + i, f"nothing of note, other{i} here") for i in range(1100)]
    found = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == {"email", "term"} for i in range(4)) and all(not found[10 + i] for i in range(1100))


def test_secrets(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert [(s, e) for s, e, _ in pii.secret_spans(f"k={key}==", [])] == [(2, 44)]
    assert [(s, e) for s, e, _ in pii.secret_spans(f"key: {key}.", [])] == [(5, 45)]
    assert pii.secret_spans("chpfheitschverheiten" * 2 + " 12345678901234567890123456", []) == []


def test_the_querys_base_holds_the_patterns_alone(spark, tmp_path):
    """Secrets and terms are of the method: the hash of the base is that of texts without either."""
    key, names = "sk9fK2mQ8xZ1vB7nL4pT6wR3", list(PATTERNS)
    texts = [f"mail a@b.com key {key} from 10.0.0.1", f"key {key} alone", "call +1 555 123 4567", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op5_pii(spark, str(tmp_path)).collect()}
    assert all("secret:" in got[d]["spans"] for d in (0, 1))
    for d, text in enumerate(texts):
        base = brute(text or "")
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert [got[d][f"n_{n}"] for n in names] == [sum(k == i for _, k, _ in base) for i in range(4)]


def test_any_long_is_an_id(spark):
    ids = [(1 << 53) + 1, None, (1 << 60) + 3, 1 << 62, -(1 << 60) - 1]
    docs = spark.createDataFrame([(d, f"m{i}@a{i}.org", "x", None if i else 1 << 60) for i, d in enumerate(ids)], "doc_id long, text string, text_key string, new_text long").coalesce(1)
    found = pii.detect(docs)
    assert sorted(map(str, (r["doc_id"] for r in found.collect()))) == sorted(map(str, ids))
    out = pii.redact(docs, found).collect()
    assert {(r["doc_id"], r["text"], r["text_key"], r["new_text"]) for r in out} == {(d, "[EMAIL]", "x", None if i else 1 << 60) for i, d in enumerate(ids)}


def test_redaction_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co now or call +49 (30) 123456"), (2, None)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs, pii.detect(docs)).collect()}
    assert out == {1: "mail [EMAIL] now or call [PHONE]", 2: None}  # a null text stays null
    assert pii.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_few_telling_terms_are_sent_to_the_texts(spark, monkeypatch):
    rows = [(i, f"write to ann{i % 2}@corp{i % 2}.example about zyx{i % 2}project, text {'abcdefghijkl'[i]}") for i in range(12)]
    rows += [(100 + i, f"plain text {i} of other things") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pii.detect(docs)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        sent = sorted(map(str, found.collect()))
        monkeypatch.setattr(pii, "BROADCAST_TERMS", -1)
        joined = pii.detect(docs)
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, joined.collect())) == sent
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("'term'" in r for r in sent)

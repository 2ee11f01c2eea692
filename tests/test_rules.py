"""Rules and operators beyond the tables: edges, and results known from elsewhere."""

import hashlib
import hmac
import random
import uuid

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import keyed, markup
from lodestone.operators import chunking, code, community, evidence, graph, multi_vector
from lodestone.streaming import jobs


def test_keyed_hash_and_name_ids(spark):
    rows = spark.createDataFrame([("a",), ("",), ("\u00fcber 1:2",)], "m string")
    got = rows.select("m", keyed.hmac_sha256(b"key", F.col("m")).alias("h"), keyed.name_uuid(str(uuid.NAMESPACE_URL), F.col("m")).alias("u")).collect()
    for r in got:
        assert r["h"] == hmac.new(b"key", r["m"].encode(), hashlib.sha256).hexdigest()
        assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["m"]))


def test_markup(spark):
    one = spark.range(1)
    col = lambda c: one.select(c.alias("x")).first()["x"]
    none = F.array().cast("array<string>")
    rows = F.array(F.array(F.lit("a|b"), F.lit("c")), F.array(F.lit("d")))
    assert col(markup.table_markdown(none, rows)) == "|---|---|\n| a\\|b | c |\n| d |"
    assert col(markup.table_markdown(none, F.array().cast("array<array<string>>"))) == ""
    assert [dict(m) for m in col(markup.row_maps(F.array(F.lit("h"), F.lit("k")), rows))] == [{"h": "a|b", "k": "c"}, {"h": "d", "k": ""}]
    assert col(markup.summary(F.lit("x"))) == "A community of related entities" and col(markup.keywords(F.lit("x"))) == []
    assert col(markup.normal_path(F.lit("//./././a\\b"))) == "a/b"
    assert [col(markup.requirement(F.lit(x))) for x in ("", "# a", "a-b[c]>=1 ; x", "-e g~=2", "p @ https://q")] == [None, None, "a-b", "g", "p"]
    assert col(markup.masked_proxy(F.lit("http://u@H:1/p"))) == "http://***:***@h:1" and col(markup.masked_proxy(F.lit("http://h:1/p"))) == "http://h:1/p"
    assert col(markup.overlap(F.lit("abcab"), F.lit("abx"), 10)) == 2 and col(markup.overlap(F.lit(""), F.lit("ab"), 10)) == 0


def test_windows_of_words(spark):
    texts = [None, "", " \n", "one", " ".join(map(str, range(10))), " ".join(map(str, range(11)))]
    got = chunking.windows(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), ["id"], F.col("t"), 4, 1).collect()
    found = {(r["id"], r["chunk_index"]): (r["content"], r["tokens"]) for r in got}
    expected = {(3, 0): ("one", 1)}
    for i, n in ((4, 10), (5, 11)):
        at = k = 0
        while True:
            own = [str(x) for x in range(at, min(at + 4, n))]
            expected[i, k] = (" ".join(own), len(own))
            if at + 4 >= n:
                break
            at, k = at + 3, k + 1
    assert found == expected


def test_redaction_of_properties(spark):
    rows = spark.createDataFrame([({"API_Key": "x", "message": "m" * 200, "n": "1"},), ({},), ({"message": ""},)], "p map<string,string>")
    got = [r["x"] for r in rows.select(evidence.redacted(F.col("p")).alias("x")).collect()]
    assert got == [{"API_Key": "[REDACTED]", "message_hash": hashlib.sha256(b"m" * 100).hexdigest(), "message_length": "200", "n": "1"}, {}, {"message_hash": "", "message_length": "0"}]


def cliques(seed=3, groups=4, size=6):
    """Groups all linked inside, and a few links between them."""
    rnd = random.Random(seed)
    names = [[f"{g}-{i}" for i in range(size)] for g in range(groups)]
    links = [(a, b, 1.0) for own in names for i, a in enumerate(own) for b in own[:i]]
    links += [(names[g][0], names[(g + 1) % groups][rnd.randrange(1, size)], 1.0) for g in range(groups)]
    return names, links


def test_communities_by_modularity(spark):
    names, links = cliques()
    rows = spark.createDataFrame(links, "a string, b string, weight double")
    labels, history = community.local_moves(rows, 12)
    assert max(history) > history[0] and abs(community.modularity(rows, labels).first()[0] - max(history)) < 1e-9
    levels = community.louvain(rows, levels=3, rounds=12).collect()
    top = max(r["level"] for r in levels)
    found = {r["id"]: r["label"] for r in levels if r["level"] == top}
    assert community.modularity(rows, spark.createDataFrame(list(found.items()), "id string, label string")).first()[0] > 0.6
    assert all(len({found[x] for x in own}) == 1 for own in names) and len(set(found.values())) == len(names)


def test_label_propagation_settles_on_two_sides(spark):
    links = spark.createDataFrame([("C1", "S1", 3.0), ("C2", "S1", 2.0), ("C3", "S2", 2.0), ("C4", "S2", 1.0), ("C4", "S1", 0.5)], "a string, b string, weight double")
    turn = F.col("id").startswith("C")
    runs = [sorted(map(tuple, graph.label_propagation(links, n, turn).collect())) for n in (4, 6)]
    assert runs[0] == runs[1]
    label = dict(runs[0])
    assert label["C1"] == label["C2"] == label["S1"] != label["S2"] == label["C3"] == label["C4"]


def test_partitioned_search_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    vectors = (centres[rng.integers(0, 20, 800)] + 0.5 * rng.normal(size=(800, 16))).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None)], "id long, v array<double>")
    index, centroids = multi_vector.partitioned(rows, "id", "v", lists=16, sample=500)
    assert index.count() == 800
    asks = rows.where("id % 20 = 0 AND v IS NOT NULL").select("id", F.col("v").alias("vector"))
    got = {}
    for r in multi_vector.probed(index, centroids, asks, probes=6, k=8).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 800, 20):
        sims = unit @ unit[q]
        sims[q] = -2
        hits += len(set(np.argsort(-sims)[:8].tolist()) & got[q])
    assert hits >= 0.9 * 8 * 40


def test_code_rules(spark):
    files = spark.createDataFrame([("a.py", "@app.get('/x/{id}')\ndef f():\n    return g()\n"), ("b.md", "plain")], "path string, text string")
    assert [tuple(r) for r in code.routes(files).collect()] == [("a.py", "GET", "/x/{id}")]
    assert [tuple(r) for r in code.symbol_lines(files).collect()] == [("a.py", "f", "function", 2)]
    asked = spark.createDataFrame([("GET", "/x/1")], "method string, path string")
    assert [r["confidence"] for r in code.endpoint_checks(asked, code.routes(files).select("method", "template").limit(0)).collect()] == [0.5]
    paths = spark.createDataFrame([("./a.py",), ("x/a.py",), ("../a",), ("q.py",)], "path string")
    assert {r["path"]: (r["verdict"], r["confidence"]) for r in code.path_checks(paths, files).collect()} == {"./a.py": ("known", 1.0), "x/a.py": ("similar", 0.85), "../a": ("outside", 1.0), "q.py": ("missing", 0.8)}
    none = spark.createDataFrame([], "path string, qualified string, part int, content string")
    assert {(r["path"], r["qualified"]) for r in code.or_whole_files(files, none).collect()} == {("a.py", ""), ("b.md", "")}


def test_stages_behind_each_other(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, url string").schema
    crawl = lambda rows: rows.where("url LIKE 'http%'").withColumn("html", F.concat(F.lit("<p>"), "url"))
    parse = lambda rows: rows.select("id", F.replace("html", F.lit("<p>"), F.lit("")).alias("text"))
    index = lambda rows: rows.select("id", F.length("text").alias("n"))
    stages = [("crawl", "id", crawl), ("parse", "id", parse), ("index", "id", index)]
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    jobs.publish(spark.createDataFrame([(1, "http://a"), (2, "ftp://b"), (1, "http://a")], schema), source)
    assert sorted(map(tuple, jobs.staged(spark, source, schema, stages, out).collect())) == [(1, 8)]
    jobs.publish(spark.createDataFrame([(3, "http://ccc"), (1, "http://a")], schema), source)  # started again, they go on
    assert sorted(map(tuple, jobs.staged(spark, source, schema, stages, out).collect())) == [(1, 8), (3, 10)]

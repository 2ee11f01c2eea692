"""Sealed texts, declared packages, verdicts on symbols, guards of alerts and gains of reranking."""

import base64
import difflib

from pyspark.sql import functions as F

from lodestone.functions import keyed, markup
from lodestone.operators import code, scopes, telemetry

KEY = bytes(range(32))


def test_sealed_texts(spark):
    texts = ["", "a", "grüße, 世界 🙂", "x" * 100_000, "enc:", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    sealed = df.withColumn("s", keyed.sealed(KEY, F.col("t"))).cache()
    rows = {r["id"]: r for r in sealed.select("*", keyed.unsealed(KEY, F.col("s")).alias("u"), keyed.unsealed(bytes(32), F.col("s")).alias("wrong"), keyed.unsealed(KEY, F.col("t")).alias("plain")).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert r["u"] == t
        if t is None:
            assert r["s"] is None and r["wrong"] is None
            continue
        assert r["s"].startswith("enc:") and len(base64.urlsafe_b64decode(r["s"][4:])) == 28 + len(t.encode())
        assert r["wrong"] == "<encrypted: InvalidTag>"
        assert r["plain"] == (t if t != "enc:" else "<encrypted: InvalidTag>")
    broken = sealed.where("id = 2").select(keyed.unsealed(KEY, F.concat(F.substring("s", 1, 30), F.lit("!"))).alias("u"), keyed.unsealed(KEY, F.concat(F.col("s"), F.lit("AAAA"))).alias("v")).first()
    assert tuple(broken) == ("<encrypted: InvalidTag>",) * 2


TOML = """
[build-system]
requires = ["hatchling"]
[project]
name = "x"  # dependencies = ["no"]
dependencies = [
  "alpha[extra]>=1", # "beta"
  'gamma ; python_version > "3"',
  "delta @ https://x.example/d#egg",
]
[project.optional-dependencies]
dev = ["epsilon~=2"]
docs = []
"more" = ["zeta"]
[tool.poetry.dependencies]
python = "^3.12"
eta = "1"
theta = { version = "2", extras = ["no"] }
[tool.poetry.group.test.dependencies]
"iota" = "*"
[tool.other]
kappa = "1"
"""


def test_declared_packages(spark):
    docs = ['{"dependencies": {"a": "1", "@x/b": "2"}, "devDependencies": {"c": "*", "a": "1"}, "scripts": {"d": "e"}}', '{"dependencies": ["a"]}', "{", "", None, '{"peerDependencies": {}}']
    got = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, t string").select("i", markup.json_packages(F.col("t")).alias("p"))
    assert {r["i"]: r["p"] for r in got.collect()} == {0: ["@x/b", "a", "c"], 1: [], 2: [], 3: [], 4: [], 5: []}
    got = spark.createDataFrame([(0, TOML), (1, ""), (2, None), (3, "[project]\ndependencies = []")], "i int, t string").select("i", markup.toml_packages(F.col("t")).alias("p"))
    assert {r["i"]: r["p"] for r in got.collect()} == {0: ["alpha", "delta", "epsilon", "eta", "gamma", "iota", "theta", "zeta"], 1: [], 2: [], 3: []}


def test_verdicts_on_symbols(spark):
    names = [("load_file", "function"), ("load_files", "function"), ("Store", "class"), ("store", "method"), ("run", "method"), ("run", "function")]
    table = spark.createDataFrame(names, "name string, kind string")
    asked = [("load_file", "function"), ("load_file", "class"), ("load_fil", None), ("zzz", "function"), ("print", "class"), ("run", None), ("run", "class"), (None, None), ("run", None)]
    got = {(r["name"], r["kind"]): (r["is_valid"], r["confidence"], r["similar"]) for r in code.symbol_verdicts(spark.createDataFrame(asked, "name string, kind string"), table).collect()}
    alike = difflib.get_close_matches("load_fil", sorted({n for n, _ in names}), 5, 0.6)
    assert got == {
        ("load_file", "function"): (True, 1.0, []), ("load_file", "class"): (False, 0.9, ["function"]), ("load_fil", None): (False, 0.85, alike), ("zzz", "function"): (False, 0.8, []),
        ("print", "class"): (True, 1.0, []), ("run", None): (True, 1.0, []), ("run", "class"): (False, 0.9, ["function", "method"]),
    }


def test_symbols_by_language(spark):
    rows = scopes.symbols(spark.createDataFrame([("a.py", "def f():\n    pass"), ("b.tsx", "class A {\n  m() {\n  }\n}"), ("c.md", "def no():\n    pass")], "path string, text string"))
    assert {tuple(r) for r in rows.collect()} == {("a.py", "f", "function", "f", 1, 2), ("b.tsx", "A", "class", "A", 1, 4), ("b.tsx", "m", "method", "A.m", 2, 3)}


def test_guards_and_gains(spark):
    alerts = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.3)], "k string, v double")
    traffic = spark.createDataFrame([("a",)] * 7 + [("b",)] * 6, "k string")
    assert [tuple(r) for r in telemetry.guarded(alerts, traffic, ["k"], 0.6, 10).collect()] == [("a", 0.1, 0.7)]
    before = spark.createDataFrame([(1, 0.5), (1, 0.2), (2, 0.0), (3, 1.0), (4, -1.0), (5, None)], "q long, s double")
    after = spark.createDataFrame([(1, 0.4), (1, 0.25), (2, 1.0), (4, 1.0), (5, 1.0)], "q long, s double")
    assert [tuple(r) for r in telemetry.improvement(before, after, "q", "s").collect()] == [(1, 0.5, 0.4, 0.8)]

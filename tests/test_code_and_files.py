"""Code intelligence, files and crawling on small inputs."""

import difflib
import json
import random

from lodestone.operators import code, crawl, graph, scopes
from lodestone.sources import files

SOURCE = "import os\nfrom a.b import c\n\nclass Store:\n    def get(self):\n        return load(1)\n\ndef load(x):\n    return os.path.join(x)\n"


def test_code_tables(spark):
    df = spark.createDataFrame([("m.py", SOURCE), ("bad.py", "def ("), ("x.js", "import y from 'lib/y'\nconst z = require(\"z\")\nload(2)")], "path string, text string")
    table = code.symbols(df)
    assert {(r["name"], r["kind"], r["qualified"]) for r in table.collect()} == {("Store", "class", "Store"), ("get", "method", "Store.get"), ("load", "function", "load")}
    assert {tuple(r) for r in code.imports(df).collect()} == {("m.py", "os"), ("m.py", "a.b"), ("x.js", "y"), ("x.js", "lib/y"), ("x.js", "z")}
    assert {tuple(r) for r in code.calls(df, table).collect()} == {("m.py", "load", "m.py:load"), ("x.js", "load", "m.py:load")}
    refs = spark.createDataFrame([("Store.get",), ("Other.load",), ("nothing",)], "name string")
    assert {r["name"]: (r["is_valid"], r["confidence"]) for r in code.symbol_checks(refs, table).collect()} == {"Store.get": (True, 1.0), "Other.load": (True, 0.9), "nothing": (False, 0.8)}
    assert code.suggestions(spark.createDataFrame([("lod",)], "name string"), spark.createDataFrame([("load",), ("Store",)], "name string")).first()["similar"] == ["load"]
    chunks = {(r["qualified"], r["part"]): r["content"] for r in code.code_chunks(df, table, 30).collect()}
    assert chunks["load", 0] == "def load(x):" and chunks["load", 1] == "    return os.path.join(x)"


def test_checks(spark):
    one = lambda *m: spark.createDataFrame([(x,) for x in m], "module string")
    got = code.import_checks(one("os.path", "py_arrow", "mine.x", "declared", "none"), one("os"), one("py-arrow"), one("declared", "os"), one("mine"))
    assert {r["module"]: r["origin"] for r in got.collect()} == {"os.path": "stdlib", "py_arrow": "installed", "mine.x": "local", "declared": "declared", "none": "missing"}
    asked = spark.createDataFrame([("GET", "/a/b"), ("GET", "/a/7"), ("PUT", "/a/7"), ("GET", "/x")], "method string, path string")
    routes = spark.createDataFrame([("GET", "/a/b"), ("GET", "/a/{id}")], "method string, template string")
    got = {(r["method"], r["path"]): (r["verdict"], r["confidence"]) for r in code.endpoint_checks(asked, routes).collect()}
    assert got == {("GET", "/a/b"): ("exact", 1.0), ("GET", "/a/7"): ("template", 0.95), ("PUT", "/a/7"): ("wrong_method", 0.9), ("GET", "/x"): ("missing", 0.8)}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿grüß".encode())
    (tmp_path / "b.txt").write_bytes("grüß".encode("latin-1"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7 x")
    found = files.binary_files(spark, str(tmp_path))
    assert {r["path"][-5:]: r["is_pdf"] for r in found.collect()} == {"a.txt": False, "b.txt": False, "c.pdf": True}
    assert {r["path"][-5:]: r["text"] for r in files.decoded(found).collect() if r["path"].endswith("txt")} == {"a.txt": "grüß", "b.txt": "grüß"}
    df = spark.createDataFrame([("x/a.PY", None, "https://youtu.be/abcdefghijk?t=1"), ("y.docx", None, "https://v/watch?v=abcdefghijk"), ("z", "application/pdf", "u"), ("node_modules/q.ts", "x/y", "u")], "path string, mime string, url string")
    rows = df.select("path", files.kind(files.F.col("path"), files.F.col("mime")).alias("k"), files.video_id(files.F.col("url")).alias("v")).collect()
    assert [(r["k"], r["v"]) for r in rows] == [("unknown", "abcdefghijk"), ("word", "abcdefghijk"), ("pdf", None), ("unknown", None)]
    assert [(r["path"], r["language"]) for r in files.scanned(df, ("node_modules",)).collect()] == [("x/a.PY", "python")]
    (tmp_path / "eval.json").write_text(json.dumps({"queries": [{"query_id": "q", "text": "t", "relevant_docs": {"d": 1.0, "e": 0.3}}], "documents": [{"doc_id": "d", "text": "x", "metadata": {}}]}))
    q, d, rel = files.evaluation_set(spark, str(tmp_path / "eval.json"))
    assert (q.count(), d.count(), rel.count()) == (1, 1, 2)


def test_crawl(spark):
    page = lambda *links: "".join(f'<a href="{x}">l</a>' for x in links)
    rows = [("http://h/a", page("/b", "/c/", "http://o/x")), ("http://h/b", page("/a", "/d#f")), ("http://h/c", page("/skip", "/gone")), ("http://h/d", page("/e")), ("http://h/e", ""), ("http://h/skip", ""), ("http://o/x", "")]
    df = spark.createDataFrame(rows, "url string, html string")
    got = {r["url"]: r["depth"] for r in crawl.crawl(df, df.where("url = 'http://h/a'"), 2, exclude="skip").collect()}
    assert got == {"http://h/a": 0, "http://h/b": 1, "http://h/c": 1, "http://h/d": 2}


def test_files_are_dealt_out_by_their_number(spark, monkeypatch):
    """However well code shrinks on its way, a task holds a bounded number of files."""
    monkeypatch.setattr(code, "FILES_A_TASK", 10)
    monkeypatch.setattr(graph, "ROWS_A_TASK", 40)
    some = spark.createDataFrame([(f"f{i}.py", f"class A{i % 7}:\n    def run(self):\n        pass\n\ndef g{i}():\n    pass\n") for i in range(60)] + [("f1.py", "class B:\n    pass\n")], "path string, text string")
    table = code.symbol_lines(some)
    assert code.dealt(some, "path").rdd.getNumPartitions() == 7
    counts = code.symbol_counts(table, 180)
    assert counts._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    assert sorted(map(tuple, counts.collect())) == [("class", 61, 60, 8), ("function", 60, 60, 60), ("method", 60, 60, 1)]
    found = scopes.symbols(some.where("path <> 'f1.py'"))
    plan = code.code_chunks(some, found, headers=True)
    assert "REPARTITION_BY_NUM" in plan._jdf.queryExecution().executedPlan().toString()
    got = {(r["path"], r["qualified"]): r["content"] for r in plan.collect()}
    assert len(got) == 3 * 59 and got["f9.py", "A2.run"] == "class A2:\n    def run(self):\n        pass" and got["f9.py", "g9"] == "def g9():\n    pass"


def test_suggestions_are_the_close_matches_of_all_names(spark, monkeypatch):
    """In packs of a few names, with names that share letters but no two in a row, long names, odd characters and an empty one."""
    monkeypatch.setattr(code, "ASKED", 3)
    monkeypatch.setattr(code, "KNOWN", 9)
    rnd = random.Random(8)
    known = {"".join(rnd.choices("abcé𝄞_", k=rnd.randint(1, 8))) for _ in range(60)} | {"cab", "ab" * 40, "ba" * 38 + "c", "", "a\0b"}
    asked = {"".join(rnd.choices("abcé𝄞_", k=rnd.randint(1, 8))) for _ in range(12)} | {"abc", "ab" * 39 + "c", "", "zzz"}
    got = code.suggestions(spark.createDataFrame([(x,) for x in asked], "name string"), spark.createDataFrame([(x,) for x in known] + [(None,)], "name string"))
    want = {x: difflib.get_close_matches(x, sorted(known), 5, 0.6) for x in asked}
    assert {r["name"]: r["similar"] for r in got.collect()} == {x: y for x, y in want.items() if y}

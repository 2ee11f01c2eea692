"""The code index against full extraction after random edits, and ignore files by rows."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import code, code_index
from lodestone.sources import ignore

SCHEMA = "path string, text string"


def module(rnd):
    names = [f"f{rnd.randrange(12)}" for _ in range(rnd.randint(0, 3))]
    body = "".join(f"def {n}(x):\n    return f{rnd.randrange(14)}(x)\n\n" for n in names)
    return body + (f"class K{rnd.randrange(4)}:\n    def run(self):\n        return K{rnd.randrange(4)}()\n" if rnd.random() < 0.5 else "") + rnd.choice(("", "x = 1\n", "run()\n"))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def same(spark, folder, files):
    df = spark.createDataFrame(list(files.items()), SCHEMA)
    table = code.symbols(df)
    assert rows(code_index.edges(spark, folder), "path", "name", "target") == rows(code.calls(df, table), "path", "name", "target")
    assert rows(code_index.read(spark, folder, "symbols"), "path", "qualified", "first_line", "last_line") == rows(table, "path", "qualified", "first_line", "last_line")
    chunks = code.or_whole_files(df, code.code_chunks(df, table))
    assert rows(code_index.read(spark, folder, "chunks"), "path", "qualified", "part", "content") == rows(chunks, "path", "qualified", "part", "content")


def test_incremental_equals_full(spark, tmp_path):
    rnd = random.Random(4)
    folder = str(tmp_path / "index")
    code_index.create(spark, folder)
    files = {f"src/m{i:02d}.py": module(rnd) for i in range(12)}
    for step in range(3):
        before = dict(files)
        if step:
            for path in rnd.sample(sorted(files), 3):
                files[path] = module(rnd)
            for path in rnd.sample(sorted(files), 2):
                files[f"src/a{step}{path[-5:]}"] = files.pop(path)
        n = code_index.update(spark.createDataFrame(list(files.items()), SCHEMA), folder)
        got = code_index.updates(spark, folder).where(F.col("n") == n).first()
        assert (got["added"], got["removed"]) == (len(files.keys() - (before.keys() if step else set())), len(before.keys() - files.keys()))
        assert got["changed"] == (sum(before[p] != files[p] for p in files.keys() & before.keys()) if step else 0)
        same(spark, folder, files)
    code_index.compact(spark, folder, str(tmp_path / "small"))
    same(spark, str(tmp_path / "small"), files)


def test_only_what_changed_is_read_and_calls_follow_definitions(spark, tmp_path):
    folder = str(tmp_path / "index")
    code_index.create(spark, folder)
    files = {"a.py": "def one():\n    pass\n", "b.py": "def one():\n    pass\n", "c.py": "one()\n", "d.py": "two()\n"}
    code_index.update(spark.createDataFrame([*files.items(), ("a.py", files["a.py"]), (None, "x"), ("e.py", None)], SCHEMA), folder)
    assert rows(code_index.edges(spark, folder), "path", "name", "target") == [("c.py", "one", "a.py:one")]
    del files["a.py"]
    code_index.update(spark.createDataFrame([*files.items(), ("e.py", "")], SCHEMA), folder)
    assert rows(code_index.moved(spark, folder), "path", "name", "target") == [("c.py", "one", "b.py:one")]
    last = spark.read.parquet(f"{folder}/called/g=2").count(), spark.read.parquet(f"{folder}/files/g=2").count()
    assert last == (0, 1)
    # an update that broke off before it was done is not seen, and the next one writes over it
    spark.createDataFrame([("z.py", "ghost")], "path string, name string").write.parquet(f"{folder}/called/g=3")
    spark.createDataFrame([("c.py", None)], "path string, hash string").write.parquet(f"{folder}/files/g=3")
    assert rows(code_index.edges(spark, folder), "path", "name", "target") == [("c.py", "one", "b.py:one")]
    code_index.update(spark.createDataFrame([], SCHEMA), folder)
    assert code_index.edges(spark, folder).count() == code_index.read(spark, folder, "files").count() == 0
    assert code_index.updates(spark, folder).where("n = 3").first()["removed"] == 4


@pytest.mark.parametrize(
    ("text", "path", "expected"),
    [
        ("*.log", "a/b.log", True),
        ("*.log", "a/b.logs", False),
        ("build/", "x/build/a.py", True),
        ("build/", "x/build", False),
        ("/build", "x/build/a.py", False),
        ("/build", "build/a.py", True),
        ("a/b", "c/a/b", False),
        ("**/b/c", "x/y/b/c", True),
        ("a/**/c", "a/c", True),
        ("a/**/c", "a/x/y/c", True),
        ("a/**", "a/x", True),
        ("a/**", "a", False),
        ("*.py\n!keep.py", "x/keep.py", False),
        ("*.py\n!keep.py", "x/other.py", True),
        ("!keep.py\n*.py", "keep.py", True),
        ("dir/\n!dir/a.py", "dir/a.py", True),
        ("# a.py\n\n  \n\\#b.py  ", "#b.py", True),
        ("# a.py", "a.py", False),
        ("f[!0-5].py", "f7.py", True),
        ("f[!0-5].py", "f3.py", False),
        ("f[.py", "f[.py", True),
        ("f?.py", "f12.py", False),
        ("a+b(c).py", "a+b(c).py", True),
        ("a*c", "a/c", False),
        (r"a\*c", "abc", False),
        (r"a\*c", "a*c", True),
        (None, "a", False),
        ("/", "a", False),
    ],
)
def test_ignore_rules(spark, text, path, expected):
    df = spark.createDataFrame([(path, text)], "path string, text string")
    assert df.select(ignore.is_ignored(F.col("path"), ignore.rules(F.col("text")))).first()[0] is expected


def test_files_stay_without_an_ignore_file(spark):
    files = spark.createDataFrame([(1, "a.py", "x"), (2, "a.py", "y"), (None, "a.py", "z")], "repo int, path string, text string")
    given = spark.createDataFrame([(1, "*.py"), (3, "*")], "repo int, text string")
    got = ignore.kept(files, given, "repo")
    assert got.columns == ["repo", "path", "text"]
    assert sorted(r["text"] for r in got.collect()) == ["y", "z"]

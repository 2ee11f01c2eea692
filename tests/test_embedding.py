"""Hashed vectors of texts against a plain version."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from lodestone.operators import embedding


def plain(text, size):
    words = (text or "").lower().split()
    total = Counter()
    for feature in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
        h = hashlib.md5(feature.encode()).hexdigest()
        total[int(h[:8], 16) % size] += 1 - 2 * (int(h[8], 16) % 2)
    norm = math.sqrt(sum(v * v for v in total.values()))
    return [total[i] / norm if norm else 0.0 for i in range(size)]


def test_vectors(spark):
    texts = ["The cat sat on the mat", "the CAT sat", "one", "", "  \n ", None, "grüße aus köln " * 3000, "dog dog dog"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for size in (16, 256):
        got = {r["id"]: r["vector"] for r in embedding.text_vectors(df, F.col("text"), size).collect()}
        for i, text in enumerate(texts):
            assert all(abs(a - b) < 1e-12 for a, b in zip(got[i], plain(text, size), strict=True)), i
    clipped = embedding.text_vectors(df, F.col("text"), 16, clip=11).where("id = 1").first()["vector"]
    assert all(abs(a - b) < 1e-12 for a, b in zip(clipped, plain("the CAT sat", 16), strict=True))
    assert embedding.text_vectors(df.limit(0), F.col("text")).count() == 0
    assert {len(r["vector"]) for r in embedding.text_vectors(df.where("text IS NULL"), F.col("text"), 8).collect()} == {8}


def test_vectors_are_worked_out_once(spark):
    """However often a plan uses the vectors, one Python node makes them."""
    df = embedding.text_vectors(spark.createDataFrame([(1, "a b")], "id long, text string"), F.col("text"))
    used = df.select("id", F.size(F.filter("vector", lambda x: x != 0)).alias("n"), F.array_max("vector").alias("top")).where("n > 0")
    assert used._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and used.first()["n"] == 3

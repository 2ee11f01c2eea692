"""Hits of vector searches gathered into parents or held against what else is known of them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import vector_search
from lodestone.plans import registry
from tests.oracle import rows


def test_scores_of_parents_are_rounded_as_in_sql(spark):
    # best children that end in half a thousandth, with 0 to 3 more beside them
    given = [(n, i * 10 + j, i / 1000 + 0.0005 - (0.1 if j else 0.0)) for n in (1, 2, 3, 4) for i in range(300, 1000) for j in range(n)]
    hits = spark.createDataFrame(given, "query_id long, id long, similarity double")
    got = vector_search.grouped_parents(hits, F.floor(F.col("id") / 10), 1000)
    sql = """
WITH hits AS (SELECT n AS query_id, i * 10 + j AS id, CAST(i AS DOUBLE) / 1000 + 0.0005 - CASE WHEN j > 0 THEN 0.1::DOUBLE ELSE 0.0 END AS similarity FROM range(1, 5) a(n), range(300, 1000) b(i), range(0, 4) c(j) WHERE j < n),
g AS (SELECT query_id, id // 10 AS parent_id, count(*) AS n_children, max(similarity) AS best FROM hits GROUP BY 1, 2),
s AS (SELECT query_id, parent_id, n_children, round(least(1.0, best + least(0.1 * (n_children - 1), 0.2)), 3) AS score FROM g)
SELECT query_id, parent_id, n_children, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS rank FROM s"""
    cur = duckdb.connect().execute(sql)
    assert rows(got.columns, got.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["vec_small_to_big", "small_to_big_walk"])
def test_parents_of_hits_on_a_half(spark, tmp_path, name):
    # a cosine of 0.5005, which as a double lies just below its half
    vectors = [(0, [1.0, 0.0]), (41, [0.5005, (1 - 0.5005**2) ** 0.5]), (81, [0.5, 0.75**0.5]), (121, [0.4, 0.84**0.5])]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in vectors] + [(i, [0.0, 1.0], 0) for i in (40, 80, 120)], "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    df = registry.queries()[name](spark, str(tmp_path))
    assert rows(df.columns, df.collect()) == want


def test_similar_queries_are_sought_among_all_with_feedback(spark, tmp_path):
    # sixty nearer ones have none or corrections alone; of eight farther ones, six have some
    vectors = [(0, [1.0, 0.0])] + [(i, [1.0, i / 1000]) for i in range(1, 61) if i % 20] + [(100 + i, [1.0, 0.5 + i / 100]) for i in range(1, 9)] + [(200, [-1.0, 0.0])]
    events = [(i, "error") for i in range(1, 40)] + [(101, "error")] + [(i, t) for i in range(103, 109) for t in ("view", "error")] + [(200, "view"), (None, "view")]
    for name, data, schema in (("embeddings", vectors, "vec_id long, embedding array<double>"), ("events", events, "user_id long, event_type string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted((r["rank"], r["id"]) for r in registry.queries()["similar_queries"](spark, str(tmp_path)).where("query_id = 0").collect())
    assert got == [(1, 103), (2, 104), (3, 105), (4, 106), (5, 107)]

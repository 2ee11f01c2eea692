"""Evidence for questions out of a graph: seeds by terms, their neighbourhood, what holds it together.

A question keeps a stated number of seeds and of entities, nearest first. The cuts are
made where rows arise, by term, by vertex and by seed, each deep enough that what the
question keeps is the same as with none; so a term that all names share, or a vertex that
all others touch, is never joined whole with every question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text

SEEDS, ENTITIES = 10, 50


def _first(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__place") <= n).drop("__place")


def seeds(questions: DataFrame, vertices: DataFrame, stopwords: tuple[str, ...], n: int = SEEDS) -> DataFrame:
    """(query_id, id): the ``n`` smallest ids of ``vertices`` (id, name) with a term of the question as a term of their name."""
    asked = questions.select("query_id", F.explode(text.terms(F.col("question"), stopwords)).alias("term"))
    named = vertices.select("id", F.explode(text.terms(F.col("name"), ())).alias("term"))
    found = _first(named.join(asked.select("term").distinct(), "term", "left_semi"), ["term"], ["id"], n)
    return _first(asked.join(found, "term").select("query_id", "id").distinct(), ["query_id"], ["id"], n)


def reached(starts: DataFrame, links: DataFrame, hops: int, n: int = ENTITIES) -> DataFrame:
    """(seed, id, hop): the ``n`` nearest vertices of each start (id), by fewest hops along ``links`` (src, dst), then id; itself first.

    The links are taken as they are, once each. Of a vertex at most 2 n links count: at most n
    lead to vertices that are held already, so n new ones are among them.
    """
    near = _first(links.select("src", "dst").distinct(), ["src"], ["dst"], 2 * n)
    held = starts.select(F.col("id").alias("seed"), "id").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        step = held.where(F.col("hop") == hop - 1).join(near, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id"), F.lit(hop).alias("hop"))
        held = _first(held.union(step).groupBy("seed", "id").agg(F.min("hop").alias("hop")), ["seed"], ["hop", "id"], n)
    return held


def entities(chosen: DataFrame, links: DataFrame, hops: int = 2, n: int = ENTITIES) -> DataFrame:
    """(query_id, id, hop, place): the ``n`` nearest vertices of each question's seeds (query_id, id); each seed is walked from once."""
    around = reached(chosen, links, hops, n)
    joined = chosen.select("query_id", F.col("id").alias("seed")).join(around, "seed").groupBy("query_id", "id").agg(F.min("hop").alias("hop"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "id"))
    return joined.withColumn("place", place).where(F.col("place") <= n)


def relationships(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, src, rel, dst): ``edges`` between entities of one question."""
    both = found.select("query_id", F.col("id").alias("src")).join(edges.select("src", "rel", "dst"), "src")
    return both.join(found.select("query_id", F.col("id").alias("dst")), ["query_id", "dst"], "left_semi").select("query_id", "src", "rel", "dst")


def confidence(questions: DataFrame, found: DataFrame, linked: DataFrame, vertices: DataFrame, n: int = ENTITIES) -> DataFrame:
    """(query_id, entities, seeds, relationships, confidence) of every question; 0 without entities.

    0.4 by how many entities there are, 0.4 by the share of the question's terms that
    their names hold (half without terms), 0.2 by how many of their pairs are linked.
    """
    names = found.join(vertices.select("id", F.lower("name").alias("name")), "id")
    counts = names.groupBy("query_id").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("hop") == 0).alias("seeds"), F.collect_list("name").alias("names"))
    links = linked.groupBy("query_id").agg(F.count(F.lit(1)).alias("relationships"))
    rows = questions.join(counts, "query_id", "left").join(links, "query_id", "left")
    terms = F.regexp_extract_all(F.lower("question"), F.lit(r"(\w{3,})"), 1)
    covered = F.size(F.filter(terms, lambda t: F.exists("names", lambda x: F.contains(x, t))))
    coverage = F.when(F.size(terms) == 0, 0.5).otherwise(covered / F.size(terms))
    size, links = F.coalesce("entities", F.lit(0)), F.coalesce("relationships", F.lit(0))
    density = F.when(size > 1, F.least(F.lit(1.0), links / (size * (size - 1)))).otherwise(0.0)
    score = F.least(F.lit(1.0), size / F.lit(float(n))) * 0.4 + coverage * 0.4 + density * 0.2
    sure = F.when(size == 0, 0.0).otherwise(F.round(score + 1e-9, 2))
    return rows.select("query_id", size.alias("entities"), F.coalesce("seeds", F.lit(0)).alias("seeds"), links.alias("relationships"), sure.alias("confidence"))

"""The star schema as a property graph: places, customers, suppliers, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import community, graph
from lodestone.plans.registry import query
from lodestone.sources import table

_V = """
v AS (
  SELECT 'R:' || r_regionkey AS id, 'region' AS type, r_name AS name FROM region
  UNION ALL SELECT 'N:' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'C:' || c_custkey, 'customer', c_name FROM customer
  UNION ALL SELECT 'S:' || s_suppkey, 'supplier', s_name FROM supplier)"""
_P = """
p AS (
  SELECT 'N:' || n_nationkey AS src, 'PART_OF' AS rel, 'R:' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'C:' || c_custkey, 'PART_OF', 'N:' || c_nationkey FROM customer
  UNION ALL SELECT 'S:' || s_suppkey, 'PART_OF', 'N:' || s_nationkey FROM supplier)"""
_O = "o AS (SELECT 'O:' || o_orderkey AS src, 'AUTHORED_BY' AS rel, 'C:' || o_custkey AS dst FROM orders)"
_SP = "sp AS (SELECT 'S:' || l_suppkey AS src, 'RELATED_TO' AS rel, 'P:' || l_partkey AS dst, CAST(avg(CAST(l_discount AS DECIMAL(10,4))) AS DOUBLE) * 10 AS confidence FROM lineitem GROUP BY l_suppkey, l_partkey)"
_BOTH = "ways AS (SELECT src, dst FROM p UNION SELECT dst, src FROM p)"


def _id(prefix, column):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def vertices(spark, sf_dir):
    kinds = [("region", "R", "r_regionkey", "r_name"), ("nation", "N", "n_nationkey", "n_name"), ("customer", "C", "c_custkey", "c_name"), ("supplier", "S", "s_suppkey", "s_name")]
    out = None
    for t, p, key, name in kinds:
        rows = table(spark, sf_dir, t).select(_id(p, key).alias("id"), F.lit(t).alias("type"), F.col(name).alias("name"))
        out = rows if out is None else out.union(rows)
    return out


def part_of(spark, sf_dir):
    kinds = [("nation", ("N", "n_nationkey"), ("R", "n_regionkey")), ("customer", ("C", "c_custkey"), ("N", "c_nationkey")), ("supplier", ("S", "s_suppkey"), ("N", "s_nationkey"))]
    out = None
    for t, a, b in kinds:
        rows = table(spark, sf_dir, t).select(_id(*a).alias("src"), F.lit("PART_OF").alias("rel"), _id(*b).alias("dst"))
        out = rows if out is None else out.union(rows)
    return out


def authored(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(_id("O", "o_orderkey").alias("src"), F.lit("AUTHORED_BY").alias("rel"), _id("C", "o_custkey").alias("dst"))


def related(spark, sf_dir):
    grouped = graph.spread(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg((F.avg(F.col("l_discount").cast("decimal(10,4)")).cast("double") * 10).alias("confidence"))
    return grouped.select(_id("S", "l_suppkey").alias("src"), F.lit("RELATED_TO").alias("rel"), _id("P", "l_partkey").alias("dst"), "confidence")


@query("graph_neighbours", f"WITH {_V}, {_P} SELECT p.src, p.rel, p.dst, v.type AS dst_type, v.name AS dst_name FROM p JOIN v ON v.id = p.dst")
def graph_neighbours(spark, sf_dir):
    """One hop out of every vertex."""
    return graph.neighbours(vertices(spark, sf_dir), part_of(spark, sf_dir))


@query("graph_induced", f"WITH {_V}, {_P}, c AS (SELECT id FROM v WHERE type IN ('nation', 'supplier')) SELECT src, rel, dst FROM p WHERE src IN (FROM c) AND dst IN (FROM c)")
def graph_induced(spark, sf_dir):
    """Edges among nations and suppliers."""
    return graph.induced(part_of(spark, sf_dir), vertices(spark, sf_dir).where("type IN ('nation', 'supplier')"))


@query("graph_orphans", f"WITH {_V}, {_O} SELECT id, type, name FROM v WHERE id NOT IN (SELECT src FROM o UNION SELECT dst FROM o)")
def graph_orphans(spark, sf_dir):
    """Vertices that no order touches."""
    return graph.orphans(vertices(spark, sf_dir), authored(spark, sf_dir))


@query("graph_type_counts", f"WITH {_V}, {_P} SELECT 'vertex' AS kind, type AS name, count(*) AS n FROM v GROUP BY type UNION ALL SELECT 'edge', rel, count(*) FROM p GROUP BY rel")
def graph_type_counts(spark, sf_dir):
    """Vertices and edges by type."""
    v = vertices(spark, sf_dir).groupBy(F.lit("vertex").alias("kind"), F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return v.union(part_of(spark, sf_dir).groupBy(F.lit("edge").alias("kind"), F.col("rel").alias("name")).agg(F.count(F.lit(1)).alias("n")))


@query(
    "graph_distances",
    f"""
WITH RECURSIVE {_P}, {_BOTH},
d(id, hops) AS (SELECT 'R:1', 0 UNION SELECT ways.dst, hops + 1 FROM d JOIN ways ON ways.src = d.id WHERE hops < 4)
SELECT id, min(hops) AS hops FROM d GROUP BY id""",
)
def graph_distances(spark, sf_dir):
    """Hops of every vertex within four of one region."""
    return graph.distances(part_of(spark, sf_dir), spark.createDataFrame([("R:1",)], "id string"), 4)


@query(
    "graph_subgraph",
    f"""
WITH RECURSIVE {_V}, {_P}, {_BOTH},
s AS (SELECT id FROM v WHERE type = 'nation' AND contains(lower(name), '1')),
d(id, hops) AS (SELECT id, 0 FROM s UNION SELECT ways.dst, hops + 1 FROM d JOIN ways ON ways.src = d.id WHERE hops < 1)
SELECT v.id, v.type, v.name, min(hops) AS hops FROM d JOIN v USING (id) GROUP BY ALL""",
)
def graph_subgraph(spark, sf_dir):
    """Nations whose name holds a word, and all they touch."""
    v = vertices(spark, sf_dir)
    seeds = v.where(F.col("type") == "nation").where(F.contains(F.lower("name"), F.lit("1")))
    return v.join(graph.distances(part_of(spark, sf_dir), seeds, 1), "id")


@query(
    "graph_trails",
    f"""
WITH RECURSIVE {_P},
e AS (SELECT src, dst, src || '|' || rel || '|' || dst AS edge FROM p),
ways AS (SELECT src, dst, edge FROM e UNION ALL SELECT dst, src, edge FROM e),
t(start, "end", hops, path, used) AS (
  SELECT 'R:' || r_regionkey, 'R:' || r_regionkey, 0, 'R:' || r_regionkey, []::VARCHAR[] FROM region
  UNION ALL SELECT start, ways.dst, hops + 1, path || '>' || ways.dst, list_append(used, edge) FROM t JOIN ways ON ways.src = t."end" WHERE hops < 3 AND NOT list_contains(used, edge))
SELECT start, "end", hops, path FROM t WHERE hops > 0""",
)
def graph_trails(spark, sf_dir):
    """Walks of up to three edges from the regions through nations, suppliers and customers."""
    return graph.trails(part_of(spark, sf_dir), vertices(spark, sf_dir).where("type = 'region'"), 3)


@query("graph_weighted", f"WITH {_SP} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(max(confidence), 6) AS weight FROM sp GROUP BY 1, 2")
def graph_weighted(spark, sf_dir):
    """Undirected projection of suppliers and parts with weights."""
    return graph.weighted(related(spark, sf_dir), "confidence", table(spark, sf_dir, "lineitem").count()).withColumn("weight", F.round("weight", 6))


_MEMBERS = "m AS (SELECT 'N:' || c_nationkey AS community, 'C:' || c_custkey AS id, c_name AS name FROM customer)"


def _members(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(_id("N", "c_nationkey").alias("community"), _id("C", "c_custkey").alias("id"), F.col("c_name").alias("name"))


@query(
    "graph_communities",
    f"""
WITH {_MEMBERS}, r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY name, id) AS r FROM m)
SELECT community, count(*) AS size, substring(string_agg(substring(name, 1, 50), ', ' ORDER BY r) FILTER (r <= 2) || CASE WHEN count(*) > 2 THEN ' and ' || (count(*) - 2) || ' others' ELSE '' END, 1, 200) AS name
FROM r GROUP BY community HAVING count(*) >= 3""",
)
def graph_communities(spark, sf_dir):
    """Customers by nation as named communities."""
    return graph.communities(_members(spark, sf_dir), 3)


@query("graph_community_counts", f"WITH {_MEMBERS} SELECT 'N:' || n_nationkey AS community, count(m.id) AS n FROM nation LEFT JOIN m ON m.community = 'N:' || n_nationkey GROUP BY 1")
def graph_community_counts(spark, sf_dir):
    """Members of every nation, 0 where there are none."""
    nations = table(spark, sf_dir, "nation").select(_id("N", "n_nationkey").alias("community"))
    return nations.join(_members(spark, sf_dir), "community", "left").groupBy("community").agg(F.count("id").alias("n"))


@query(
    "graph_between",
    """
WITH l AS (SELECT c_custkey, c_nationkey FROM customer), s AS (SELECT s_suppkey, s_nationkey FROM supplier),
e AS (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*) AS n
FROM e JOIN l ON c_custkey = o_custkey JOIN s ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2""",
)
def graph_between(spark, sf_dir):
    """Trade links between nations, both ways counted together."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    links = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(orders, "l_orderkey").select(_id("C", "o_custkey").alias("src"), _id("S", "l_suppkey").alias("dst")).distinct()
    customers = table(spark, sf_dir, "customer").select(_id("C", "c_custkey").alias("id"), F.col("c_nationkey").alias("label"))
    return graph.between(links, customers.union(table(spark, sf_dir, "supplier").select(_id("S", "s_suppkey"), "s_nationkey")))


@query("graph_mentions", "SELECT o_custkey AS id, count(DISTINCT o_orderkey) AS mentions FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-30' - INTERVAL 90 DAY AND o_orderdate < TIMESTAMP '1998-06-30' GROUP BY 1")
def graph_mentions(spark, sf_dir):
    """Orders that mention a customer within ninety days before a date."""
    at = F.expr("TIMESTAMP_NTZ '1998-06-30'")
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= at - F.expr("INTERVAL 90 DAYS")) & (F.col("o_orderdate") < at))
    return orders.groupBy(F.col("o_custkey").alias("id")).agg(F.countDistinct("o_orderkey").alias("mentions"))


_FACTS = """f AS (SELECT l_orderkey, l_linenumber, least(o_orderdate, l_shipdate) AS valid_at, CASE WHEN l_linestatus = 'O' THEN NULL ELSE greatest(o_orderdate, l_shipdate) END AS invalid_at
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def facts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_linestatus").join(orders, "l_orderkey")
    ended = F.when(F.col("l_linestatus") != "O", F.greatest("o_orderdate", "l_shipdate"))
    return lines.select("l_orderkey", "l_linenumber", F.least("o_orderdate", "l_shipdate").alias("valid_at"), ended.alias("invalid_at"))


@query("temporal_valid", f"WITH {_FACTS} SELECT l_orderkey, l_linenumber, valid_at, invalid_at FROM f WHERE valid_at <= TIMESTAMP '1998-06-30' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1998-06-30')")
def temporal_valid(spark, sf_dir):
    """Facts that hold at a date."""
    return graph.valid_at(facts(spark, sf_dir), F.expr("TIMESTAMP_NTZ '1998-06-30'"))


@query("temporal_changes", f"WITH {_FACTS} SELECT l_orderkey, l_linenumber FROM f WHERE valid_at >= TIMESTAMP '1998-01-01' AND valid_at < TIMESTAMP '1998-02-01'")
def temporal_changes(spark, sf_dir):
    """Facts that began from one day to the end of another."""
    start, end = (F.expr(f"TIMESTAMP_NTZ '{d}'") for d in ("1998-01-01", "1998-01-31"))
    return graph.changed_between(facts(spark, sf_dir), "valid_at", start, end).select("l_orderkey", "l_linenumber")


_TRADE = "l AS (SELECT 'C:' || o_custkey AS a, 'S:' || l_suppkey AS b, count(*) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)"


def _trade(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    trade = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(orders, "l_orderkey")
    counted = trade.groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return counted.select(_id("C", "o_custkey").alias("a"), _id("S", "l_suppkey").alias("b"), "weight")


def _propagated(rounds: int) -> str:
    """Rounds of label propagation as a chain of common table expressions."""
    steps = ["w AS (SELECT a, b, weight FROM l UNION ALL SELECT b, a, weight FROM l)", "g0 AS (SELECT DISTINCT a AS id, a AS label FROM w)"]
    for i in range(rounds):
        steps.append(f"v{i} AS (SELECT w.a AS id, g.label, sum(weight) AS votes FROM w JOIN g{i} g ON g.id = w.b GROUP BY 1, 2)")
        steps.append(f"b{i} AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, label) AS r FROM v{i}) WHERE r = 1)")
        steps.append(f"g{i + 1} AS (SELECT g.id, CASE WHEN (g.id[1] = 'C') = {'true' if i % 2 == 0 else 'false'} THEN b.label ELSE g.label END AS label FROM g{i} g JOIN b{i} b USING (id))")
    return f"WITH {_TRADE}, {', '.join(steps)} SELECT id, label FROM g{rounds}"


@query("graph_label_propagation", _propagated(6))
def graph_label_propagation(spark, sf_dir):
    """Communities of the trade between customers and suppliers, the two sides taking labels in turn."""
    return graph.label_propagation(_trade(spark, sf_dir), 6, F.col("id").startswith("C"))


@query("graph_louvain")
def graph_louvain(spark, sf_dir):
    """Communities of the trade by modularity, and communities of these."""
    return community.louvain(_trade(spark, sf_dir))


@query("graph_leiden")
def graph_leiden(spark, sf_dir):
    """Connected communities of the trade, refined before they are merged."""
    return community.leiden(_trade(spark, sf_dir))


@query("graph_hierarchy")
def graph_hierarchy(spark, sf_dir):
    """Nations as communities of their customers and suppliers, grouped by their trade, and groups of these."""
    customers = table(spark, sf_dir, "customer").select(_id("C", "c_custkey").alias("id"), _id("N", "c_nationkey").alias("label"))
    return community.hierarchy(_trade(spark, sf_dir), customers.union(table(spark, sf_dir, "supplier").select(_id("S", "s_suppkey"), _id("N", "s_nationkey"))))

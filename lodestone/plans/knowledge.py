"""Searches and listings of the knowledge graph: entities, communities and their hierarchy, ontology, exports."""

from __future__ import annotations

import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.operators.graph import shared_folder
from lodestone.plans.graph import _BOTH, _O, _P, _V, _id, authored, part_of, vertices
from lodestone.plans.registry import query
from lodestone.sources import ontology, table

_TERMS = ("1", "22", "africa", "zz9")


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("entities_containing", f"WITH {_V} SELECT id, name FROM v WHERE coalesce(contains(lower(name), lower('R#00000000')), false) OR coalesce(contains(lower(type), 'nation'), false)")
def entities_containing(spark, sf_dir):
    """Entities whose name or type holds the query, case aside."""
    held = lambda c, q: F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))
    return vertices(spark, sf_dir).where(held("name", "R#00000000") | held("type", "nation")).select("id", "name")


@query("entities_any_term", f"WITH {_V} SELECT id, type FROM v WHERE len(list_filter(list_filter({_list(_TERMS)}, lambda t: regexp_full_match(t, '[a-z0-9_-]{{2,}}')), lambda t: contains(lower(name), t))) > 0")
def entities_any_term(spark, sf_dir):
    """Entities whose name holds any of the query's terms that are clean and long enough."""
    terms = F.filter(F.array(*map(F.lit, _TERMS)), lambda t: t.rlike(r"\A[a-z0-9_-]{2,}\z"))
    return vertices(spark, sf_dir).where(F.exists(terms, lambda t: F.contains(F.lower("name"), t))).select("id", "type")


@query("entity_same_name", "WITH a AS (SELECT c_custkey, lower(trim(c_name)) AS k FROM customer) SELECT min(c_custkey) AS id, k AS name, count(*) AS n FROM a GROUP BY k")
def entity_same_name(spark, sf_dir):
    """Entities of one name, case and outer blanks aside."""
    return table(spark, sf_dir, "customer").groupBy(F.lower(F.trim("c_name")).alias("name")).agg(F.min("c_custkey").alias("id"), F.count(F.lit(1)).alias("n"))


@query("entities_by_type", f"WITH {_V} SELECT id, name, row_number() OVER (ORDER BY name, id) AS place FROM v WHERE type = 'supplier' ORDER BY name, id LIMIT 50")
def entities_by_type(spark, sf_dir):
    """The first fifty entities of a type by name."""
    first = vertices(spark, sf_dir).where("type = 'supplier'").orderBy("name", "id").limit(50)
    return first.select("id", "name", F.row_number().over(Window.orderBy("name", "id")).alias("place"))  # fifty rows


_SEEDS = "s AS (SELECT id FROM v WHERE type = 'region')"


@query(
    "traversal_result",
    f"""
WITH {_P},
e AS (SELECT src, rel, dst, src || '|' || rel || '|' || dst AS edge FROM p),
ways AS (SELECT src, dst, edge, rel FROM e UNION ALL SELECT dst, src, edge, rel FROM e),
one AS (SELECT w.edge FROM ways w WHERE w.src = 'N:1'),
two AS (SELECT b.edge FROM ways a JOIN ways b ON b.src = a.dst AND b.edge <> a.edge WHERE a.src = 'N:1')
SELECT split_part(edge, '|', 1) AS src, split_part(edge, '|', 2) AS rel, split_part(edge, '|', 3) AS dst FROM (SELECT edge FROM one UNION SELECT edge FROM two)""",
)
def traversal_result(spark, sf_dir):
    """The different edges on all walks of up to two edges from one entity."""
    numbered = part_of(spark, sf_dir).select("src", "rel", "dst", F.concat_ws("|", "src", "rel", "dst").alias("edge"))
    ways = numbered.select("src", "dst", "edge").union(numbered.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge"))
    first = ways.where("src = 'N:1'").select(F.col("dst").alias("at"), F.col("edge").alias("used"))
    second = first.join(ways, first["at"] == ways["src"]).where("edge <> used").select("edge")
    edges = first.select(F.col("used").alias("edge")).union(second).distinct()
    part = F.split("edge", r"\|")
    return edges.select(part[0].alias("src"), part[1].alias("rel"), part[2].alias("dst"))


@query(
    "seeds_first",
    f"""
WITH RECURSIVE {_V}, {_P}, {_BOTH}, s AS (SELECT id FROM v WHERE type = 'nation' AND contains(name, '1')),
d(id, hops) AS (SELECT id, 0 FROM s UNION SELECT ways.dst, hops + 1 FROM d JOIN ways ON ways.src = d.id WHERE hops < 1),
m AS (SELECT id, min(hops) AS hops FROM d GROUP BY id)
SELECT id, hops = 0 AS seed, row_number() OVER (ORDER BY hops, id) AS place FROM m""",
)
def seeds_first(spark, sf_dir):
    """Seeds and all that they touch, each entity once, the seeds first."""
    v = vertices(spark, sf_dir)
    seeds = v.where((F.col("type") == "nation") & F.contains("name", F.lit("1"))).select("id")
    reached = graph.numbered(graph.distances(part_of(spark, sf_dir), seeds, 1), "hops", "id")
    return reached.select("id", (F.col("hops") == 0).alias("seed"), "place")


@query(
    "graph_page",
    f"""
WITH {_V}, {_O}, page AS (SELECT id, name FROM v WHERE type IN ('customer', 'nation') ORDER BY name, id LIMIT 40 OFFSET 10)
SELECT id, name, id NOT IN (SELECT src FROM o UNION SELECT dst FROM o) AS orphan FROM page""",
)
def graph_page(spark, sf_dir):
    """A page of entities by name, each with whether nothing is linked to it."""
    page = vertices(spark, sf_dir).where("type IN ('customer', 'nation')").orderBy("name", "id").offset(10).limit(40)
    touched = authored(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("id")).join(F.broadcast(page.select("id")), "id", "left_semi").distinct()
    return page.join(touched.withColumn("linked", F.lit(True)), "id", "left").select("id", "name", F.col("linked").isNull().alias("orphan"))


_COMMUNITY = "c AS (SELECT 'N:' || c_nationkey AS id, count(*) AS size, min(c_name) AS first, 0 AS level FROM customer GROUP BY 1 UNION ALL SELECT 'R:' || n_regionkey, count(*), min(c_name), 1 FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)"


def _communities(spark, sf_dir):
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    shown = (F.count(F.lit(1)).alias("size"), F.min("c_name").alias("first"))
    low = customers.groupBy(_id("N", "c_nationkey").alias("id")).agg(*shown).withColumn("level", F.lit(0))
    high = customers.join(F.broadcast(nations), customers["c_nationkey"] == nations["n_nationkey"]).groupBy(_id("R", "n_regionkey").alias("id")).agg(*shown).withColumn("level", F.lit(1))
    return low.union(high)


@query("communities_listed", f"WITH {_COMMUNITY} SELECT id, level, size, row_number() OVER (PARTITION BY level ORDER BY size DESC, id) AS place, count(*) OVER () AS total FROM c")
def communities_listed(spark, sf_dir):
    """Communities by level and size, with how many there are."""
    found = _communities(spark, sf_dir)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.crossJoin(total).select("id", "level", "size", F.row_number().over(Window.partitionBy("level").orderBy(F.desc("size"), "id")).alias("place"), "total")  # one row beside each


@query("communities_found", f"WITH {_COMMUNITY} SELECT id, size FROM c WHERE contains(lower(first), '#00000000') OR len(list_filter(['n:1', 'r:2'], lambda k: contains(lower(id), k))) > 0")
def communities_found(spark, sf_dir):
    """Communities whose name holds the query, or any of whose keywords does."""
    keywords = F.array(F.lit("n:1"), F.lit("r:2"))
    return _communities(spark, sf_dir).where(F.contains(F.lower("first"), F.lit("#00000000")) | F.exists(keywords, lambda k: F.contains(F.lower("id"), k))).select("id", "size")


@query(
    "community_edges",
    """
SELECT 'C:' || c_custkey AS src, 'BELONGS_TO' AS rel, 'N:' || c_nationkey AS dst FROM customer
UNION ALL SELECT 'R:' || n_regionkey, 'PARENT_OF', 'N:' || n_nationkey FROM nation UNION ALL SELECT 'N:' || n_nationkey, 'CHILD_OF', 'R:' || n_regionkey FROM nation""",
)
def community_edges(spark, sf_dir):
    """What is written for communities: their members, parents and children."""
    members = table(spark, sf_dir, "customer").groupBy(_id("N", "c_nationkey").alias("dst")).agg(F.collect_list(_id("C", "c_custkey")).alias("ids"))
    belongs = members.select(F.explode("ids").alias("src"), F.lit("BELONGS_TO").alias("rel"), "dst")
    nation, region = _id("N", "n_nationkey"), _id("R", "n_regionkey")
    rows = table(spark, sf_dir, "nation")
    return belongs.union(rows.select(region, F.lit("PARENT_OF"), nation)).union(rows.select(nation, F.lit("CHILD_OF"), region))


@query("communities_deleted", f"WITH {_COMMUNITY} SELECT id, size FROM c WHERE id NOT IN (SELECT 'N:' || n_nationkey FROM nation WHERE n_regionkey = 2)")
def communities_deleted(spark, sf_dir):
    """Communities that are left after those of a tenant were deleted."""
    gone = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(_id("N", "n_nationkey").alias("id"))
    return _communities(spark, sf_dir).join(gone, "id", "left_anti").select("id", "size")


@query(
    "community_context",
    """
WITH h AS (SELECT o_orderkey % 50 AS query_id, o_custkey FROM orders WHERE o_orderkey % 20 = 0),
c AS (SELECT DISTINCT query_id, 'N:' || n_nationkey AS community, 0 AS level FROM h JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  UNION SELECT DISTINCT query_id, 'R:' || n_regionkey, 1 FROM h JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT query_id, community, level, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY level DESC, community) AS rank FROM c) WHERE rank <= 5""",
)
def community_context(spark, sf_dir):
    """Five communities of each query's entities, the highest levels first."""
    hits = table(spark, sf_dir, "orders").where("o_orderkey % 20 = 0").select((F.col("o_orderkey") % 50).alias("query_id"), F.col("o_custkey").alias("c_custkey"))
    placed = hits.join(table(spark, sf_dir, "customer"), "c_custkey").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    levels = F.array(F.struct(_id("N", "n_nationkey").alias("community"), F.lit(0).alias("level")), F.struct(_id("R", "n_regionkey").alias("community"), F.lit(1).alias("level")))
    found = placed.select("query_id", F.explode(levels).alias("c")).select("query_id", "c.community", "c.level").distinct()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("level"), "community"))).where("rank <= 5")


@query(
    "hierarchy_levels",
    """
WITH e AS (SELECT c_nationkey AS x, s_nationkey AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
r AS (SELECT a.n_regionkey AS x, b.n_regionkey AS y FROM e JOIN nation a ON a.n_nationkey = x JOIN nation b ON b.n_nationkey = y),
u AS (SELECT 0 AS level, x, y FROM e UNION ALL SELECT 1, x, y FROM r)
SELECT level, least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM u WHERE x <> y GROUP BY 1, 2, 3""",
)
def hierarchy_levels(spark, sf_dir):
    """Links between the communities of each of two levels; those of the second come out of the first's counts."""
    line, order = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("x"))
    y = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("y"))
    low = line.join(order, "l_orderkey").join(x, "o_custkey").join(y, "l_suppkey").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    parent = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    up = lambda k: F.broadcast(parent.select(F.col("n_nationkey").alias(k), F.col("n_regionkey").alias(f"{k}_up")))
    high = low.join(up("x"), "x").join(up("y"), "y").select(F.lit(1).alias("level"), F.col("x_up").alias("x"), F.col("y_up").alias("y"), "n")
    return low.select(F.lit(0).alias("level"), "x", "y", "n").union(high).where("x <> y").groupBy("level", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("n").alias("n"))


#: The relationship types that two entity types may have, and those of any others.
EDGE_TYPES = {
    ("TechnicalConcept", "TechnicalConcept"): ("DEPENDS_ON", "RELATED_TO", "EXTENDS", "IMPLEMENTS", "ALTERNATIVE_TO"),
    ("TechnicalConcept", "CodePattern"): ("IMPLEMENTED_BY", "USES_PATTERN", "DEMONSTRATED_IN"),
    ("CodePattern", "CodePattern"): ("COMPOSES_WITH", "VARIANT_OF", "REPLACES", "CONFLICTS_WITH"),
    ("CodePattern", "TechnicalConcept"): ("IMPLEMENTS", "APPLIES_TO", "DEMONSTRATES"),
    ("APIEndpoint", "TechnicalConcept"): ("EXPOSES", "REQUIRES", "RETURNS"),
    ("APIEndpoint", "APIEndpoint"): ("CALLS", "REDIRECTS_TO", "SUPERSEDES"),
    ("ConfigurationOption", "TechnicalConcept"): ("CONFIGURES", "ENABLES", "CONTROLS"),
    ("ConfigurationOption", "ConfigurationOption"): ("DEPENDS_ON", "OVERRIDES", "CONFLICTS_WITH"),
    ("ConfigurationOption", "APIEndpoint"): ("CONFIGURES", "ENABLES"),
}
OTHER_EDGE_TYPES = ("RELATED_TO", "REFERENCES")
_KINDS = ("TechnicalConcept", "CodePattern", "APIEndpoint", "ConfigurationOption")
_KIND_SQL = f"{_list(_KINDS)}"


@query(
    "edge_types_allowed",
    f"""
WITH m(a, b, types) AS (VALUES {', '.join(f"('{a}', '{b}', '{','.join(t)}')" for (a, b), t in EDGE_TYPES.items())}),
e AS (SELECT p_partkey, {_KIND_SQL}[1 + p_partkey % 4] AS a, {_KIND_SQL}[1 + p_size % 4] AS b FROM part)
SELECT p_partkey, e.a AS source_type, e.b AS target_type, coalesce(types, '{','.join(OTHER_EDGE_TYPES)}') AS types FROM e LEFT JOIN m ON m.a = e.a AND m.b = e.b""",
)
def edge_types_allowed(spark, sf_dir):
    """The relationship types that each pair of entities may have."""
    known = F.broadcast(spark.createDataFrame([(a, b, ",".join(t)) for (a, b), t in EDGE_TYPES.items()], "source_type string, target_type string, types string"))
    kinds = F.array(*map(F.lit, _KINDS))
    pairs = table(spark, sf_dir, "part").select("p_partkey", F.get(kinds, (F.col("p_partkey") % 4).cast("int")).alias("source_type"), F.get(kinds, (F.col("p_size") % 4).cast("int")).alias("target_type"))
    return pairs.join(known, ["source_type", "target_type"], "left").withColumn("types", F.coalesce("types", F.lit(",".join(OTHER_EDGE_TYPES))))


@query(
    "ontology_match",
    """
WITH cls AS (SELECT p_type AS class, min(p_partkey) AS place FROM part GROUP BY 1),
e AS (SELECT p_partkey, p_name || ' ' || p_type AS name FROM part),
m AS (SELECT p_partkey, class, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN lower(class) = lower(name) THEN 1 ELSE 2 END, place) AS r FROM e JOIN cls ON contains(lower(name), lower(class)))
SELECT p_partkey, class FROM m WHERE r = 1""",
)
def ontology_match(spark, sf_dir):
    """The class of each entity: one of its name, else the first whose name stands in it."""
    part = table(spark, sf_dir, "part")
    # classes are an ontology's, of a bounded number; Spark broadcasts them by their size
    classes = part.groupBy(F.col("p_type").alias("class")).agg(F.min("p_partkey").alias("place"))
    names = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    found = names.join(classes, F.contains(F.lower("name"), F.lower("class")))
    exact = F.when(F.lower("class") == F.lower("name"), 1).otherwise(2)
    return found.groupBy("p_partkey").agg(F.min(F.struct(exact.alias("pass"), "place", "class"))["class"].alias("class"))


@query(
    "migration_counts",
    f"""
WITH {_V}, {_P}, old AS (SELECT 'vertex ' || type AS what, count(*) AS n FROM v GROUP BY type UNION ALL SELECT 'edge ' || rel, count(*) FROM p GROUP BY rel),
new AS (SELECT 'vertex ' || type AS what, count(*) AS n FROM v WHERE id <> 'N:3' GROUP BY type UNION ALL SELECT 'edge USES', count(*) FROM lineitem)
SELECT coalesce(old.what, new.what) AS what, coalesce(old.n, 0) AS before, coalesce(new.n, 0) AS after, coalesce(old.n, 0) = coalesce(new.n, 0) AS equal FROM old FULL JOIN new ON new.what = old.what""",
)
def migration_counts(spark, sf_dir):
    """Vertices and edges by type before and after a migration."""

    def counted(rows, kind, column, name):
        return rows.groupBy(F.concat(F.lit(f"{kind} "), column).alias("what")).agg(F.count(F.lit(1)).alias(name))

    v = vertices(spark, sf_dir)
    before = counted(v, "vertex", "type", "b").union(counted(part_of(spark, sf_dir), "edge", "rel", "b"))
    uses = table(spark, sf_dir, "lineitem").select(F.lit("USES").alias("rel"))
    after = counted(v.where("id <> 'N:3'"), "vertex", "type", "a").union(counted(uses, "edge", "rel", "a"))
    b, a = F.coalesce("b", F.lit(0)), F.coalesce("a", F.lit(0))
    return before.join(after, "what", "full").select("what", b.alias("before"), a.alias("after"), (a == b).alias("equal"))


@query("graph_export", f"WITH {_V}, {_P} SELECT to_json({{'kind': 'node', 'id': id, 'type': type, 'name': name}}) AS line FROM v UNION ALL SELECT to_json({{'kind': 'relationship', 'src': src, 'rel': rel, 'dst': dst}}) FROM p")
def graph_export(spark, sf_dir):
    """Nodes and relationships as JSON lines."""
    nodes = vertices(spark, sf_dir).select(F.to_json(F.struct(F.lit("node").alias("kind"), "id", "type", "name")).alias("line"))
    return nodes.union(part_of(spark, sf_dir).select(F.to_json(F.struct(F.lit("relationship").alias("kind"), "src", "rel", "dst"))))


@query(
    "hit_relations",
    """
WITH r AS (SELECT l_partkey AS hit, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY n DESC, l_suppkey) AS rank FROM r)
SELECT hit, l_suppkey AS related, n, rank FROM k WHERE rank <= 25""",
)
def hit_relations(spark, sf_dir):
    """The 25 strongest relationships of every hit."""
    links = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("hit"), F.col("l_suppkey").alias("related")).agg(F.count(F.lit(1)).alias("n"))
    return links.withColumn("rank", F.row_number().over(Window.partitionBy("hit").orderBy(F.desc("n"), "related"))).where("rank <= 25")


@query(
    "ancestors_walked",
    """
WITH RECURSIVE t AS (SELECT vec_id AS id, CASE WHEN vec_id % 40 = 0 THEN NULL ELSE vec_id - vec_id % (CASE WHEN vec_id % 4 <> 0 THEN 4 WHEN vec_id % 8 <> 0 THEN 8 ELSE 40 END) END AS parent,
    CASE WHEN vec_id % 40 = 0 THEN 3 WHEN vec_id % 8 = 0 THEN 2 WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END AS level FROM embeddings),
w(start, id, level) AS (SELECT id, id, level FROM t UNION ALL SELECT w.start, p.id, p.level FROM w JOIN t c ON c.id = w.id JOIN t p ON p.id = c.parent WHERE w.level < 2)
SELECT start, arg_max(id, level) AS ancestor, max(level) AS level FROM w GROUP BY start""",
)
def ancestors_walked(spark, sf_dir):
    """Every chunk's ancestor at the second level, by walking up parents; the last one reached where there is none."""
    return ancestors(chunk_tree(spark, sf_dir), 2, 3)


def chunk_tree(spark, sf_dir):
    """Rows (id, parent, level): the vectors as chunks of a hierarchy."""
    i = F.col("vec_id")
    level = F.when(i % 40 == 0, 3).when(i % 8 == 0, 2).when(i % 4 == 0, 1).otherwise(0)
    parent = F.when(i % 40 == 0, F.lit(None)).otherwise(i - i % F.when(i % 4 != 0, 4).when(i % 8 != 0, 8).otherwise(40))
    return table(spark, sf_dir, "embeddings").select(i.alias("id"), parent.alias("parent"), level.alias("level"))


def ancestors(tree, level: int, steps: int):
    """Rows (start, ancestor, level): each chunk's first ancestor of at least ``level``, itself included; at most ``steps`` steps up."""
    up = tree.select(F.col("id").alias("c_id"), F.col("parent").alias("p_id")).where("p_id IS NOT NULL").join(tree.select(F.col("id").alias("p_id"), F.col("level").alias("p_level")), "p_id")
    walk = tree.select(F.col("id").alias("start"), F.col("id").alias("ancestor"), "level")
    for _ in range(steps):
        there = F.col("level") < level
        walk = walk.join(up, (walk["ancestor"] == up["c_id"]) & there, "left").select("start", F.coalesce("p_id", "ancestor").alias("ancestor"), F.coalesce("p_level", "level").alias("level"))
    return walk


def unioned(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def ontology_file(spark, sf_dir):
    """Path of an ontology in files that Spark writes of the parts: each below its brand within a type, and that below the type."""
    base = "http://parts.example/o#"
    kind, brand = F.col("p_type"), F.concat_ws("-", "p_type", F.replace("p_brand", F.lit("#"), F.lit("-")))
    part = table(spark, sf_dir, "part")

    def element(uri, parent, comment):
        above = F.concat(F.lit(f'<rdfs:subClassOf rdf:resource="{base}'), parent, F.lit('"/>'))
        return F.concat(F.lit(f'<owl:Class rdf:about="{base}'), uri, F.lit('">'), above, F.lit("<rdfs:comment>"), comment, F.lit("</rdfs:comment></owl:Class>"))

    rows = part.select(element(F.concat(F.lit("part-"), "p_partkey"), brand, F.col("p_name")).alias("value"))
    rows = rows.union(part.select(element(brand, kind, F.col("p_brand"))).distinct()).union(part.select(element(kind, F.lit("Part"), kind)).distinct())
    sized = F.concat(F.lit(f'<owl:DatatypeProperty rdf:about="{base}size-of-'), kind, F.lit(f'"><rdfs:domain rdf:resource="{base}'), kind, F.lit('"/></owl:DatatypeProperty>'))

    def documents(batches):
        # each partition is a file, and each file a document of its own
        yield pd.DataFrame({"value": ["<rdf:RDF>"]})
        yield from batches
        yield pd.DataFrame({"value": ["</rdf:RDF>"]})

    path = f"{shared_folder(spark)}/ontology-{uuid.uuid4().hex}"
    rows.union(part.select(sized).distinct()).mapInPandas(documents, "value string").write.text(path)
    return path


@query(
    "ontology_classes",
    """
WITH b AS (SELECT 'part-' || p_partkey AS name, p_type || '-' || replace(p_brand, '#', '-') AS parent, p_name AS description FROM part UNION SELECT p_type || '-' || replace(p_brand, '#', '-'), p_type, p_brand FROM part UNION SELECT p_type, 'Part', p_type FROM part)
SELECT name, 'http://parts.example/o#' || parent AS parent, CASE WHEN name IN (SELECT p_type FROM part) THEN 'size-of-' || name ELSE '' END AS properties, description FROM b""",
)
def ontology_classes(spark, sf_dir):
    """Classes of an ontology file with parent, properties and description."""
    found = ontology.classes(spark, ontology_file(spark, sf_dir))
    return found.select("name", F.array_join("parents", " ").alias("parent"), F.array_join("properties", " ").alias("properties"), "description")


@query(
    "ontology_ancestors",
    """
WITH b AS (SELECT DISTINCT 'part-' || p_partkey AS p, p_type || '-' || replace(p_brand, '#', '-') AS b, p_type AS t FROM part)
SELECT DISTINCT unnest([p, p, p, b, b, t]) AS name, unnest([b, t, 'Part', t, 'Part', 'Part']) AS ancestor, unnest([1, 2, 3, 1, 2, 1]) AS depth FROM b""",
)
def ontology_ancestors(spark, sf_dir):
    """All classes above each class of an ontology file, at their depth."""
    above = ontology.ancestors(ontology.classes(spark, ontology_file(spark, sf_dir)))
    return above.select(ontology.local_name(F.col("uri")).alias("name"), ontology.local_name(F.col("ancestor")).alias("ancestor"), "depth")

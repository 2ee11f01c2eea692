"""Ontologies in RDF/XML as tables: classes with their parents, properties with domain and range, ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.graph import cut

THING = "http://www.w3.org/2002/07/owl#Thing"
_ID = "`_rdf:about` string, `_rdf:ID` string"
_SAID = "`rdfs:comment` array<struct<_VALUE: string, `_xml:lang`: string>>"
_LINK = "array<struct<`_rdf:resource`: string>>"
#: What a property's element is named, and its kind.
_KINDS = {"owl:ObjectProperty": "object", "owl:DatatypeProperty": "data", "rdf:Property": "any"}


def _elements(spark: SparkSession, path: str, tag: str, fields: str) -> DataFrame:
    rows = spark.read.format("xml").schema(f"{_ID}, {_SAID}, {fields}").option("rowTag", tag).load(path)
    uri = F.coalesce("`_rdf:about`", F.concat(F.lit("#"), "`_rdf:ID`"))
    # elements without a name stand for an expression within another
    return rows.withColumn("uri", uri).where("uri IS NOT NULL")


def local_name(uri: Column) -> Column:
    """What follows the last # or / of an identifier."""
    return F.regexp_extract(uri, r"([^#/]*)[#/]?$", 1)


def _links(field: str) -> Column:
    return F.coalesce(F.filter(F.transform(F.col(f"`{field}`"), lambda x: x["_rdf:resource"]), lambda x: x.isNotNull() & (x != THING)), F.array().cast("array<string>"))


def properties(spark: SparkSession, path: str) -> DataFrame:
    """(uri, name, kind, domain, range, description): the properties that the files at ``path`` declare, once each.

    Domain and range are the first that are named; what is named in several elements of one
    identifier is taken in the order of its text.
    """
    out = None
    for tag, kind in _KINDS.items():
        rows = _elements(spark, path, tag, f"`rdfs:domain` {_LINK}, `rdfs:range` {_LINK}")
        rows = rows.select("uri", F.lit(kind).alias("kind"), F.get(_links("rdfs:domain"), F.lit(0)).alias("domain"), F.get(_links("rdfs:range"), F.lit(0)).alias("range"), _description().alias("description"))
        out = rows if out is None else out.union(rows)
    merged = out.groupBy("uri").agg(*(F.min(c).alias(c) for c in ("kind", "domain", "range", "description")))
    return merged.select("uri", local_name(F.col("uri")).alias("name"), "kind", "domain", "range", "description")


def classes(spark: SparkSession, path: str) -> DataFrame:
    """(uri, name, parents, properties, description): the classes that the files at ``path`` declare, once each.

    Parents are in order of their text, the root of all classes left out; properties are
    names of those whose domain the class is.
    """
    rows = _elements(spark, path, "owl:Class", f"`rdfs:subClassOf` {_LINK}")
    rows = rows.select("uri", _links("rdfs:subClassOf").alias("parents"), _description().alias("description")).where(F.col("uri") != THING)
    merged = rows.groupBy("uri").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("parents")))).alias("parents"), F.min("description").alias("description"))
    owned = properties(spark, path).where("domain IS NOT NULL").groupBy(F.col("domain").alias("uri")).agg(F.array_sort(F.collect_set("name")).alias("properties"))
    joined = merged.join(owned, "uri", "left")
    return joined.select("uri", local_name(F.col("uri")).alias("name"), "parents", F.coalesce("properties", F.array().cast("array<string>")).alias("properties"), "description")


def _description() -> Column:
    """The first comment that says anything."""
    said = F.transform(F.col("`rdfs:comment`"), lambda x: F.trim(x["_VALUE"]))
    return F.get(F.filter(said, lambda x: x != ""), F.lit(0))


def ancestors(found: DataFrame) -> DataFrame:
    """(uri, ancestor, depth): all classes above each of ``found`` (uri, parents), at their least depth.

    Classes that are above themselves end the walk there and aren't their own ancestors. A
    round goes one level up and is written, so rounds are as many as the longest way.
    """
    up = cut(found.select("uri", F.explode("parents").alias("parent")).where("uri <> parent").distinct())
    last = known = up.select("uri", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    step = up.select(F.col("uri").alias("ancestor"), "parent")
    depth = 1
    while not last.isEmpty():
        depth += 1
        higher = last.join(step, "ancestor").select("uri", F.col("parent").alias("ancestor")).where("uri <> ancestor").distinct()
        last = cut(higher.join(known, ["uri", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        known = known.union(last)
    return known

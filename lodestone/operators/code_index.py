"""A code index on disk that follows its files: an update writes what has changed and nothing else.

``folder/<table>/g=n`` holds what update ``n`` wrote. Rows of a path count if no later update
holds that path, targets of a name likewise. An update counts once ``folder/done`` names it,
one small file, so a run that broke off leaves nothing that readers see and the next one writes
over it. An edge is a name that a file calls and the name's target, kept apart: where a
definition moves, the calls of all other files follow by one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import code
from lodestone.operators.graph import cut

TABLES = {
    "files": "path string, hash string",
    "symbols": "path string, name string, kind string, qualified string, first_line int, last_line int",
    "called": "path string, name string",
    "chunks": "path string, qualified string, part int, content string",
    "targets": "name string, target string",
}
_DONE = "n int, added long, changed long, removed long, symbols long, chunks long, moved long"


def create(spark: SparkSession, folder: str) -> None:
    """An index without files."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{folder}/{name}/g=0")
    spark.createDataFrame([(0, 0, 0, 0, 0, 0, 0)], _DONE).coalesce(1).write.parquet(f"{folder}/done")


def updates(spark: SparkSession, folder: str) -> DataFrame:
    """(n, added, changed, removed, symbols, chunks, moved) of each finished update; 0 is the empty index."""
    return spark.read.schema(_DONE).parquet(f"{folder}/done")


def _last(spark: SparkSession, folder: str) -> int:
    return updates(spark, folder).agg(F.max("n")).first()[0]


def _written(spark: SparkSession, folder: str, name: str, upto: int) -> DataFrame:
    return spark.read.schema(f"{TABLES[name]}, g int").parquet(f"{folder}/{name}").where(F.col("g") <= upto)


def _files(spark: SparkSession, folder: str, upto: int) -> DataFrame:
    newest = _written(spark, folder, "files", upto).groupBy("path").agg(F.max_by("hash", "g").alias("hash"), F.max("g").alias("g"))
    return newest.where("hash IS NOT NULL")


def read(spark: SparkSession, folder: str, name: str, upto: int | None = None) -> DataFrame:
    """A table of the index as it stands, or as it stood after update ``upto``."""
    upto = _last(spark, folder) if upto is None else upto
    if name == "files":
        return _files(spark, folder, upto).drop("g")
    rows = _written(spark, folder, name, upto)
    if name == "targets":
        return rows.groupBy("name").agg(F.max_by("target", "g").alias("target")).where("target IS NOT NULL")
    return rows.join(_files(spark, folder, upto).select("path", "g"), ["path", "g"]).drop("g")


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, target): the calls of all files that meet a definition."""
    last = _last(spark, folder)
    return read(spark, folder, "called", last).join(read(spark, folder, "targets", last), "name").select("path", "name", "target")


def moved(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, target): calls in files that the last update left alone, whose target it changed; null: it has gone."""
    last = _last(spark, folder)
    new = _written(spark, folder, "targets", last).where(F.col("g") == last).drop("g")
    touched = _written(spark, folder, "files", last).where(F.col("g") == last).select("path")
    return read(spark, folder, "called", last).join(touched, "path", "left_anti").join(new, "name").select("path", "name", "target")


def update(files: DataFrame, folder: str, symbols: Callable[[DataFrame], DataFrame] = code.symbols, max_chars: int = 1000) -> int:
    """Bring an index to ``files`` (path, text), which are all files there are; returns the number of the update.

    Files are told apart by the SHA-256 of their text; only new and changed ones are read
    for symbols, calls and chunks. Files without a path are left out, a null text is empty,
    and of rows of one path that with the greatest hash counts. An update that finds
    nothing new still gets a number.
    """
    spark = files.sparkSession
    last = _last(spark, folder)
    n = last + 1

    def keep(rows: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}/g={n}"
        rows.select(*(c.split()[0] for c in TABLES[name].split(", "))).write.mode("overwrite").parquet(path)
        return spark.read.schema(TABLES[name]).parquet(path)

    given = files.where("path IS NOT NULL").select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.sha2("text", 256))
    old = _files(spark, folder, last).select("path", F.col("hash").alias("old"))
    both = given.groupBy("path").agg(F.max("hash").alias("hash")).join(old, "path", "full")
    changed = keep(both.where(~F.col("hash").eqNullSafe(F.col("old"))), "files")
    texts = given.join(changed.where("hash IS NOT NULL"), ["path", "hash"], "left_semi").dropDuplicates(["path"]).select("path", "text")
    texts = code.dealt(cut(texts), "path")  # found once for symbols, calls and chunks

    found = keep(symbols(texts), "symbols")
    keep(code.called(texts), "called")
    chunks = keep(code.or_whole_files(texts, code.code_chunks(texts, found, max_chars)), "chunks")

    before = read(spark, folder, "symbols", last)
    gone = before.join(changed.select("path"), "path", "left_semi")
    names = gone.select("name").union(found.select("name")).distinct()
    stand = before.join(changed.select("path"), "path", "left_anti").join(names, "name", "left_semi").select(found.columns)
    first = names.join(code.definitions(stand.union(found)), "name", "left")
    was = read(spark, folder, "targets", last).select("name", F.col("target").alias("was"))
    targets = keep(first.join(was, "name", "left").where(~F.col("target").eqNullSafe(F.col("was"))), "targets")

    kinds = changed.join(old, "path", "left").agg(*(F.count_if(F.expr(c)) for c in ("old IS NULL", "old IS NOT NULL AND hash IS NOT NULL", "hash IS NULL"))).first()
    done = [(n, *kinds, found.count(), chunks.count(), targets.count())]
    spark.createDataFrame(done, _DONE).coalesce(1).write.mode("append").parquet(f"{folder}/done")
    return n


def compact(spark: SparkSession, folder: str, to: str) -> None:
    """A new index at ``to`` that holds what stands at ``folder`` as its one update."""
    create(spark, to)
    last = _last(spark, folder)
    for name in TABLES:
        read(spark, folder, name, last).select(*(c.split()[0] for c in TABLES[name].split(", "))).write.mode("overwrite").parquet(f"{to}/{name}/g=1")
    counts = [_written(spark, to, name, 1).count() for name in ("files", "symbols", "chunks", "targets")]
    spark.createDataFrame([(1, counts[0], 0, 0, *counts[1:])], _DONE).coalesce(1).write.mode("append").parquet(f"{to}/done")

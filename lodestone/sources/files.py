"""Files as rows: type, decoding, identity, and datasets in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TEXT_BYTES = 10 * 1024 * 1024

# Kinds by extension.
KINDS = {
    "pdf": "pdf", "doc": "word", "docx": "word", "xls": "excel", "xlsx": "excel", "ppt": "powerpoint", "pptx": "powerpoint",
    "txt": "text", "md": "markdown", "html": "html", "htm": "html", "json": "json", "csv": "csv",
}

# Language by extension of source code.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript"}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))


def kind(path: Column, mime: Column) -> Column:
    """Kind by extension, else by what the MIME type names, else unknown."""
    by_mime = F.when(mime.contains("pdf"), "pdf").when(mime.contains("html"), "html").when(mime.startswith("text/"), "text")
    return F.coalesce(_lookup(extension(path), KINDS), by_mime, F.lit("unknown"))


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content, content_hash, is_pdf) of the files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("content_hash"), (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"))


def decoded(files: DataFrame) -> DataFrame:
    """(path, text) of files up to the size limit: UTF-8 without byte order mark where it is valid, else Latin-1."""
    utf8 = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), utf8).otherwise(F.decode("content", "ISO-8859-1"))
    return files.where(F.col("length") <= MAX_TEXT_BYTES).select("path", text.alias("text"))


def scanned(files: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """Source files by language, without those whose path matches an excluded pattern."""
    out = files.withColumn("language", _lookup(extension(F.col("path")), LANGUAGES)).where("language IS NOT NULL")
    for pattern in excluded:
        out = out.where(~F.col("path").rlike(pattern))
    return out


def video_id(url: Column) -> Column:
    """Id of a video in the usual forms of its URL; null in others."""
    forms = (r"[?&]v=([A-Za-z0-9_-]{11})", r"youtu\.be/([A-Za-z0-9_-]{11})", r"/embed/([A-Za-z0-9_-]{11})", r"/shorts/([A-Za-z0-9_-]{11})")
    return F.coalesce(*(F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in forms))


EVALUATION = (
    "queries array<struct<query_id: string, text: string, relevant_docs: map<string, double>>>, "
    "documents array<struct<doc_id: string, text: string, metadata: map<string, string>>>"
)


def evaluation_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, documents, qrels) of an evaluation file; wrong schemas are refused."""
    raw = spark.read.schema(EVALUATION).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    if not raw.where(F.col("queries").isNull() | F.col("documents").isNull()).isEmpty():
        raise ValueError("an evaluation set has queries and documents")
    queries = raw.select(F.explode("queries").alias("q")).select("q.*")
    qrels = queries.select("query_id", F.explode("relevant_docs").alias("doc_id", "grade"))
    return queries.select("query_id", "text"), raw.select(F.explode("documents").alias("d")).select("d.*"), qrels


def export_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Vertices and edges as lines of JSON."""
    rows = vertices.withColumn("kind", F.lit("node")).unionByName(edges.withColumn("kind", F.lit("relationship")), allowMissingColumns=True)
    rows.write.json(path)

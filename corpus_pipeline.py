"""From raw documents to token ids: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, lines, mixing, quality, shingles, simhash
from lodestone.llm.common import Scratch, drop_made_since, free_names, made_so_far
from lodestone.sources import table

#: Documents whose fitted rate is below this are left out. One copy stays of any other:
#: the stage after near-duplicate removal makes no new duplicates.
MIN_RATE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the template lines of their source."""
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that others hold already; those of which nothing is left go."""
    return lines.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each group linked by fingerprints, as in ``op9``, or by 0.8 of its five-word shingles, rows without an id last.

    Near copies mostly differ in more than the four bits of the trie join, so shingles add the links that it can't see.
    """
    return shingles.one_per_group(docs, shingles.near_duplicates(docs, linked=simhash.text_groups(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture asks for. Rows without an id have no rate of their own and stay."""
    labels = mixing.label_domains(table(spark, sf_dir, "labels"))
    mixed = Scratch(spark, "mixture").keep(mixing.mix(docs, labels, mixing.WITHOUT_TOXIC), "rates")
    (name,) = free_names(docs, "unwanted")
    out = mixed.where(F.col("rate") < MIN_RATE).select(F.col("doc_id").alias(name))
    return docs.join(out, docs["doc_id"] == out[name], "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the hash of the text they decode to."""
    coded = bpe.encode(docs, bpe.build(docs), decoded_col="decoded")
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Shingle groups, edit similarity and a fitted classifier are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again.

    What a stage kept for itself is deleted once its result is written. No documents give no rows.
    """
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = made_so_far()
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        drop_made_since(spark, mark)
    return STAGES[-1][1](spark, docs, sf_dir)

"""What the operators share: the shared scratch folder, lineage cuts, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where the session names none, a local master (tests) gets a temporary folder;
    anything else is refused, since executors on other machines would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Folders of intermediate tables that this driver has made and not deleted.
_BASES: list[str] = []


def made_so_far() -> int:
    """A mark for :func:`drop_made_since`."""
    return len(_BASES)


def drop_made_since(spark: SparkSession, mark: int) -> None:
    """Delete the intermediate tables made since ``mark``, once nothing is left to read them."""
    while len(_BASES) > mark:
        path = spark._jvm.org.apache.hadoop.fs.Path(_BASES.pop())  # noqa: SLF001
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


class Scratch:
    """Intermediate tables as Parquet below the shared folder.

    A written table cuts the lineage and survives lost executors, and the reread
    has true sizes, which adaptive joins go by.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        _BASES.append(self.base)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that :meth:`keep` returned and nothing reads any more."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)  # noqa: SLF001
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)")), F.lit(0)).alias("h"),
    ).first()
    return row["n"], int(row["h"])


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: rows (node, component).

    Every node that an edge names gets the smallest node it reaches; nodes without
    edges are not listed. Alternates large-star and small-star rounds (Kiveris et
    al., 2014) until the edge set stands still. No vertex's neighbours are ever
    gathered: minima are pre-aggregated before their shuffle, and the join that
    hands them back is a plain equi-join of two written tables, whose hot keys
    adaptive execution splits.
    """
    e = scratch.keep(
        edges.where((F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent"))
        .distinct(),
        "edges",
    )
    before = _state(e)
    while before[0]:
        both = e.select(F.col("child").alias("u"), F.col("parent").alias("v")).union(e.select("parent", "child"))
        low = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = scratch.keep(
            e.select(F.col("parent").alias("u"), F.col("child").alias("v"))
            .join(low, "u")
            .select(F.col("v").alias("child"), F.col("m").alias("parent"))
            .distinct(),
            "large",
        )
        least = scratch.keep(large.groupBy("child").agg(F.min("parent").alias("m")), "least")
        joined = large.join(least, "child")
        small = scratch.keep(
            joined.where("parent <> m")
            .select(F.col("parent").alias("child"), F.col("m").alias("parent"))
            .union(least.select("child", F.col("m").alias("parent")))
            .distinct(),
            "small",
        )
        scratch.drop(e, low, large, least)
        e, after = small, _state(small)
        if after == before:
            break
        before = after
    return e.select(F.col("child").alias("node"), F.col("parent").alias("component")).union(
        e.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    )


def link_labels(labels, left, right):
    """Merge index pairs into ``labels`` (numpy union by minimum and pointer jumping), in place.

    ``labels[i]`` is a smaller or equal index of i's group; after the call, equal
    labels mean connected through all pairs merged so far.
    """
    import numpy as np

    while True:
        x, y = labels[left], labels[right]
        differ = x != y
        if not differ.any():
            return labels
        left, right, x, y = left[differ], right[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the ``wanted`` ones that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows handed to a function of :func:`with_computed` at once.
PIECE = 1000


def with_computed(df: DataFrame, inputs: list[Column], new: list[tuple[str, str, pa.DataType]], compute: Callable) -> DataFrame:
    """``df`` with new columns that ``compute`` makes of ``inputs`` in Python.

    ``new``: (name, Spark type, Arrow type) of each, names that ``df`` doesn't have.
    ``compute`` gets the inputs of up to ``PIECE`` rows as Python lists and returns
    the new columns as lists or Arrow arrays. The columns of ``df`` itself stay Arrow
    data throughout: longs beside nulls keep all their digits.
    """
    own, names = len(df.columns), [n for n, *_ in new]
    schema = StructType(df.schema.fields + [StructField(n, _parsed(t)) for n, t, _ in new])
    sent = free_names(df, *(f"input{i}" for i in range(len(inputs))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                part = batch.slice(at, PIECE)
                made = compute(*(part.column(i).to_pylist() for i in range(own, part.num_columns)))
                arrays = [m if isinstance(m, pa.Array) else pa.array(m, t) for m, (_, _, t) in zip(made, new, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:own], *arrays], names=[*part.schema.names[:own], *names])

    return df.select("*", *(c.alias(n) for c, n in zip(inputs, sent, strict=True))).mapInArrow(rows, schema)


def _parsed(ddl: str):
    return StructType.fromDDL(f"x {ddl}").fields[0].dataType


def pieces(batches: Iterator, rows: int = 1000) -> Iterator:
    """Batches of pandas rows cut into smaller ones, so that what a task builds for its rows stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def plain(frame):
    """A pandas frame with its strings as objects: Arrow-backed ones may lie in no chunk or in several, which Arrow serialisation refuses."""
    import pandas as pd

    return frame.astype({c: object for c, t in frame.dtypes.items() if isinstance(t, pd.StringDtype)})

"""Structured Streaming forms: limits, sessions, metrics and idempotent ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lodestone.operators.delivery import Entry, Rules, advance, happen
from lodestone.operators.ordered import sliding_log


def read_files(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, ts: str, keys: list[str], window: str, late: str) -> DataFrame:
    """Counts by keys and tumbling window; state is dropped once events are ``late``."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions by key with pauses of less than ``gap``."""
    grouped = events.withWatermark(ts, late).groupBy(F.session_window(F.col(ts), gap).alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("last")).select(key, "start", "last", "n")


def sliding_limit(events: DataFrame, key: str, seconds: str, tie: str, window: float, most: int) -> DataFrame:
    """The sliding-log rate limit with the allowed times of the last window as state.

    Equal to the batch form if each key's events arrive in order of time.
    """

    def limit(found_key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(parts)).sort_values(["seconds", "tie"])
        log = list(state.get[0]) if state.exists else []
        times = part["seconds"].tolist()
        allowed = sliding_log([*log, *times], window, most)[len(log) :]
        log = [t for t in [*log, *(t for t, ok in zip(times, allowed, strict=True) if ok)] if t > times[-1] - window]
        state.update((log,))
        yield pd.DataFrame({key: found_key[0], tie: part["tie"], "allowed": allowed})

    chosen = events.select(F.col(key).cast("long").alias("key"), F.col(tie).cast("long").alias("tie"), F.col(seconds).cast("double").alias("seconds"))
    return chosen.groupBy("key").applyInPandasWithState(limit, f"{key} long, {tie} long, allowed boolean", "log array<double>", "append", GroupStateTimeout.NoTimeout)


def deliveries(events: DataFrame, ts: str, key: str, tie: str, kind: str, rules: Rules, late: str = "0 seconds") -> DataFrame:
    """(key, at, status, attempt): the transitions of :mod:`lodestone.operators.delivery` as they happen.

    The open entry of a key is its state; its next timer is a timeout on event time, which
    fires once the watermark has passed it, so a key of which nothing more is heard still has
    its retry and its expiry. A restarted query goes on from the state of its checkpoint. Equal
    to the batch form up to the last watermark if each key's events arrive in order of time.
    """

    def act(found_key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry = Entry(*state.get) if state.exists else Entry()
        mark = state.getCurrentWatermarkMs() / 1000
        out = []
        if not state.hasTimedOut:
            for row in pd.concat(list(parts)).sort_values(["seconds", "tie"]).itertuples():
                out += happen(entry, row.seconds, row.kind or "", rules)
        out += advance(entry, mark, rules)
        timer = entry.next_timer(rules)
        if timer is None:
            state.remove()
        else:
            state.update((entry.opened, entry.attempt, entry.due))
            state.setTimeoutTimestamp(max(int(timer * 1000), int(mark * 1000) + 1))
        yield pd.DataFrame({key: [found_key[0]] * len(out), "at": [x[0] for x in out], "status": [x[1] for x in out], "attempt": [x[2] for x in out]}).astype({"status": object})

    seconds = (F.unix_micros(F.col(ts)) / 1000000).alias("seconds")
    chosen = events.withWatermark(ts, late).select(F.col(key).cast("long").alias("key"), ts, seconds, F.col(tie).cast("long").alias("tie"), F.col(kind).cast("string").alias("kind"))
    return chosen.groupBy("key").applyInPandasWithState(act, f"{key} long, at double, status string, attempt int", "opened double, attempt int, due double", "append", GroupStateTimeout.EventTimeTimeout)


def ingest_once(stream: DataFrame, folder: str, checkpoint: str, key: str):
    """Start a query that appends rows whose key the folder hasn't yet.

    Each batch is written to a folder of its own number, so a batch that is run again
    after a failure replaces itself, and keys of earlier batches are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        earlier = [f"{folder}/batch={n}" for n in range(number)]
        if number:
            seen = spark.read.schema(batch.schema).parquet(*earlier).select(key)
            rows = rows.join(seen, key, "left_anti")
        rows.select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(rows: DataFrame, folder: str) -> None:
    """Add rows to the folder that a stream reads."""
    rows.write.mode("append").parquet(folder)


def stage(spark: SparkSession, source: str, schema: StructType, work, sink: str, checkpoint: str, key: str):
    """Start one stage: what arrives in ``source`` goes through ``work`` to the ``sink``, each ``key`` once.

    The checkpoint remembers what has been read, so a stage that is started again goes
    on where it stopped, and a failed batch is worked on again: at least once, and with
    :func:`ingest_once` as the sink in effect once.
    """
    arriving = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    return ingest_once(work(arriving), sink, checkpoint, key)


def staged(spark: SparkSession, source: str, schema: StructType, stages: list, folder: str) -> DataFrame:
    """Run stages (name, key, work) one behind the other until each has read all there is; the last one's rows.

    Each stage reads what the one before wrote below ``folder``.
    """
    for name, key, work in stages:
        out = f"{folder}/{name}"
        stage(spark, source, schema, work, out, f"{folder}/{name}-checkpoint", key).awaitTermination()
        found = spark.read.option("recursiveFileLookup", "true").parquet(out)
        source, schema = out, found.schema
    return found

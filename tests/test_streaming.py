"""Streams give what their batch forms give."""

from pyspark.sql import functions as F

from lodestone.operators import delivery, ordered
from lodestone.plans.telemetry import metrics
from lodestone.streaming import jobs

DIR = "/root/testdata/sf0.001"


def arriving(spark, folder):
    """The events in order of time, as three files."""
    events = metrics(spark, DIR).withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts", "event_id").collect()
    schema = metrics(spark, DIR).withColumn("ts", F.col("ts").cast("timestamp")).schema
    step = -(-len(events) // 3)
    for i in range(3):
        spark.createDataFrame(events[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(folder)
    return schema


def drained(df, name, checkpoint, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_sliding_limit(spark, tmp_path):
    schema = arriving(spark, f"{tmp_path}/in")
    stream = jobs.sliding_limit(jobs.read_files(spark, f"{tmp_path}/in", schema, 10), "user_id", "sec", "event_id", 86400, 3)
    got = sorted(map(tuple, drained(stream, "limited", f"{tmp_path}/c", "append").collect()))
    assert got == sorted(map(tuple, ordered.sliding_limit(metrics(spark, DIR), "user_id", "sec", "event_id", 86400, 3).collect()))


def test_windowed_counts(spark, tmp_path):
    schema = arriving(spark, f"{tmp_path}/in")
    counts = jobs.windowed_counts(jobs.read_files(spark, f"{tmp_path}/in", schema), "ts", ["strategy"], "1 day", "40 days")
    got = drained(counts, "counted", f"{tmp_path}/c", "complete")
    assert got.agg(F.sum("n")).first()[0] == metrics(spark, DIR).count()


def test_ingest_is_idempotent_and_restarts(spark, tmp_path):
    schema = arriving(spark, f"{tmp_path}/in")
    for _ in range(2):  # the second start resumes from the checkpoint and finds nothing new
        jobs.ingest_once(jobs.read_files(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/c", "event_id").awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.select("event_id").distinct().count() == metrics(spark, DIR).count()
    spark.read.parquet(f"{tmp_path}/in").limit(5).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in2")
    again = spark.read.schema(schema).parquet(f"{tmp_path}/in2")
    again.write.mode("append").parquet(f"{tmp_path}/in")
    jobs.ingest_once(jobs.read_files(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/c", "event_id").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == metrics(spark, DIR).count()


RULES = delivery.Rules(1, 14400.0, 259200.0)


def test_delivery_rules():
    entry, rules = delivery.Entry(), delivery.Rules(2, 10.0, 100.0)
    happen = lambda t, kind: delivery.happen(entry, t, kind, rules)
    assert happen(0, "new") == [(0, "delivered", 0)]
    assert happen(1, "error") == [(1, "waiting", 0)] and happen(2, "error") == []
    assert happen(12, "error") == [(11, "retry", 1), (12, "waiting", 1)]  # the delay doubles
    assert happen(40, "error") == [(32, "retry", 2), (40, "failed", 2)]
    assert happen(50, "x") == [(50, "delivered", 0)] and happen(60, "ack") == [(60, "completed", 0)]
    assert happen(70, "error") == [(70, "delivered", 0)] and happen(165, "error") == [(165, "waiting", 0)]
    assert happen(171, "end") == [(170, "expired", 0)]  # before the retry due at 175
    assert entry.next_timer(rules) is None


def test_deliveries_with_timers_and_a_restart(spark, tmp_path):
    schema = arriving(spark, f"{tmp_path}/in")
    kind = F.when(F.col("strategy") == "signup", "ack").otherwise(F.col("strategy"))
    events = spark.read.schema(schema).parquet(f"{tmp_path}/in").withColumn("seconds", F.unix_micros("ts") / 1000000).withColumn("kind", kind)
    files = sorted(p for p in (tmp_path / "in").iterdir() if p.suffix == ".parquet")
    first = {p: spark.read.parquet(str(p)).agg(F.min("ts")).first()[0] for p in files}
    # the query stops after each file and is started again from its checkpoint
    for n, p in enumerate(sorted(files, key=first.get)):
        (tmp_path / "arrived").mkdir(exist_ok=True)
        (tmp_path / "arrived" / f"{n}.parquet").write_bytes(p.read_bytes())
        stream = jobs.read_files(spark, f"{tmp_path}/arrived", schema).withColumn("kind", kind)
        made = jobs.deliveries(stream, "ts", "user_id", "event_id", "kind", RULES)
        made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    mark = max(r[0] for r in events.select(F.max("seconds")).collect())
    expect = delivery.delivered(events, "user_id", "seconds", "event_id", "kind", RULES, mark).collect()
    rows = lambda found: sorted((r["user_id"], round(r["at"], 3), r["status"], r["attempt"]) for r in found)
    got, want = rows(out), rows(expect)
    # timers of the very last moments may wait for a watermark that no event brings
    late = [x for x in want if x not in set(got)]
    assert len(got) == len(set(got)) and set(got) <= set(want) and all(x[1] > mark - 1 and x[2] in ("retry", "expired") for x in late)
    assert {x[2] for x in got} == {"delivered", "waiting", "retry", "failed", "completed", "expired"}

"""A stream of the event log gives what the batch twin gives."""

import pytest
from pyspark.sql import functions as F

from docspark.plans import inputs
from docspark.streaming import events as ev


@pytest.fixture
def log(spark, sf, tmp_path):
    jobs = inputs.jobs(spark, sf).orderBy("event_id").limit(600).withColumn("happened_at", F.col("happened_at").cast("timestamp"))
    jobs.repartition(1).write.parquet(str(tmp_path / "log"))
    batch = spark.read.parquet(str(tmp_path / "log"))
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))


def drained(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return sorted(map(str, stream.sparkSession.table(name).collect()))


def test_progress(log):
    assert drained(ev.progress(log[1]), "complete", "progress") == sorted(map(str, ev.progress(log[0]).collect()))


def test_windows_and_attempts(log):
    assert drained(ev.per_window(log[1]), "complete", "windows") == sorted(map(str, ev.per_window(log[0]).collect()))
    args = ("error", 1, "24 hours", "6 hours")
    assert drained(ev.attempts(log[1], *args), "complete", "attempts") == sorted(map(str, ev.attempts(log[0], *args).collect()))


def test_lockouts(log):
    args = ("error", "purchase", 2)
    assert drained(ev.lockout_stream(log[1], *args), "append", "lockouts") == sorted(map(str, ev.lockouts(log[0], *args).collect()))


def test_first_uploads(log):
    key = ["job_id", "event", "event_id"]
    got = drained(ev.first_uploads(log[1], key).select(*key), "append", "uploads")
    assert got == sorted(map(str, log[0].select(*key).distinct().collect()))


def test_idle_sessions(log):
    twin = ev.idle_sessions(log[0], "1 hour")
    assert drained(ev.idle_sessions(log[1], "1 hour"), "complete", "idle") == sorted(map(str, twin.collect()))


def test_late_events(spark):
    at = lambda m: F.expr(f"timestamp '2024-01-01 00:00:00' + interval {m} minutes")
    rows = [(1, 1, 0), (2, 1, 60), (3, 1, 55), (4, 1, 10), (5, 2, 0)]
    df = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(e).alias("event_id"), F.lit(j).alias("job_id"), at(m).alias("happened_at")) for e, j, m in rows])).alias("r")).select("r.*")
    assert [r.event_id for r in ev.late_events(df, "10 minutes").collect()] == [4]

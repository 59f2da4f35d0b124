"""Operators over the event log.  Each function takes a streaming or a bounded frame of job events (event_id, job_id,
happened_at, event, to_status, progress); on the bounded one it is the batch twin with the same result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Which status may follow which.
LEGAL = (("PENDING", "RUNNING"), ("RUNNING", "COMPLETED"), ("RUNNING", "FAILED"), ("FAILED", "PENDING"), ("COMPLETED", "PENDING"), ("PENDING", "FAILED"))


def marked(events: DataFrame, delay: str) -> DataFrame:
    """With a watermark, if it is a stream (which needs a time with a zone)."""
    return events.withColumn("happened_at", F.col("happened_at").cast("timestamp")).withWatermark("happened_at", delay) if events.isStreaming else events


def progress(events: DataFrame) -> DataFrame:
    """Live progress per job: events so far, floor of the mean progress, latest status.  Output mode update or complete."""
    return events.groupBy("job_id").agg(F.count("*").alias("n"), F.floor(F.avg("progress")).alias("progress"), F.max_by("to_status", F.struct("happened_at", "event_id")).alias("status"))


def per_window(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tumbling counts by event type."""
    out = marked(events, delay).groupBy(F.window("happened_at", size), "event").agg(F.count("*").alias("n"), F.sum("progress").alias("progress"))
    return out.select(F.col("window.start").alias("started_at"), "event", "n", "progress")


def attempts(events: DataFrame, failure: str, least: int, size: str = "15 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Jobs with ``least`` failures or more in a sliding window."""
    out = marked(events.where(F.col("event") == failure), delay).groupBy(F.window("happened_at", size, slide), "job_id").agg(F.count("*").alias("n"))
    return out.where(F.col("n") >= least).select(F.col("window.start").alias("started_at"), "job_id", "n")


def first_uploads(events: DataFrame, key: list[str], delay: str = "1 hour") -> DataFrame:
    """Each key once: within the watermark on a stream, by the smallest event_id on a bounded frame."""
    if events.isStreaming:
        return marked(events, delay).dropDuplicatesWithinWatermark(key)
    others = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.min_by(F.struct(*others), "event_id").alias("_f")).select(*key, *[F.col(f"_f.{c}").alias(c) for c in others])


def idle_sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Sessions (events of a job less than ``gap`` apart) that didn't end in a terminal status: those to resume."""
    out = marked(events, delay).groupBy(F.session_window("happened_at", gap), "job_id").agg(F.count("*").alias("n"), F.max_by("to_status", F.struct("happened_at", "event_id")).alias("status"))
    return out.where(~F.col("status").isin("COMPLETED", "FAILED")).select(F.col("session_window.start").alias("started_at"), "job_id", "n", "status")


def late_events(events: DataFrame, delay: str) -> DataFrame:
    """Bounded: events that came (by event_id) when a later one of their job, by more than ``delay``, had been seen."""
    before = W.partitionBy("job_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn("_seen", F.max("happened_at").over(before)).where(F.col("happened_at") < F.col("_seen") - F.expr(f"INTERVAL {delay}")).drop("_seen")


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Bounded: status changes that the table of legal ones doesn't have."""
    from ..operators import history

    legal = F.array(*[F.lit(f"{a}>{b}") for a, b in LEGAL])
    moved = history.status_history(events).where("from_status is not null")
    return moved.where(~F.array_contains(legal, F.concat_ws(">", "from_status", "to_status")))


def lockouts(events: DataFrame, failure: str, success: str, most: int) -> DataFrame:
    """Bounded: every ``most``-th failure in a row locks the job (failures since the last success): job_id, event_id, locked_at."""
    rows = events.where(F.col("event").isin(failure, success))
    along = W.partitionBy("job_id").orderBy("happened_at", "event_id").rowsBetween(W.unboundedPreceding, 0)
    run = rows.withColumn("_run", F.sum((F.col("event") == success).cast("int")).over(along)).where(F.col("event") == failure)
    nth = F.row_number().over(W.partitionBy("job_id", "_run").orderBy("happened_at", "event_id"))
    return run.withColumn("_n", nth).where(F.col("_n") % most == 0).select("job_id", "event_id", F.col("happened_at").alias("locked_at"))


def lockout_stream(events: DataFrame, failure: str, success: str, most: int) -> DataFrame:
    """The same on a stream: the state of a job is its failures in a row.  Events of a batch are taken in order of time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        out = []
        for pdf in frames:
            for r in pdf.sort_values(["happened_at", "event_id"]).itertuples(index=False):
                n = n + 1 if r.event == failure else 0
                if n and n % most == 0:
                    out.append((key[0], r.event_id, r.happened_at))
        state.update((n,))
        yield pd.DataFrame(out, columns=["job_id", "event_id", "locked_at"])

    rows = events.where(F.col("event").isin(failure, success)).select("job_id", "event_id", "happened_at", "event")
    return rows.groupBy("job_id").applyInPandasWithState(run, "job_id long, event_id long, locked_at timestamp", "n int", "append", "NoTimeout")

"""Versions, status histories and job roll-ups over append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

TERMINAL = ("COMPLETED", "FAILED")


def next_versions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], existing: DataFrame | None = None) -> DataFrame:
    """Adds ``version``: rows of one key are numbered in order, after the key's largest version in ``existing``."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")
    if existing is None:
        return rows.withColumn("version", n)
    last = existing.groupBy(*keys).agg(F.max("version").alias("_last"))
    return rows.join(last, list(keys), "left").withColumn("version", F.coalesce("_last", F.lit(0)) + n).drop("_last")


def latest_version(rows: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """The row with the largest version of each key, by a max over the row (combined before the shuffle, no sort)."""
    others = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(version)).alias("_top"))
    return top.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in others])


def list_records(rows: DataFrame, newest: Sequence[Column], limit: int, offset: int = 0, **equals) -> DataFrame:
    """Rows that equal all given values (None: any), newest first, one page of them."""
    for column, value in equals.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(*newest).offset(offset).limit(limit)


def in_use(records: DataFrame, jobs: DataFrame, key: str, job: str) -> DataFrame:
    """Records that jobs refer to: key, n_jobs, jobs (ids in order); these can't be deleted."""
    refs = jobs.groupBy(key).agg(F.count_distinct(job).alias("n_jobs"), F.array_join(F.array_sort(F.collect_set(job)), " ").alias("jobs"))
    return records.select(key).distinct().join(refs, key)


def deletable(records: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    return records.join(jobs.select(key).distinct(), key, "left_anti")


def status_history(events: DataFrame, keys: Sequence[str] = ("job_id",), at: Sequence[str] = ("happened_at", "event_id")) -> DataFrame:
    """Adds from_status (the status before) to each event that changes the status."""
    along = W.partitionBy(*keys).orderBy(*at)
    return events.withColumn("from_status", F.lag("to_status").over(along)).where(~F.col("to_status").eqNullSafe(F.col("from_status")))


def current_status(events: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    return events.groupBy(*keys).agg(F.max_by("to_status", F.struct("happened_at", "event_id")).alias("status"), F.max("happened_at").alias("happened_at"))


def transition_if(changes: DataFrame, current: DataFrame, key: str, expected: str = "expected") -> DataFrame:
    """Changes whose expected status is the key's current one."""
    return changes.join(current.select(key, F.col("status").alias("_now")), key).where(F.col(expected) == F.col("_now")).drop("_now")


def batch_progress(documents: DataFrame, job: str = "job_id") -> DataFrame:
    """Per job of documents (status, progress): total, completed, failed, progress (floor of the mean) and status."""
    done, bad = F.count_if(F.col("status") == "COMPLETED"), F.count_if(F.col("status") == "FAILED")
    out = documents.groupBy(job).agg(F.count("*").alias("total"), done.alias("completed"), bad.alias("failed"), F.floor(F.coalesce(F.avg("progress"), F.lit(100.0))).alias("progress"))
    return out.withColumn("status", F.when(F.col("completed") + F.col("failed") < F.col("total"), "RUNNING").when(F.col("failed") == F.col("total"), "FAILED").otherwise("COMPLETED"))


def call_rollup(events: DataFrame, task: str, tokens: str, latency: str) -> DataFrame:
    """Per task: calls, tokens, latency, errors."""
    return events.groupBy(task).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), F.sum(latency).alias("latency"), F.count_if(F.col("status") == "error").alias("errors"))


def edit_version(latest: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """The version an edit goes to: the same while in review (status not final), the next one after approval; 1 for new keys."""
    now = latest.select(key, F.col("version").alias("_v"), F.col("status").alias("_s"))
    at = F.when(F.col("_v").isNull(), F.lit(1)).when(F.col("_s") == "approved", F.col("_v") + 1).otherwise(F.col("_v"))
    return edits.join(now, key, "left").withColumn("version", at.cast("long")).drop("_v", "_s")

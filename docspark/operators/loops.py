"""Scratch tables for operators that go round by round: each round is written to the shared folder, so lineage stays short and a lost executor loses nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a new local one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_docspark_dir", None)
    if found is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = sc._docspark_dir = "file://" + tempfile.mkdtemp(prefix="docspark-")
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that Spark removes when the application ends."""
    path = f"{shared_dir(spark)}/docspark-{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._docspark_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote, once all that reads them has been written in turn."""
    for df in tables:
        jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._docspark_path)
        jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


class Finished:
    """Rows that a loop is done with, appended to one table of the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.schema = spark, new_path(spark, label), None

    def add(self, df: DataFrame) -> None:
        self.schema = self.schema or df.schema
        df.write.option("compression", "zstd").mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def until_empty(start: DataFrame, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]], label: str) -> DataFrame:
    """Apply ``step`` to what is left, (finished, left) = step(left), until nothing is left; returns all finished rows.

    Every round writes the rows that are left and appends those that are finished, so each row is written once per round it stays in.
    """
    done, left = Finished(start.sparkSession, f"{label}-done"), stored(start, label)
    while True:
        finished, rest = step(left)
        done.add(finished)
        rest = stored(rest, label)
        release(left)
        left = rest
        if left.isEmpty():
            release(left)
            return done.table()

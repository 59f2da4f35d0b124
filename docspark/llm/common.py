"""Helpers that the operators of this package share: scratch tables, bounded broadcasts, Bloom filters, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.loops import new_path

WS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: While a scratch table is written: shuffle files go when the execution that made them has ended, instead of when the driver's garbage collector finds
#: them (a stage that lost them is run again), and Arrow batches are bounded by bytes, as rows may be sets of many thousand hashes.
_LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Run what is inside with the settings above; the session's own are put back."""
    before = {k: spark.conf.get(k, None) for k in _LEAN}
    for k, v in _LEAN.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    A lost executor can't lose it, and whatever reads it twice doesn't compute it twice.  Shuffles that led to it are removed.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with lean(spark):
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docspark_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote, once all that reads them has been written in turn."""
    for df in tables:
        jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._docspark_path)
        jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def slices(batches: Iterator[pa.RecordBatch], text_at: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one slice hold about ``most`` bytes (one long text may exceed it)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_offsets(batch.column(text_at))[1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def text_offsets(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string (UTF-8) or binary column and the n+1 offsets of its rows (a null row is empty)."""
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def bloom_size(keys: int, most: int = 28) -> int:
    """log2 of the bits of a Bloom filter for so many keys: 16 a key, at most 2**most (32 MiB); beyond that it prunes less, nothing else."""
    return min(most, max(16, (16 * keys - 1).bit_length()))


def bloom_bits(df: DataFrame, key: str, log2_bits: int) -> np.ndarray:
    """A Bloom filter (two probes) of a column of well-mixed longs, as 2**log2_bits bits on the driver; log2_bits is 6 to 32.

    Spark ORs the bits; the driver gets 2**(log2_bits-6) words at most however many keys there are, so the size is bounded.
    False positives only cost work: callers join exactly afterwards.
    """
    mask = (1 << log2_bits) - 1
    probes = df.select(F.explode(F.array(F.col(key), F.shiftrightunsigned(key, 32))).alias("h")).select(F.col("h").bitwiseAND(F.lit(mask)).alias("b"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))
    with lean(df.sparkSession):
        got = probes.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(bit).alias("v")).toArrow()
    out = np.zeros(1 << (log2_bits - 6), np.uint64)
    out[got["w"].to_numpy()] = got["v"].to_numpy().view(np.uint64)
    return out


def in_bloom(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys (uint64) may be in the filter."""
    mask = np.uint64(len(bits) * 64 - 1)
    hit = np.ones(len(key), bool)
    for h in (key, key >> np.uint64(32)):
        b = h & mask
        hit &= ((bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1)).astype(bool)
    return hit


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table (a, b): one row (node, root) per node, root the smallest node reached.

    Alternates the large-star and small-star steps, each a min-aggregate and a join, until no edge changes, however many rounds that takes; every
    round is written to the shared folder.  The number of rounds is logarithmic in the size of the largest component.
    """
    cur = stored(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not state.n or (state.n, state.h) == before:
            break
        before = (state.n, state.h)
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "edges")
        release(cur)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        cur = stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        release(large)
    roots = cur.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    out = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "components")
    release(cur)
    return out

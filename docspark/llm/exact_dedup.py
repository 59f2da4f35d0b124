"""Exact deduplication by progressive refinement: length, then a hash of the prefix, then the hash of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, stored


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, broadcast_rows: int = 200_000, digest: bool = False) -> DataFrame:
    """Group texts that are identical after all blanks go, and keep one row of each group.

    1. Group the rows by the length of the text without blanks, 2. the rows of shared lengths by a hash of their first
    ``prefix_chars`` characters, 3. the rows of shared (length, prefix) by the SHA-256 of all of it.  Only rows that survive
    two rounds are hashed whole.  Every round counts with map-side combining, so a group that holds a third of all rows
    reaches the shuffle as one row a task; the joins back to the rows send the small side to all tasks if it has
    ``broadcast_rows`` rows at most and else are sort-merge joins, whose skewed partitions Spark splits.

    Returns a row per input row: doc_id, keep_id, group_size, kept; with ``digest`` also text_sha256, the hash of every text.
    The row with the longest original text stays, then the smallest id (null after all others).
    A null text is an empty text; empty texts are equal.  Rows that repeat an id in a group share its fate (kept is true for
    each of them if the id stays).  Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("norm", F.regexp_replace("text", WS + "+", ""))
    small = stored(rows.select(F.char_length("norm").alias("norm_len"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix")).groupBy("norm_len", "prefix").agg(F.count("*").alias("n")), "prefixes")
    lengths = small.groupBy("norm_len").agg(F.sum("n").alias("same")).where("same > 1")
    again = small.join(lengths, "norm_len", "left_semi").where("n > 1").select("norm_len", "prefix", F.lit(True).alias("again"))
    again = stored(again, "survivors")
    if again.count() <= broadcast_rows:
        again = F.broadcast(again)
    keyed = rows.select("doc_id", F.char_length("text").alias("n_chars"), "norm", F.char_length("norm").alias("norm_len"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"))
    whole = F.sha2(F.encode("norm", "UTF-8"), 256)
    hashed = keyed.join(again, ["norm_len", "prefix"], "left").select("doc_id", "n_chars", (whole if digest else F.when(F.col("again"), whole)).alias("full"), F.coalesce("again", F.lit(False)).alias("again"))
    hashed = stored(hashed, "hashes")
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    groups = hashed.where("again").groupBy("full").agg(F.count("*").alias("group_size"), best.alias("best")).where("group_size > 1")
    groups = groups.select("full", "group_size", F.col("best.doc_id").alias("keep_id"), F.lit(True).alias("grouped"))
    groups = stored(groups, "groups")  # so that the join below shuffles by itself and Spark can split a hot group
    out = hashed.join(groups, "full", "left").select(
        "doc_id",
        F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("full").alias("text_sha256"),
    )
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return out.select("doc_id", "keep_id", "group_size", "kept", *(["text_sha256"] if digest else []))

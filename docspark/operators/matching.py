"""Matching by place, hash and order: boxes, near hashes, nearest neighbours in a sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def sign_hash(vector: Column, bits: int) -> Column:
    """Bit k set if component k is positive."""
    places = F.sequence(F.lit(1), F.lit(bits))
    return F.aggregate(places, F.lit(0).cast("long"), lambda acc, k: acc + F.when(F.element_at(vector, k) > 0, F.pow(F.lit(2.0), k - 1).cast("long")).otherwise(F.lit(0).cast("long")))


def hamming_match(rows: DataFrame, library: DataFrame, key: str, meaning: str, most: int, bits: int = 64) -> DataFrame:
    """The first meaning of a labelled library within ``most`` bits of each hash of ``bits`` bits; null if none.

    Hashes at most that far apart agree in one of ``most`` + 1 bands of bits, so distinct hashes and library entries join by band, whatever their number.
    """
    width = -(-bits // (most + 1))

    def banded(df: DataFrame) -> DataFrame:
        bands = [F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("h", k * width).bitwiseAND(F.lit((1 << width) - 1)).alias("v")) for k in range(-(-bits // width))]
        return df.withColumn("_band", F.explode(F.array(*bands)))

    known = library.groupBy("h").agg(F.min(meaning).alias("meaning"))
    met = banded(rows.select("h").distinct()).join(banded(known).withColumnRenamed("h", "_h"), "_band")
    near = met.where(F.bit_count(F.col("h").bitwiseXOR(F.col("_h"))) <= most).groupBy("h").agg(F.min("meaning").alias("meaning"))
    return rows.select(key, "h").join(near, "h", "left").select(key, "meaning")


def point_in_box(points: DataFrame, boxes: DataFrame, on: Sequence[str], cell: float) -> DataFrame:
    """Points with the boxes they lie in, edges included; boxes are met by the grid cells they cover, so both sides join by equality.

    points: on, x, y; boxes: on, x0, y0, x1, y1.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    covered = boxes.withColumn("_cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("_cy", F.explode(F.sequence(at("y0"), at("y1"))))
    placed = points.withColumn("_cx", at("x")).withColumn("_cy", at("y"))
    met = placed.join(covered, [*on, "_cx", "_cy"])
    return met.where((F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))).drop("_cx", "_cy")


def nested_boxes(boxes: DataFrame, on: Sequence[str], key: str, cell: float = 25.0) -> DataFrame:
    """Boxes that no larger box of the same page contains (of equal ones the smallest key stays).

    A box that contains another covers the grid cell of its first corner, so both sides join by equality; an anti-join makes no pairs, and
    equal boxes stand there once.
    """
    cols = ["x0", "y0", "x1", "y1"]
    at = lambda c: F.floor(F.col(c) / cell)
    other = boxes.groupBy(*on, *cols).agg(F.min(key).alias("_k"))
    other = other.withColumn("_cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("_cy", F.explode(F.sequence(at("y0"), at("y1"))))
    other = other.select(*[F.col(c).alias(f"_on_{c}") for c in on], "_k", "_cx", "_cy", *[F.col(c).alias(f"_{c}") for c in cols])
    inside = (F.col("_x0") <= F.col("x0")) & (F.col("_y0") <= F.col("y0")) & (F.col("_x1") >= F.col("x1")) & (F.col("_y1") >= F.col("y1"))
    same = (F.col("_x0") == F.col("x0")) & (F.col("_y0") == F.col("y0")) & (F.col("_x1") == F.col("x1")) & (F.col("_y1") == F.col("y1"))
    met = (F.col("_cx") == at("x0")) & (F.col("_cy") == at("y0"))
    for c in on:
        met &= F.col(c) == F.col(f"_on_{c}")
    return boxes.join(other, met & (F.col("_k") != F.col(key)) & inside & (~same | (F.col("_k") < F.col(key))), "left_anti")


def nearest_link(rows: DataFrame, wants: Column, offers: Column, key: str, within: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows that want a link with the nearest offering row before, else after: key, target, side."""
    before = W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*within).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    offer = F.when(offers, F.col(key))
    out = rows.withColumn("_b", F.last(offer, ignorenulls=True).over(before)).withColumn("_a", F.first(offer, ignorenulls=True).over(after)).where(wants)
    return out.withColumn("target", F.coalesce("_b", "_a")).withColumn("side", F.when(F.col("_b").isNotNull(), "before").when(F.col("_a").isNotNull(), "after")).drop("_a", "_b")

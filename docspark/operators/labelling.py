"""Labels of units, multisets, neighbours in a new order, write-back, draft checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as t


def multiset_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How often a has a key more than b (lost) and the reverse (added); equal counts are left out."""
    na, nb = a.groupBy(*keys).agg(F.count("*").alias("_a")), b.groupBy(*keys).agg(F.count("*").alias("_b"))
    both = na.join(nb, list(keys), "full_outer").na.fill(0, ["_a", "_b"]).where("_a <> _b")
    zero = F.lit(0).cast("long")
    return both.select(*keys, F.greatest(F.col("_a") - F.col("_b"), zero).alias("lost"), F.greatest(F.col("_b") - F.col("_a"), zero).alias("added"))


def label_terms(rows: DataFrame, least_words: int, most_words: int, min_texts: int) -> DataFrame:
    """Short label texts in several documents: term, n_texts."""
    n = F.size(t.extract(F.col("text"), r"\p{L}+"))
    counts = rows.where(n.between(least_words, most_words)).groupBy(F.col("text").alias("term")).agg(F.count_distinct("doc_id").alias("n_texts"))
    return counts.where(F.col("n_texts") >= min_texts)


def first_values(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The first value of each key by position, and how many there were."""
    return rows.groupBy(*keys).agg(F.min(F.struct(order, value))[value].alias(value), F.count("*").alias("n"))


def unit_labels(units: DataFrame, cues: dict[str, Sequence[str]]) -> DataFrame:
    """Adds ``labels``: label to weight, by the share of cue words of each label; all 0 without any."""
    w = t.words(F.col("text"))
    hits = {k: F.size(F.filter(w, _among(v))) for k, v in cues.items()}
    counted = units.withColumn("_h", F.struct(*[c.alias(k) for k, c in hits.items()]))
    total = sum((F.col(f"_h.{k}") for k in cues), F.lit(0))
    pairs = [x for k in cues for x in (F.lit(k), F.when(total > 0, F.col(f"_h.{k}") / total).otherwise(0.0))]
    return counted.withColumn("labels", F.create_map(*pairs)).drop("_h")


def _among(values: Sequence[str]):
    known = F.array(*map(F.lit, values))
    return lambda x: F.array_contains(known, x)


def relative_side(order: DataFrame, within: str, unit: str, neighbour: Column) -> DataFrame:
    """Whether a unit still stands below its neighbour of the source in the new order (new_pos)."""
    a = order.withColumn("neighbour", neighbour)
    b = order.select(within, F.col(unit).alias("neighbour"), F.col("new_pos").alias("_p"))
    return a.join(b, [within, "neighbour"]).select(within, unit, "neighbour", (F.col("new_pos") > F.col("_p")).alias("stays_below"))


def write_back(sources: DataFrame, targets: DataFrame, locator: Sequence[str]) -> DataFrame:
    """Target texts at their places; the source text where there is none, marked."""
    return sources.join(targets, list(locator), "left").select(*locator, F.coalesce("target", "source").alias("text"), F.col("target").isNull().alias("fallback"))


def align_unmapped(sections: DataFrame, claimed: DataFrame, targets: DataFrame, key: str, name: str, default: int) -> DataFrame:
    """Sections that nobody claimed go to the first target whose part their name contains, else to the default.  Targets are a template's, a small dimension."""
    free = sections.join(claimed.distinct(), key, "left_anti")
    met = free.join(F.broadcast(targets), F.contains(F.col(name), F.col("part")), "left")
    return met.groupBy(key, name).agg(F.coalesce(F.min("target"), F.lit(default)).alias("target"))


def heal_shift(rows: DataFrame, within: Sequence[str], order: str, value: str) -> DataFrame:
    """Where a group's first row has a value and its last has none, every value moves one row down."""
    whole = W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shift = F.first(value).over(whole).isNotNull() & F.last(value).over(whole).isNull()
    moved = F.lag(value).over(W.partitionBy(*within).orderBy(order))
    return rows.withColumn("_shift", shift).withColumn("_moved", moved).withColumn(value, F.when(F.col("_shift"), F.col("_moved")).otherwise(F.col(value))).drop("_shift", "_moved")


def draft_checks(cited: DataFrame, planned: DataFrame, target: str, unit: str) -> DataFrame:
    """Per cited target: citations that aren't planned (n_stray) and planned units without citation (n_uncited)."""
    c, p = cited.withColumn("_c", F.lit(1)), planned.withColumn("_p", F.lit(1))
    both = c.join(p, [target, unit], "full_outer").groupBy(target)
    out = both.agg(F.count_if(F.col("_p").isNull()).alias("n_stray"), F.count_if(F.col("_c").isNull()).alias("n_uncited"), F.count("_c").alias("_n"))
    return out.where("_n > 0").drop("_n")

"""Mappings of source units to target sections and slots: accounting, coverage, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def claims_by_unit(claims: DataFrame, claim: str, units: str) -> DataFrame:
    """The bridge (claim_id, unit_id): each unit that a claim cites, once."""
    return claims.select(F.col(claim).alias("claim_id"), F.explode(F.array_distinct(units)).alias("unit_id"))


def orphans(references: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(kind, id) of every id that a plan names (first frame) and that doesn't exist (second frame)."""
    out = None
    for kind, (named, known) in references.items():
        k = known.toDF("id")
        part = named.toDF("id").distinct().join(k, "id", "left_anti").select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def unaccounted(units: DataFrame, key: str, *placed: DataFrame) -> DataFrame:
    """Units that none of the frames accounts for."""
    for p in placed:
        units = units.join(p.select(key), key, "left_anti")
    return units


def covered_units(mapping: DataFrame, within: Sequence[str], unit: str, listed: str = "listed") -> DataFrame:
    """Of a group with listed units only those, else all."""
    some = F.max(F.col(listed).cast("int")).over(W.partitionBy(*within))
    return mapping.withColumn("_some", some).where((F.col("_some") == 0) | F.col(listed)).drop("_some")


def double_placed(mapping: DataFrame, unit: str, target: str) -> DataFrame:
    return mapping.groupBy(unit).agg(F.count_distinct(target).alias("n_targets")).where("n_targets > 1")


def stray_citations(cited: DataFrame, planned: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct pairs that are cited and not planned (or the reverse)."""
    return cited.select(*on).distinct().join(planned.select(*on), list(on), "left_anti")


def planned_units(callouts: DataFrame, content: DataFrame, on: Sequence[str]) -> DataFrame:
    """A callout loses units that a content slot of its section has."""
    return callouts.join(content.select(*on), list(on), "left_anti").unionByName(content)


def coverage(units: DataFrame, placed: DataFrame, section: str, unit: str) -> DataFrame:
    """Per section: units, placed units and their share."""
    hit = placed.select(unit, F.lit(1).alias("_hit")).distinct()
    out = units.join(hit, unit, "left").groupBy(section).agg(F.count("*").alias("n_units"), F.count("_hit").alias("n_placed"))
    return out.withColumn("coverage", F.col("n_placed") / F.col("n_units"))


def best_and_margin(scores: DataFrame, source: str, target: str, score: str) -> DataFrame:
    """The best target of each source and how far ahead of the second it is."""
    along = W.partitionBy(source).orderBy(F.desc(score), target)
    ranked = scores.withColumn("_n", F.row_number().over(along)).withColumn("_second", F.lead(score).over(along))
    return ranked.where("_n = 1").select(source, target, score, (F.col(score) - F.coalesce("_second", F.lit(0))).alias("margin"))


def score_matrix(sources: DataFrame, targets: DataFrame, score: Column, block: int = 1000) -> DataFrame:
    """Every source with every target of a template, and its score.

    Targets are dealt to blocks of about ``block`` by a hash, and each source meets the blocks one by one through an equi-join, so what a task holds of the targets is bounded however many there
    are; the result itself has a row per pair, as asked.  A block is sent to all tasks where there is only one.
    """
    n = targets.count()
    blocks = max(1, -(-n // block))
    dealt = targets.withColumn("_block", F.pmod(F.xxhash64(*targets.columns), F.lit(blocks)).cast("int"))
    met = sources.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return met.join(F.broadcast(dealt) if blocks == 1 else dealt, "_block").drop("_block").withColumn("score", score)


def apply_overrides(detected: DataFrame, overrides: DataFrame, on: str, fields: Sequence[str]) -> DataFrame:
    """Configured values win over detected ones."""
    o = overrides.select(on, *[F.col(f).alias(f"_o_{f}") for f in fields])
    out = detected.join(o, on, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(f"_o_{f}", f))
    return out.drop(*[f"_o_{f}" for f in fields])


def uncovered(given: DataFrame, *used: DataFrame) -> DataFrame:
    out = given.distinct()
    for u in used:
        out = out.exceptAll(out.intersect(u))
    return out


def sections_present(sections: DataFrame, live: DataFrame, key: str) -> DataFrame:
    hit = live.select(key, F.lit(True).alias("_live")).distinct()
    return sections.join(hit, key, "left").select(*sections.columns, F.coalesce("_live", F.lit(False)).alias("present"))


def trace_rows(rows: DataFrame, by: Sequence[str], order: str, value: str, name: str, sep: str = " ") -> DataFrame:
    """Flat rows with an array column joined to text, in order."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("string").alias("_v")))), lambda s: s["_v"])
    return rows.groupBy(*by).agg(F.array_join(items, sep).alias(name))


def section_status(issues: DataFrame) -> DataFrame:
    """Per section: NEEDS_REVIEW for an open critical issue, REPAIRING for an open one with a gate, else VALIDATED."""
    is_open = ~F.col("resolved")
    out = issues.groupBy("section_id").agg(F.bool_or(is_open & (F.col("severity") == "critical")).alias("_h"), F.bool_or(is_open & F.col("gate").isNotNull()).alias("_r"))
    return out.select("section_id", F.when(F.col("_h"), "NEEDS_REVIEW").when(F.col("_r"), "REPAIRING").otherwise("VALIDATED").alias("status"))

"""Documents to sections, units and lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def text_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per line in order: the other columns, seq from 1, text."""
    keep = [c for c in docs.columns if c not in (text, "n_chars")]
    rows = docs.select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("_pos", "text"))
    return rows.select(*keep, (F.col("_pos") + 1).cast("long").alias("seq"), "text")


def duplicate_occurrence(rows: DataFrame, within: Sequence[str], text: Column, order: Sequence[str]) -> DataFrame:
    """Adds ``occurrence``: the n-th time a text (as the given form) occurs within its section."""
    return rows.withColumn("_form", text).withColumn("occurrence", F.row_number().over(W.partitionBy(*within, "_form").orderBy(*order)).cast("long")).drop("_form")


def section_of(rows: DataFrame, is_heading: Column, within: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``section_no``: headings met so far (0 before the first)."""
    along = W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("section_no", F.sum(is_heading.cast("long")).over(along))


def islands(rows: DataFrame, flag: Column, within: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``island``: consecutive rows for which ``flag`` holds share a number, from 1; null elsewhere."""
    along = W.partitionBy(*within).orderBy(*order)
    begins = flag & ~F.coalesce(F.lag(flag).over(along), F.lit(False))
    return rows.withColumn("_in", flag).withColumn("_start", begins.cast("long")).withColumn("island", F.when(F.col("_in"), F.sum("_start").over(along.rowsBetween(W.unboundedPreceding, 0)))).drop("_in", "_start")


def unit_ids(rows: DataFrame, within: Sequence[str], section: str, order: Sequence[str]) -> DataFrame:
    """Adds section_id 'SRC-S01', unit_id 'SRC-S01-U001' (numbered per section) and seq_no (per document)."""
    at = W.partitionBy(*within, section).orderBy(*order)
    name = F.concat(F.lit("SRC-S"), F.lpad(F.col(section).cast("string"), 2, "0"))
    n = F.row_number().over(at)
    out = rows.withColumn("section_id", name).withColumn("unit_id", F.concat("section_id", F.lit("-U"), F.lpad(n.cast("string"), 3, "0")))
    return out.withColumn("seq_no", F.row_number().over(W.partitionBy(*within).orderBy(*order)).cast("long"))


def merge_continuations(rows: DataFrame, starts: Column, within: Sequence[str], order: Sequence[str], text: str = "text", sep: str = " ") -> DataFrame:
    """Joins each row for which ``starts`` is false to the one before: within, part (from 1), n_parts, text."""
    along = W.partitionBy(*within).orderBy(*order)
    first = F.row_number().over(along) == 1
    marked = rows.withColumn("part", F.sum((starts | first).cast("long")).over(along.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda s: s["_t"])
    return marked.groupBy(*within, "part").agg(F.count("*").alias("n_parts"), F.array_join(parts, sep).alias("text"))


def intro_inheritance(rows: DataFrame, is_item: Column, is_intro: Column, value: str, within: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``inherited``: for an item, the value of the intro line right before its run of items."""
    along = W.partitionBy(*within).orderBy(*order)
    run = F.sum((~is_item).cast("long")).over(along.rowsBetween(W.unboundedPreceding, 0))
    out = rows.withColumn("_item", is_item).withColumn("_intro", is_intro).withColumn("_run", run)
    lead = F.first(F.when(~F.col("_item") & F.col("_intro"), F.col(value))).over(W.partitionBy(*within, "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("inherited", F.when(F.col("_item"), lead)).drop("_item", "_intro", "_run")


def order_violations(rows: DataFrame, within: Sequence[str], order: Sequence[str], position: str) -> DataFrame:
    """Rows whose position lies before the largest one so far: with ``after``, that largest position."""
    before = W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("after", F.max(position).over(before)).where(F.col(position) < F.col("after"))


def running_texts(rows: DataFrame, page: str, form: Column, n_pages: DataFrame | None, within: Sequence[str], least: Column) -> DataFrame:
    """Texts (in the given form) on at least ``least`` different pages: within, form, pages."""
    return rows.withColumn("form", form).groupBy(*within, "form").agg(F.count_distinct(page).alias("pages")).where(F.col("pages") >= least)


def word_recall(source: DataFrame, target: DataFrame, key: str, words: str = "words") -> DataFrame:
    """Per key: distinct source words, how many the target has, recall, and the first missing ones in order."""
    s = source.select(key, F.explode(F.array_distinct(words)).alias("w"))
    t = target.select(key, F.explode(F.array_distinct(words)).alias("w"), F.lit(True).alias("_hit"))
    met = s.join(t.distinct(), [key, "w"], "left")
    lost = F.array_sort(F.collect_list(F.when(F.col("_hit").isNull(), F.col("w"))))
    out = met.groupBy(key).agg(F.count("*").alias("n_words"), F.count("_hit").alias("n_found"), lost.alias("_lost"))
    return out.select(key, "n_words", "n_found", (F.col("n_found") / F.col("n_words")).alias("recall"), F.array_join(F.slice("_lost", 1, 8), " ").alias("missing"))

"""Checks and pipelines made of the other operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as t
from . import chunks


def placeholder_issues(pairs: DataFrame, pattern: str, source: str = "source_text", target: str = "target_text") -> DataFrame:
    """Targets with a placeholder left in: medium if the source has one too, else high."""
    return pairs.where(F.coalesce(target, F.lit("")).rlike(pattern)).withColumn("severity", F.when(F.col(source).rlike(pattern), "medium").otherwise("high"))


def protected_units(rows: DataFrame) -> DataFrame:
    """Units that must survive: inside a section, with text, neither title nor bare number."""
    return rows.where((F.col("section_no") > 0) & (F.col("text") != "") & (F.col("kind") != "title") & ~F.col("text").rlike("^[0-9]+$"))


#: Rule kinds that can be checked by machine, and what makes a rule's value wrong: (problem, condition over value and cited).
CHECKS = {
    "max_words": (("not a number", lambda v, c: v.try_cast("int").isNull()), ("out of range", lambda v, c: v.try_cast("int") < 5)),
    "forbidden": (("not grounded", lambda v, c: ~F.contains(c, v)),),
    "color": (("not grounded", lambda v, c: ~F.contains(c, v)),),
}


def params_problems(rules: DataFrame) -> DataFrame:
    """Rules (kind, value, cited) whose kind is unknown or whose value breaks one of its kind's checks, with the first problem."""
    problem = F.when(~F.col("kind").isin(*CHECKS), "unknown kind")
    for kind, checks in CHECKS.items():
        for name, broken in checks:
            problem = problem.when((F.col("kind") == kind) & broken(F.col("value"), F.col("cited")), name)
    return rules.withColumn("problem", problem).where("problem is not null")


def kept_fills(cells: DataFrame, within: Sequence[str], fill: str, header: Column) -> DataFrame:
    """Cell fills that mean something: no greys (equal parts from A0 on), no headers, none of a table that is grey throughout."""
    part = lambda k: F.substring(fill, k, 2)
    grey = (part(1) == part(3)) & (part(3) == part(5)) & (part(1) >= "A0")
    rows = cells.withColumn("_grey", grey)
    all_grey = F.min("_grey").over(W.partitionBy(*within))
    return rows.withColumn(fill, F.when(~(F.col("_grey") | header | all_grey), F.col(fill))).drop("_grey")


def label_profile(units: DataFrame, section: str, labels: str) -> DataFrame:
    """Mean weight of each label over the units of a section: section, label, weight."""
    n = units.groupBy(section).agg(F.count("*").alias("_n"))
    rows = units.select(section, F.explode(labels).alias("label", "w")).groupBy(section, "label").agg(F.sum("w").alias("w"))
    return rows.join(n, section).select(section, "label", (F.col("w") / F.col("_n")).alias("weight"))


def raci_share(cells: DataFrame, within: Sequence[str]) -> DataFrame:
    """Share of cells, the first column aside, that are R, A, C, I or X."""
    return cells.where("col > 1").groupBy(*within).agg(F.avg(F.col("text").rlike("^[RACIX]$").cast("int")).alias("share"), F.count("*").alias("n"))


def readiness(templates: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """Per template: anchors, blocking and warning ones, and a status; a template without anchors is blocked."""
    counts = templates.join(anchors, key, "left").groupBy(key).agg(F.count("state").alias("n_anchors"), F.count_if(F.col("state") == "blocking").alias("n_blocking"), F.count_if(F.col("state") == "warning").alias("n_warn"))
    return counts.withColumn("status", F.when((F.col("n_anchors") == 0) | (F.col("n_blocking") > 0), "blocked").when(F.col("n_warn") > 0, "warning").otherwise("ready"))


def blockers(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Adds ``blockers``: the names of the conditions that hold, joined."""
    return rows.withColumn("blockers", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()])), "; "))


def attach(rows: DataFrame, wants: Column, owns: Column, within: Sequence[str], order: str) -> DataFrame:
    """Rows that want an owner with the owning row right before, else right after; rows without one are left out."""
    along = W.partitionBy(*within).orderBy(order)
    marked = rows.withColumn("_own", owns).withColumn("_want", wants)
    before, after = F.lag(F.when(F.col("_own"), F.col(order))).over(along), F.lead(F.when(F.col("_own"), F.col(order))).over(along)
    return marked.withColumn("owner", F.coalesce(before, after)).where(F.col("_want") & F.col("owner").isNotNull()).drop("_own", "_want")


def continuation_rows(rows: DataFrame, within: Sequence[str], order: str, first: str, body: str) -> DataFrame:
    """Rows with an empty first cell join the row before: within, part, row, n_rows, body."""
    along = W.partitionBy(*within).orderBy(order)
    begins = (F.coalesce(F.col(first), F.lit("")) != "") | (F.row_number().over(along) == 1)
    parts = rows.withColumn("part", F.sum(begins.cast("long")).over(along.rowsBetween(W.unboundedPreceding, 0)))
    text = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(body).alias("b")))), lambda s: s["b"])
    return parts.groupBy(*within, "part").agg(F.min(order).alias(order), F.count("*").alias("n_rows"), F.array_join(text, " ").alias(body))


def section_chunks(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """One chunk per section: its units in order, list items marked; type list, mixed or text."""
    line = F.when(F.col("kind") == "list_item", F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))), lambda s: s["l"])
    item = F.col("kind") == "list_item"
    kind = F.when(F.bool_and(item | (F.col("kind") == "heading")), "list").when(F.bool_or(item), "mixed").otherwise("text")
    return rows.groupBy(*by).agg(F.array_join(lines, "\n").alias("content"), F.count("*").alias("n_units"), kind.alias("chunk_type"))


def xref_phrases(c: Column) -> Column:
    return t.extract(c, r"(?i)\b(?:section|step|figure|appendix|item)\s+[0-9]+(?:\.[0-9]+)*")


def json_detail(events: DataFrame, key: str, detail: str) -> DataFrame:
    """The first key's value of a JSON object as text, and the number of keys."""
    keys = F.json_object_keys(detail)
    values = F.from_json(detail, "map<string,string>")
    return events.select(key, F.element_at(values, F.element_at(keys, 1)).alias("first_value"), F.size(keys).alias("n_keys"))


def first_match(cases: Sequence[tuple[Column, str]], default: str) -> Column:
    out = F.lit(default)
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def verdicts(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """A row per check: key, check_name, verdict."""
    return rows.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), c.alias("verdict")) for n, c in checks.items()])).alias("c")).select(key, "c.check_name", "c.verdict")


def build_rules(candidates: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Equal candidates (category, text) become one rule with the strongest severity, numbered by their first id (counted from blocks of ``block`` ids)."""
    merged = candidates.groupBy("category", "text").agg(F.min("id").alias("first_id"), F.max("severity").alias("severity"), F.count("*").alias("n"))
    merged = chunks.numbered(merged, [], [F.floor(F.col("first_id") / block)], ["first_id"], "_number")
    number = F.col("_number")
    return merged.select("category", "text", "severity", "n", F.concat(F.lit("R-"), F.lpad(number.cast("string"), 5, "0")).alias("rule_id"))


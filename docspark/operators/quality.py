"""Issues: counts, gates, status, order, union, carried resolutions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SEVERITIES = ("info", "low", "medium", "high", "critical")
GATES = ("coverage", "numerical_change", "modality_change", "role_change", "unsupported_content", "structure", "cross_reference", "order")


def rank(severity: Column) -> Column:
    out = F.lit(-1)
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def gate_counts(spark: SparkSession, issues: DataFrame) -> DataFrame:
    """Open issues per gate, gates without any included."""
    gates = spark.createDataFrame([(g,) for g in GATES], "gate string")
    counts = issues.where(~F.col("resolved") & F.col("gate").isNotNull()).groupBy("gate").agg(F.count("*").alias("n"))
    return F.broadcast(gates).join(counts, "gate", "left").select("gate", F.coalesce("n", F.lit(0)).alias("n"))


def issue_summary(issues: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per job: open, open per severity, open with a gate, and whether it passed (no open gate, high or critical issue)."""
    is_open = ~F.col("resolved")
    per = [F.count_if(is_open & (F.col("severity") == s)).alias(f"n_{s}") for s in SEVERITIES]
    out = issues.groupBy(*by).agg(F.count_if(is_open).alias("n_open"), *per, F.count_if(is_open & F.col("gate").isNotNull()).alias("n_gate"))
    return out.withColumn("passed", (F.col("n_gate") == 0) & (F.col("n_high") == 0) & (F.col("n_critical") == 0))


def final_status(issues: DataFrame, by: Sequence[str]) -> DataFrame:
    """HUMAN_REVIEW for an open gate, high or critical issue; else COMPLETED_WITH_WARNINGS for a medium one; else COMPLETED."""
    is_open = ~F.col("resolved")
    worst = F.max(F.when(is_open, F.when(F.col("gate").isNotNull(), 4).otherwise(rank(F.col("severity")))))
    out = issues.groupBy(*by).agg(worst.alias("_w"))
    return out.select(*by, F.when(F.col("_w") >= 3, "HUMAN_REVIEW").when(F.col("_w") == 2, "COMPLETED_WITH_WARNINGS").otherwise("COMPLETED").alias("status"))


def issue_cube(issues: DataFrame) -> DataFrame:
    """Open issues by gate, by severity, by section and in total, in one pass: dim, value, n."""
    rows = issues.where(~F.col("resolved"))
    sets = F.explode(F.array(
        F.struct(F.lit("gate").alias("dim"), F.coalesce("gate", F.lit("none")).alias("value")), F.struct(F.lit("severity").alias("dim"), F.col("severity").alias("value")),
        F.struct(F.lit("section").alias("dim"), F.col("section_id").cast("string").alias("value")), F.struct(F.lit("total").alias("dim"), F.lit("all").alias("value")),
    ))
    return rows.select(sets.alias("s")).groupBy("s.dim", "s.value").agg(F.count("*").alias("n"))


def sort_order() -> list[Column]:
    """Open before resolved, gates first, worst severity first, then section and id."""
    return [F.col("resolved").asc(), F.col("gate").isNull().asc(), rank(F.col("severity")).desc(), F.col("section_id").asc(), F.col("issue_id").asc()]


def carry_resolutions(issues: DataFrame, previous: DataFrame, edited: DataFrame | None = None) -> DataFrame:
    """An open issue is resolved if the issue of the same id was; issues of edited sections lose it."""
    was = previous.where("resolved").select("issue_id", F.lit(True).alias("_was")).distinct()
    out = issues.join(was, "issue_id", "left")
    if edited is not None:
        out = out.join(edited.select("section_id", F.lit(True).alias("_edited")).distinct(), "section_id", "left")
    else:
        out = out.withColumn("_edited", F.lit(None).cast("boolean"))
    return out.withColumn("resolved", (F.col("resolved") | F.coalesce("_was", F.lit(False))) & F.col("_edited").isNull()).drop("_was", "_edited")


def union_issues(checks: Sequence[DataFrame]) -> DataFrame:
    """All checks' issues; of one id the last check's stays."""
    tagged = [c.withColumn("_check", F.lit(i)) for i, c in enumerate(checks)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    others = [c for c in checks[0].columns if c != "issue_id"]
    return out.groupBy("issue_id").agg(F.max_by(F.struct(*others), "_check").alias("_l")).select("issue_id", *[F.col(f"_l.{c}").alias(c) for c in others])


def capped(rows: DataFrame, within: str, order: Sequence[Column | str], per_group: int, overall: int) -> DataFrame:
    """The first ``per_group`` rows of each group and of those the first ``overall`` in order (a bounded top-k)."""
    few = rows.withColumn("_n", F.row_number().over(W.partitionBy(within).orderBy(*order))).where(F.col("_n") <= per_group).drop("_n")
    return few.orderBy(within, *order).limit(overall)


def listed(ids: Column, show: int) -> Column:
    """The first ``show`` of an array of ids, and how many more there are."""
    more = F.size(ids) - show
    head = F.array_join(F.slice(ids, 1, show), ", ")
    return F.when(more > 0, F.concat(head, F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(head)


def budget_prefix(rows: DataFrame, within: Sequence[str], order: Sequence[str], cost: Column, budget: int) -> DataFrame:
    """The longest prefix whose summed cost stays within the budget; costs are positive, so the running sum decides."""
    along = W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(along)).where(F.col("used") <= budget)


def expectations(rules: dict[str, tuple[DataFrame, Column, str]]) -> DataFrame:
    """Violations as rows (rule, key): for each rule the rows for which its condition holds."""
    out = None
    for rule, (df, broken, key) in rules.items():
        part = df.where(broken).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out

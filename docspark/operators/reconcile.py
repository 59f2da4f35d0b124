"""Changes between a source and what was made of it: values, obligations, claims; references, alignments, placements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def value_diff(source: DataFrame, claims: DataFrame, unit: str) -> DataFrame:
    """Per unit the values (kind, normalized) that its claims lost, those they added, and pairs of both that are one change.

    Both frames: unit, kind, normalized, pos.  The k-th lost and the k-th added value of one unit and kind, by position, are a change.
    """
    keys = [unit, "kind", "normalized"]
    first = lambda df: df.groupBy(*keys).agg(F.min("pos").alias("pos"))
    s, c = first(source), first(claims)
    lost, added = s.join(c.select(*keys), keys, "left_anti"), c.join(s.select(*keys), keys, "left_anti")
    rank = F.row_number().over(W.partitionBy(unit, "kind").orderBy("pos", "normalized"))
    lost = lost.select(unit, "kind", F.col("normalized").alias("lost"), rank.alias("k"))
    added = added.select(unit, "kind", F.col("normalized").alias("added"), rank.alias("k"))
    both = lost.join(added, [unit, "kind", "k"], "full_outer")
    change = F.when(F.col("lost").isNull(), "added").when(F.col("added").isNull(), "missing").otherwise("changed")
    return both.select(unit, "kind", change.alias("change"), "lost", "added")


def modality_diff(pairs: DataFrame, source: str, claim: str) -> DataFrame:
    """Adds lost and added obligation strengths (joined) and a severity: plain to mandatory is medium, all else high, none null."""
    lost, added = F.array_except(source, claim), F.array_except(claim, source)
    out = pairs.withColumn("_l", lost).withColumn("_a", added)
    mild = (F.size(source) == 0) & (F.array_join("_a", ",") == "mandatory")
    severity = F.when((F.size("_l") == 0) & (F.size("_a") == 0), None).when(mild, "medium").otherwise("high")
    return out.withColumn("lost", F.array_join("_l", ",")).withColumn("added", F.array_join("_a", ",")).withColumn("severity", severity).drop("_l", "_a")


def carry_findings(findings: DataFrame, old: DataFrame, new: DataFrame, signature: Sequence[str]) -> DataFrame:
    """Findings of claims (claim_id) follow to the new claim of the same signature; those of changed claims go."""
    o = old.select(F.col("claim_id").alias("_old"), *[F.col(c).alias(f"_s{k}") for k, c in enumerate(signature)])
    n = new.select(F.col("claim_id").alias("new_claim_id"), *[F.col(c).alias(f"_s{k}") for k, c in enumerate(signature)])
    moved = o.join(n, [f"_s{k}" for k in range(len(signature))]).select("_old", "new_claim_id").distinct()
    return findings.join(moved, findings["claim_id"] == F.col("_old")).drop("_old")


def resolve_in_order(refs: DataFrame, key: str, lookups: Sequence[tuple[str, DataFrame, Column]]) -> DataFrame:
    """Adds target and resolution of references by keyed look-ups tried in order.

    Each look-up is (name, frame with a unique column ``k`` and ``target``, the reference's key column); a null key never matches.
    """
    out = refs
    for i, (_, frame, c) in enumerate(lookups):
        out = out.withColumn(f"_k{i}", c).join(frame.select(F.col("k").alias(f"_k{i}"), F.col("target").alias(f"_t{i}")), f"_k{i}", "left")
    target = F.coalesce(*[F.col(f"_t{i}") for i in range(len(lookups))])
    how = F.lit("unresolved")
    for i, (name, _, _) in reversed(list(enumerate(lookups))):
        how = F.when(F.col(f"_t{i}").isNotNull(), name).otherwise(how)
    return out.select(*refs.columns, target.alias("target"), how.alias("resolution"))


def stitched_runs(tables: DataFrame, within: Sequence[str], order: Sequence[str], joins: Column) -> DataFrame:
    """Adds ``run``: tables that join the one before (a condition over lag-able columns, given as a column) share a run."""
    along = W.partitionBy(*within).orderBy(*order)
    return tables.withColumn("_j", F.coalesce(joins, F.lit(False))).withColumn("run", F.sum((~F.col("_j")).cast("long")).over(along.rowsBetween(W.unboundedPreceding, 0))).drop("_j")


def align_by_rank(left: DataFrame, right: DataFrame, within: Sequence[str], left_key: str, right_key: str) -> DataFrame:
    """The k-th left row goes with the k-th right row of a group, only where both sides have equally many."""
    def ranked(df: DataFrame, key: str) -> DataFrame:
        return df.select(*within, F.col(key), F.row_number().over(W.partitionBy(*within).orderBy(key)).alias("_k"), F.count("*").over(W.partitionBy(*within)).alias("_n"))

    return ranked(left, left_key).join(ranked(right, right_key), [*within, "_k", "_n"]).select(*within, left_key, right_key)


def golden_compare(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Expected against actual placements: key, expected, actual, verdict (ok, wrong, missing, unexpected)."""
    e, a = expected.select(key, F.col(value).alias("expected")), actual.select(key, F.col(value).alias("actual"))
    verdict = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("expected") == F.col("actual"), "ok").otherwise("wrong")
    return e.join(a, key, "full_outer").withColumn("verdict", verdict)


def trace(claims: DataFrame, bridge: DataFrame, units: DataFrame, claim: str, unit: str) -> DataFrame:
    """A row per claim and cited unit; claims without units stay with nulls."""
    return claims.join(bridge, claim, "left").join(units, unit, "left")


def affected(issues: DataFrame, by: Sequence[str], reason: str) -> DataFrame:
    """What to redo: a row per place with its distinct reasons, sorted and joined."""
    return issues.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(reason)), "; ").alias("reasons"), F.count("*").alias("n"))


def complete_placements(elements: DataFrame, explicit: DataFrame, key: str, order: str) -> DataFrame:
    """Every element is placed: explicit positions win, the rest follow in source order; placements without element stay, marked."""
    e, x = elements.select(key, F.col(order).alias("_s")), explicit.select(key, F.col("place").alias("_p"))
    both = e.join(x, key, "full_outer")
    return both.select(key, F.coalesce("_p", F.col("_s") + 1_000_000).alias("place"), F.col("_p").isNotNull().alias("explicit"), F.col("_s").isNull().alias("orphan"))


def fill_from_neighbours(cells: DataFrame, within: Sequence[str], row: str, col: str, value: str) -> DataFrame:
    """Adds ``filled``: an empty cell continues its left neighbour, else the one above."""
    empty = F.coalesce(F.col(value), F.lit("")) == ""
    left = F.last(F.when(~empty, F.col(value)), ignorenulls=True).over(W.partitionBy(*within, row).orderBy(col).rowsBetween(W.unboundedPreceding, -1))
    up = F.last(F.when(~empty, F.col(value)), ignorenulls=True).over(W.partitionBy(*within, col).orderBy(row).rowsBetween(W.unboundedPreceding, -1))
    return cells.withColumn("_left", left).withColumn("_up", up).withColumn("filled", F.when(empty, F.coalesce("_left", "_up")).otherwise(F.col(value))).drop("_left", "_up")


def spread(extra: DataFrame, free: DataFrame, within: Sequence[str], extra_key: str, free_key: str) -> DataFrame:
    """The k-th extra item goes to the k-th free place of its group, as far as there are places."""
    k = lambda key: F.row_number().over(W.partitionBy(*within).orderBy(key))
    return extra.select(*within, extra_key, k(extra_key).alias("_k")).join(free.select(*within, free_key, k(free_key).alias("_k")), [*within, "_k"]).drop("_k")


def linked_pairs(a: DataFrame, b: DataFrame, left: str, right: str, value: str, block: int = 2000) -> DataFrame:
    """Pairs of keys of a and b that have a value in common, each once: left, right.  Null values link nothing, null keys are keys.

    A pair is made at the first value that both have, so pairs need no shuffle; a key with one value has no other.  A value of many keys in b is met in parts of about ``block`` keys by as many tasks.
    """
    whole = lambda df, key, to: df.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(to))
    x = whole(a, left, "_va").select(left, "_va", F.explode("_va").alias(value))
    y = whole(b, right, "_vb").select(right, "_vb", F.explode("_vb").alias(value))
    parts = y.groupBy(value).agg(F.ceil(F.count("*") / block).cast("int").alias("_parts"))
    x = x.join(parts, value).select(left, value, F.when(F.size("_va") > 1, F.col("_va")).alias("_va"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    y = y.join(parts, value).select(right, value, F.when(F.size("_vb") > 1, F.col("_vb")).alias("_vb"), F.pmod(F.xxhash64(right), F.col("_parts")).cast("int").alias("_part"))
    first = F.col("_va").isNull() | F.col("_vb").isNull() | (F.element_at(F.array_intersect("_va", "_vb"), 1) == F.col(value))
    return x.join(y, [value, "_part"]).where(first).select(left, right)

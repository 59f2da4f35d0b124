"""Checks of target texts against their sources, as one pass over the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

TAG = r"⟦/?[0-9]+⟧"


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG, "")


def tag_diff(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Adds missing and extra (markers of one side only, as often as they are more there, sorted), broken (crossing, unbalanced or null) and pair (the number of the broken pair).

    A marker is a closing one, an opening one if its text has the closing one too, or an object.  Pairs of the target are read from left to right with a stack of open ones: the first closing marker that
    isn't of the innermost open pair breaks them, crossing if its pair is open further out, unbalanced if it isn't open at all.  Null texts have no markers.
    """

    def markers(c: Column) -> Column:
        found = t.extract(F.coalesce(c, F.lit("")), TAG)

        def kinds(tags: Column) -> Column:
            number = lambda x: F.regexp_extract(x, "[0-9]+", 0).cast("long")
            return F.transform(tags, lambda x: F.struct(F.when(F.contains(x, F.lit("/")), "close").when(F.exists(tags, lambda y: F.contains(y, F.lit("/")) & (number(y) == number(x))), "open").otherwise("object").alias("kind"), number(x).alias("k")))

        return F.element_at(F.transform(F.array(found), kinds), 1)

    def less(a: Column, b: Column) -> Column:
        """Markers that a has more often than b."""
        more = lambda x: F.size(F.filter(a, lambda y: y == x)) - F.size(F.filter(b, lambda y: y == x))
        shown = lambda x: F.concat(F.lit("⟦"), F.when(x["kind"] == "close", "/").otherwise(""), x["k"].cast("string"), F.lit("⟧"))
        return F.flatten(F.transform(F.array_sort(F.array_distinct(a)), lambda x: F.array_repeat(shown(x), F.greatest(more(x), F.lit(0)))))

    def read(acc: Column, x: Column) -> Column:
        top = F.get(acc["open"], F.lit(0))
        opened = F.struct(F.concat(F.array(x["k"]), acc["open"]).alias("open"), acc["broken"].alias("broken"), acc["pair"].alias("pair"))
        closed = F.struct(F.slice(acc["open"], 2, F.greatest(F.size(acc["open"]), F.lit(1))).alias("open"), acc["broken"].alias("broken"), acc["pair"].alias("pair"))
        failed = F.struct(acc["open"].alias("open"), F.when(F.array_contains(acc["open"], x["k"]), "crossing").otherwise("unbalanced").alias("broken"), x["k"].alias("pair"))
        return F.when(acc["broken"].isNotNull() | (x["kind"] == "object"), acc).when(x["kind"] == "open", opened).when(F.coalesce(top == x["k"], F.lit(False)), closed).otherwise(failed)

    start = F.struct(F.array().cast("array<bigint>").alias("open"), F.lit(None).cast("string").alias("broken"), F.lit(None).cast("long").alias("pair"))
    out = rows.withColumns({"_s": markers(F.col(source)), "_t": markers(F.col(target))})
    out = out.withColumns({"missing": less(F.col("_s"), F.col("_t")), "extra": less(F.col("_t"), F.col("_s")), "_r": F.aggregate("_t", start, read)})
    return out.withColumns({"broken": F.col("_r.broken"), "pair": F.col("_r.pair")}).drop("_s", "_t", "_r")


def checks(source: Column, target: Column, low: float = 0.5, high: float = 2.0, min_chars: int = 20) -> dict[str, tuple[str, Column]]:
    """Per check its severity and the condition under which a pair has the issue; a missing target has EMPTY only."""
    s, g = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    empty = F.trim(strip_tags(g)) == ""
    want, got = t.neutral_numbers(s), t.neutral_numbers(g)
    size_s, size_g = F.char_length(F.trim(strip_tags(s))), F.char_length(F.trim(strip_tags(g)))
    count = lambda c, x: F.char_length(c) - F.char_length(F.translate(c, x, ""))
    same = lambda p: F.array_sort(t.extract(s, p)) == F.array_sort(t.extract(g, p))
    refs = lambda c: F.array_distinct(t.emails_urls(c))
    ratio = size_g / size_s
    out = {
        "REF_TOKENS": ("critical", ~same(t.REF_TOKEN)), "TAGS": ("critical", ~same(TAG)), "CELLS": ("critical", (count(s, "|") > 0) & (count(s, "|") != count(g, "|"))),
        "REFERENCES": ("critical", F.size(F.array_except(refs(s), refs(g))) > 0), "NUMBERS": ("critical", F.size(t.multiset_minus(want, got)) > 0),
        "NUMBERS_ADDED": ("low", F.size(t.multiset_minus(got, want)) > 0), "UNTRANSLATED": ("medium", (F.trim(s) == F.trim(g)) & s.rlike(r"\p{Ll}")),
        "LINE_BREAKS": ("medium", count(s, "\n") != count(g, "\n")), "LENGTH": ("low", (size_s >= min_chars) & ((ratio < low) | (ratio > high))),
    }
    return {"EMPTY": ("critical", empty)} | {k: (v, ~empty & c) for k, (v, c) in out.items()}


def check_segments(segments: DataFrame, **bounds) -> DataFrame:
    """A row per issue: the pair's other columns, code, severity.  Every check is an expression over the pair; no join, no shuffle."""
    keep = [c for c in segments.columns if c not in ("source_text", "target_text")]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("code"), F.lit(v).alias("severity"))) for k, (v, c) in checks(F.col("source_text"), F.col("target_text"), **bounds).items()]))
    return segments.select(*keep, F.explode(found).alias("i")).select(*keep, "i.code", "i.severity")


def distinct_groups(segments: DataFrame, key: list[str], text: str = "source_text") -> DataFrame:
    """Equal source texts as one group: each segment with the group's first key and its size.  The text itself is shuffled as a hash."""
    rows = segments.select(*key, F.sha2(text, 256).alias("_h"))
    groups = rows.groupBy("_h").agg(F.min(F.struct(*key)).alias("first"), F.count("*").alias("group_size"))
    return rows.join(groups, "_h").select(*key, *[F.col(f"first.{k}").alias(f"first_{k}") for k in key], "group_size")


def bow_cosine(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """Cosine of the term counts of two texts of one row, inside the row."""
    wa, wb = t.tokens(F.col(a)), t.tokens(F.col(b))
    counted = pairs.select(*key, wa.alias("_a"), wb.alias("_b"))
    n = lambda arr, v: F.size(F.filter(arr, lambda x: x == v))
    squares = lambda c: F.aggregate(F.array_distinct(c), F.lit(0).cast("long"), lambda acc, v: acc + n(F.col(c), v) * n(F.col(c), v))
    dot = F.aggregate(F.array_intersect("_a", "_b"), F.lit(0).cast("long"), lambda acc, v: acc + n(F.col("_a"), v) * n(F.col("_b"), v))
    return counted.select(*key, dot.alias("dot"), squares("_a").alias("na"), squares("_b").alias("nb")).select(
        *key, F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("dot") / F.sqrt(F.col("na") * F.col("nb"))).otherwise(0.0).alias("cosine")
    )

"""Sections and chunks: parents, numbers, similarity of neighbours, packing, interval selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import folds


def section_parent(headings: DataFrame, within: Sequence[str], order: str, level: str, most_level: int) -> DataFrame:
    """Adds ``parent``: the nearest heading before with a lower level (null at the top)."""
    before = W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = headings
    for k in range(1, most_level):
        out = out.withColumn(f"_l{k}", F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(before))
    parent = F.lit(None).cast("long")
    for k in range(2, most_level + 1):
        lower = [F.col(f"_l{j}") for j in range(1, k)]
        parent = F.when(F.col(level) == k, F.greatest(*lower) if len(lower) > 1 else lower[0]).otherwise(parent)
    return out.withColumn("parent", parent).drop(*[f"_l{k}" for k in range(1, most_level)])


def hierarchical_numbers(headings: DataFrame, within: Sequence[str], order: str, level: str, most_level: int) -> DataFrame:
    """Adds ``number`` ('2.1.3'): a level counts on until a lower level comes; a level that was skipped counts from 1."""
    along = W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = headings
    for k in range(1, most_level + 1):
        out = out.withColumn(f"_z{k}", F.sum((F.col(level) < k).cast("int")).over(along))
    for k in range(1, most_level + 1):
        scope = W.partitionBy(*within, f"_z{k}").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumn(f"_c{k}", F.greatest(F.lit(1), F.sum((F.col(level) == k).cast("int")).over(scope)))
    number = F.array_join(F.slice(F.array(*[F.col(f"_c{k}") for k in range(1, most_level + 1)]), 1, F.col(level)), ".")
    return out.select(*within, order, level, number.alias("number"))


def tfidf_adjacent(units: DataFrame, doc: str, order: str, text: str = "text") -> DataFrame:
    """TF-IDF cosine of each unit with the next of its document: doc, order, cosine (idf within the document, smoothed, L2).

    Texts are shuffled once, by document.  A word's units in a document follow each other in one window, which says in how many units it is and which of them are neighbours, so words are
    neither joined nor shuffled.
    """
    along = W.partitionBy(doc).orderBy(order)
    rows = units.select(doc, order, text).repartition(doc)
    rows = rows.select(doc, order, F.lead(order).over(along).alias("_next"), F.count("*").over(W.partitionBy(doc)).alias("_n"), text)
    words = rows.select(doc, order, "_next", "_n", F.explode_outer(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("w"))
    tf = words.groupBy(doc, order, "_next", "_n", "w").agg(F.count("*").alias("tf"))
    # A unit without words has one row, whose word is null and weighs nothing.
    value = F.when(F.col("w").isNull(), F.lit(0.0)).otherwise(F.col("tf") * (F.log((1 + F.col("_n")) / (1 + F.count("*").over(W.partitionBy(doc, "w")))) + 1))
    same = W.partitionBy(doc, "w").orderBy(order)
    x = tf.withColumn("v", value).withColumn("v2", F.when(F.lead(order).over(same) == F.col("_next"), F.lead("v").over(same)))
    sums = x.groupBy(doc, order, "_next").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.coalesce(F.sum(F.col("v") * F.col("v2")), F.lit(0.0)).alias("dot"))
    pairs = sums.withColumn("norm2", F.lead("norm").over(along)).where("_next is not null")
    return pairs.select(doc, order, F.coalesce(F.try_divide(F.col("dot"), F.col("norm") * F.col("norm2")), F.lit(0.0)).alias("cosine"))


def pack_blocks(rows: DataFrame, within: Sequence[str], order: str, cost: str, budget: int) -> DataFrame:
    """Ordered packing: a row opens a new block if the open one would exceed the budget.  Adds block (from 1).

    The fold runs over the costs of one document's rows, so its memory is bounded by a document, never by the corpus, and its work grows with the rows.
    """
    kind = rows.schema[order].dataType.simpleString()

    def step(s, x):
        opens = (s["used"] > 0) & (s["used"] + x["c"] > budget)
        return F.struct((s["block"] + F.when(opens, 1).otherwise(0)).alias("block"), F.when(opens, x["c"]).otherwise(s["used"] + x["c"]).alias("used"))

    items = F.array_sort(F.collect_list(F.struct(order, F.col(cost).cast("long").alias("c"))))
    start = F.struct(F.lit(1).alias("block"), F.lit(0).cast("long").alias("used"))
    placed = folds.scan(F.col("_i"), start, step, lambda s, x: F.struct(x[order].alias("o"), s["block"].alias("block")), f"struct<o:{kind},block:int>")
    return rows.groupBy(*within).agg(items.alias("_i")).select(*within, F.explode(placed).alias("x")).select(*within, F.col("x.o").alias(order), F.col("x.block").alias("block"))


def non_overlapping(rows: DataFrame, within: Sequence[str]) -> DataFrame:
    """Greedy choice of intervals (start, end) of each text: by start, then longest; one that begins before the last chosen end is left out."""
    items = F.array_sort(F.collect_set(F.struct("start", (-F.col("end")).alias("minus"))))

    def step(s, x):
        taken = x["start"] >= s["last"]
        return F.struct(F.when(taken, -x["minus"]).otherwise(s["last"]).cast("int").alias("last"), taken.alias("taken"))

    start = F.struct(F.lit(-(2**31) + 1).alias("last"), F.lit(False).alias("taken"))
    chosen = folds.scan(F.col("_i"), start, step, lambda s, x: F.struct(s["taken"].alias("taken"), x["start"].cast("int").alias("start"), (-x["minus"]).cast("int").alias("end")), "struct<taken:boolean,start:int,end:int>")
    return rows.groupBy(*within).agg(items.alias("_i")).select(*within, F.explode(chosen).alias("x")).where("x.taken").select(*within, "x.start", "x.end")


# What closes a sentence, what a continued paragraph may open with, and marks of things that stay with their text.
TERMINAL, CLOSING, MARKS = tuple(".!?:"), tuple(")]}»"), ("[Icon:", "[Image:", "[Table:")


def merge_paragraphs(rows: DataFrame, within: Sequence[str], order: str, text: str = "text") -> DataFrame:
    """Paragraphs that layout tore apart put together again: within, first (the order of the first), n, text (joined by a blank).

    A paragraph goes on the one before, as merged so far, if either begins with the mark of an icon, image or table; if brackets opened in the merged text are still open; if it ends with
    a hyphen; or if it ends without ``TERMINAL`` and the next begins in lower case or with a closing bracket.  Null and empty paragraphs go on nothing and nothing goes on them.

    The fold's state is the number of the merged paragraph, its open brackets, whether it began with a mark and how it ends; texts are joined afterwards, so no merged text is carried along.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    count = lambda signs: F.char_length(c) - F.char_length(F.translate(c, signs, ""))
    marked = F.lit(False)
    for mark in MARKS:
        marked |= F.startswith(F.ltrim(c), F.lit(mark))
    first, last = F.left(c, F.lit(1)), F.right(c, F.lit(1))
    item = F.struct(F.col(order).alias("o"), (c == "").alias("empty"), (count("([{") - count(")]}")).alias("open"), marked.alias("mark"), (last == "-").alias("hyphen"), last.isin(*TERMINAL).alias("ends"), (first.rlike(r"^\p{Ll}") | first.isin(*CLOSING)).alias("goes_on"))

    def step(s, x):
        joins = (s["grp"] > 0) & ~s["empty"] & ~x["empty"] & (x["mark"] | s["mark"] | (s["open"] > 0) | s["hyphen"] | (~s["ends"] & x["goes_on"]))
        return F.struct(
            (s["grp"] + F.when(joins, 0).otherwise(1)).alias("grp"), (x["open"] + F.when(joins, s["open"]).otherwise(0)).alias("open"), F.when(joins, s["mark"]).otherwise(x["mark"]).alias("mark"),
            x["hyphen"].alias("hyphen"), x["ends"].alias("ends"), x["empty"].alias("empty"),
        )

    no = F.lit(False)
    start = F.struct(F.lit(0).alias("grp"), F.lit(0).alias("open"), no.alias("mark"), no.alias("hyphen"), no.alias("ends"), no.alias("empty"))
    kind = rows.schema[order].dataType.simpleString()
    groups = folds.scan(F.col("_i"), start, step, lambda s, x: F.struct(x["o"].alias("o"), s["grp"].alias("grp")), f"struct<o:{kind},grp:int>")
    groups = rows.groupBy(*within).agg(F.array_sort(F.collect_list(item)).alias("_i")).select(*within, F.explode(groups).alias("g")).select(*within, F.col("g.o").alias(order), F.col("g.grp").alias("_grp"))
    met = rows.select(*within, order, c.alias("_c")).join(groups, [*within, order])
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, "_c"))), lambda s: s["_c"])
    return met.groupBy(*within, "_grp").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.array_join(texts, " ").alias("text")).drop("_grp")


def semantic_split(units: DataFrame, doc: str, order: str, threshold: float, text: str = "text") -> DataFrame:
    """Parts of documents: a new one begins where a unit is less similar than ``threshold`` to the one before: doc, part, first, n_units, n_chars."""
    along = W.partitionBy(doc).orderBy(order)
    cosine = tfidf_adjacent(units, doc, order, text).select(doc, order, "cosine")
    rows = units.select(doc, order, F.char_length(text).alias("_n")).join(cosine, [doc, order], "left")
    breaks = F.coalesce(F.lag("cosine").over(along) < threshold, F.lit(True))
    parts = rows.withColumn("_b", breaks.cast("long")).withColumn("part", F.sum("_b").over(along.rowsBetween(W.unboundedPreceding, 0)))
    return parts.groupBy(doc, "part").agg(F.min(order).alias("first"), F.count("*").alias("n_units"), F.sum("_n").alias("n_chars"))


def numbered(rows: DataFrame, within: Sequence[str], blocks: Sequence[Column], order: Sequence[str], name: str) -> DataFrame:
    """``name``: the place of each row in its group by ``order``, from 1, without sorting a group whole in one task.

    ``blocks`` don't decrease along ``order`` (its first columns, a range of ids).  A block is what a task sorts; what stands before it comes from a
    table with a row per block.
    """
    marks = [f"_block{k}" for k in range(len(blocks))]
    cut = rows.select("*", *[b.alias(m) for b, m in zip(blocks, marks, strict=True)])
    keys = [*within, *marks]
    before = F.sum("_n").over(W.partitionBy(*within).orderBy(*marks)) - F.col("_n")
    counts = cut.groupBy(*keys).agg(F.count("*").alias("_n")).select(*[F.col(c).alias(f"_at_{c}") for c in keys], before.alias("_before"))
    met = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in keys]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return cut.join(counts, met).select(*rows.columns, (F.col("_before") + place).cast("long").alias(name))

"""Assembly of a document: what became of each place, the numbers sections get, references rewritten to them, and what a reader should check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks
from .loops import release, stored

#: A section, step or item number in running text.
NUMBER = r"[0-9]+(?:\.[0-9]+)*"


def follow_places(places: DataFrame, doc: Sequence[str], place: str = "place", into: str = "into", removed: str = "removed") -> DataFrame:
    """What became of every place: doc, place, final, hops, outcome.

    places: doc, place, into (the place it was merged into; null: it stays), removed.  A place that stays is ``present`` (0 hops); one merged into others is ``merged`` and ends, after so many hops, where the
    chain of merges ends; the outcome is ``removed`` or ``unknown`` if it ends at a removed place or at one that isn't there (final is null), ``cycle`` if it never ends.

    Pointer doubling: each round every open place takes over where its own pointer points to, so rounds are as many as the logarithm of the longest chain.  A place that has made as many hops
    as its document has places runs in a cycle.
    """
    doc = list(doc)
    key = [*doc, "place"]
    rows = places.select(*doc, F.col(place).alias("place"), F.col(into).alias("into"), F.col(removed).alias("removed"))
    count = rows.groupBy(*doc).agg(F.count("*").alias("n"))
    there = rows.select(*doc, F.col("place").alias("into"), F.lit(True).alias("_there")).distinct()
    ends = F.when(F.col("removed"), "removed").when(F.col("into").isNull(), "present").when(F.col("_there").isNull(), "unknown")
    state = rows.join(there, [*doc, "into"], "left").withColumn("end", ends).join(count, doc)
    state = stored(state.select(*key, F.when(F.col("end").isNull(), F.col("into")).otherwise(F.col("place")).alias("at"), F.when(F.col("end").isNull(), 1).otherwise(0).cast("long").alias("hops"), "end", "n"), "places")
    while not state.where("end is null").isEmpty():
        ahead = state.select(*doc, F.col("place").alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("end").alias("_end"))
        moved = state.where("end is null").join(ahead, [*doc, "at"])
        hops = F.col("hops") + F.col("_hops")
        moved = moved.select(*key, F.col("_at").alias("at"), hops.alias("hops"), F.coalesce("_end", F.when(hops > F.col("n"), "cycle")).alias("end"), "n")
        after = stored(state.where("end is not null").unionByName(moved), "places")
        release(state)
        state = after
    outcome = F.when((F.col("end") == "present") & (F.col("hops") > 0), "merged").otherwise(F.col("end"))
    return state.select(*key, F.when(F.col("end") == "present", F.col("at")).alias("final"), F.when(F.col("end") != "cycle", F.col("hops")).alias("hops"), outcome.alias("outcome"))


def show_ref(phrase: Column, old: Column, new: Column) -> tuple[Column, Column]:
    """The phrase with the first number that is ``old`` replaced by ``new``, and where the new number starts (from 0); the phrase itself and null where it has none or a number is null."""
    numbers = F.regexp_extract_all(phrase, F.lit(NUMBER), F.lit(0))
    between = F.split(phrase, NUMBER, -1)
    k = F.when(new.isNotNull(), F.array_position(numbers, old)).otherwise(0)
    front = lambda to: F.aggregate(F.sequence(F.lit(1), to), F.lit(""), lambda acc, i: F.concat(acc, F.element_at(between, i), F.element_at(numbers, i)))
    before = F.concat(F.when(k > 1, front((k - 1).cast("int"))).otherwise(""), F.element_at(between, k.cast("int")))
    shown = F.concat(before, new, F.substring(phrase, F.char_length(before) + F.char_length(old) + 1, F.char_length(phrase)))
    return F.when(k > 0, shown).otherwise(phrase), F.when(k > 0, F.char_length(before))


def assemble(places: DataFrame, refs: DataFrame, doc: Sequence[str] = ("doc",), most_level: int = 9) -> tuple[DataFrame, DataFrame]:
    """(number map, references) of documents put together from places.

    places: doc, place, ord, level, old_number, into, removed; refs: doc, ref, target, phrase.  Sections that stay are numbered by level in order; every other place has the number of the
    place it ended in.  A reference is ``resolved``, ``merged``, or ``unresolved`` with the reason in ``note`` (removed, unknown, cycle, or not a place at all); its phrase shows the new number in place of
    the old one.  Severity, as a reviewer sees it: high if unresolved, medium if merged.
    """
    doc = list(doc)
    places = stored(places.select(*doc, "place", "ord", "level", "old_number", "into", "removed"), "all-places")
    ended = stored(follow_places(places, doc), "ended")
    stays = places.join(ended.where("outcome = 'present'").select(*doc, "place"), [*doc, "place"])
    numbers = chunks.hierarchical_numbers(stays.select(*doc, "place", "ord", "level"), doc, "ord", "level", most_level).join(stays.select(*doc, "place", "ord"), [*doc, "ord"]).select(*doc, F.col("place").alias("final"), "number")
    number_map = stored(ended.join(numbers, [*doc, "final"], "left").select(*doc, "place", "final", "number", "hops", "outcome"), "number-map")
    old = places.select(*doc, F.col("place").alias("target"), "old_number")
    met = refs.join(number_map.withColumnRenamed("place", "target"), [*doc, "target"], "left").join(old, [*doc, "target"], "left")
    note = F.coalesce("outcome", F.lit("no such place"))
    status = F.when(note == "present", "resolved").when(note == "merged", "merged").otherwise("unresolved")
    text, at = show_ref(F.col("phrase"), F.col("old_number"), F.col("number"))
    severity = F.when(status == "unresolved", "high").when(status == "merged", "medium")
    out = met.select(*doc, "ref", "target", status.alias("status"), F.when(status == "unresolved", note).alias("note"), text.alias("text"), at.alias("number_at"), "hops", severity.alias("severity"))
    return number_map, out


def relative_issues(moves: DataFrame, doc: Sequence[str] = ("doc",)) -> DataFrame:
    """References to what stands just above or below that now stands on the other side: doc, place, neighbour, direction.

    moves: doc, place, pos (in the source, unique), new_pos (null: not placed), direction (before, after or null: refers to no neighbour).  The neighbour is the nearest placed one on that side.
    """
    from pyspark.sql.window import Window as W

    doc = list(doc)
    placed = moves.where("new_pos is not null")
    along = W.partitionBy(*doc).orderBy("pos")
    near = F.when(F.col("direction") == "before", F.lag(F.struct("place", "new_pos")).over(along)).when(F.col("direction") == "after", F.lead(F.struct("place", "new_pos")).over(along))
    out = placed.withColumn("_near", near).where(F.col("_near").isNotNull())
    crossed = F.when(F.col("direction") == "before", F.col("_near.new_pos") > F.col("new_pos")).otherwise(F.col("_near.new_pos") < F.col("new_pos"))
    return out.where(crossed).select(*doc, "place", F.col("_near.place").alias("neighbour"), "direction")

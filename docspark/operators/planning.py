"""Planning where a document's sections go in a template: signals per section and target, decisions inherited down the tree, and the plan made of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as t
from .loops import stored, until_empty

#: What a score or margin must reach.
MIN_TARGET_SCORE, LOW_CONFIDENCE, CHECK_SPLIT, AUTO_SPLIT, STRONG_NAME = 0.30, 0.25, 0.30, 0.45, 0.8
#: Targets that a source is held against in its row.
MOST_TARGETS = 256
CONTENTS = r"(?i)^\s*(?:table\s+of\s+)?contents?\s*$"


def _confidence(margin: Column) -> Column:
    """A margin (of scores with three decimals) and .3, at most 1, rounded half up to two decimals; reckoned in thousandths, as .335 is no number of a computer's."""
    return F.least(F.lit(1.0), F.floor((F.round(margin * 1000) + 305) / 10) / 100)


def levels(sections: DataFrame, doc: Sequence[str], section: str, parent: str) -> DataFrame:
    """Sections with ``root`` and ``path`` (the sections from the root to this one): one join per level of the deepest tree.

    A root has no parent or one that isn't there.  Sections under a cycle of parents have no root and are left out.  Every level reads the edges from the shared folder.
    """
    doc = list(doc)
    edges = stored(sections.select(*doc, F.col(section).alias("_s"), F.col(parent).alias("_p")), "edges")
    known = edges.select(*doc, F.col("_s").alias("_p")).distinct()
    roots = edges.join(known, [*doc, "_p"], "left_anti").select(*doc, "_s", F.col("_s").alias("root"), F.array("_s").alias("path"))

    def step(left: DataFrame) -> tuple[DataFrame, DataFrame]:
        below = left.select(*doc, F.col("_s").alias("_p"), "root", "path").join(edges, [*doc, "_p"])
        return left, below.select(*doc, "_s", "root", F.concat("path", F.array("_s")).alias("path"))

    return sections.join(until_empty(roots, step, "levels").withColumnRenamed("_s", section), [*doc, section])


def label_scores(profiles: DataFrame, targets: DataFrame, source: Sequence[str], target: str, match: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """source, target, label_score: the share of each label times the best match among the target's content types, summed.

    profiles: source, label, share; targets: target, types (array).  ``match`` says how well a label fits a type, a small table of a template language; a pair without a label in common has no row.
    A source's few labels are gathered in a row and held against all targets there, so nothing is summed up per pair; more than ``MOST_TARGETS`` targets are met by label instead.
    """
    rows = [F.struct(F.lit(a).alias("label"), F.lit(b).alias("type"), F.lit(float(w)).alias("w")) for a, types in match.items() for b, w in types.items()]
    fits = targets.select(target, F.explode(F.array(*rows)).alias("m"), "types").where(F.array_contains("types", F.col("m.type"))).groupBy(target, F.col("m.label").alias("label")).agg(F.max("m.w").alias("w"))
    if fits.select(target).distinct().count() > MOST_TARGETS:
        return profiles.join(fits, "label").groupBy(*source, target).agg(F.sum(F.col("share") * F.col("w")).alias("label_score"))
    wide = fits.groupBy(target).agg(F.map_from_entries(F.collect_list(F.struct("label", "w"))).alias("_fits"))
    each = profiles.where(F.col("label").isNotNull()).groupBy(*source).agg(F.array_sort(F.collect_list(F.struct("label", "share"))).alias("_shares"))
    common = F.filter("_shares", lambda s: F.map_contains_key("_fits", s["label"]))
    total = F.aggregate("_c", F.lit(None).cast("double"), lambda acc, s: F.when(s["share"].isNull(), acc).otherwise(F.coalesce(acc, F.lit(0.0)) + s["share"] * F.col("_fits")[s["label"]]))
    met = each.crossJoin(F.broadcast(wide)).select(*source, target, "_fits", common.alias("_c")).where(F.size("_c") > 0)
    return met.select(*source, target, total.alias("label_score"))


def section_signals(sections: DataFrame, units: DataFrame, targets: DataFrame, match: Mapping[str, Mapping[str, float]], doc: Sequence[str] = ("doc",)) -> tuple[DataFrame, DataFrame]:
    """What the plan is made from, over whole subtrees: (sections with n_units and all_boilerplate, scores per section and target).

    sections: doc, section, parent, heading; units: doc, section, text, boilerplate, labels (map of label to weight); targets: target, name, text, types.
    Scores: name (of the heading) and content = .75 x label score + .25 x cosine of words, rounded to 3; pairs that share no word of name or text and no label
    have no row and score 0.
    """
    doc = list(doc)
    up = levels(sections, doc, "section", "parent").select(*doc, "section", F.explode("path").alias("above"))
    mine = units.join(up, [*doc, "section"]).select(*doc, F.col("above").alias("section"), "text", "boilerplate", "labels")
    live = mine.where(~F.col("boilerplate") & (F.trim("text") != ""))
    facts = mine.groupBy(*doc, "section").agg(F.count_if(~F.col("boilerplate") & (F.trim("text") != "")).alias("n_units"), F.bool_and("boilerplate").alias("all_boilerplate"))
    out = sections.join(facts, [*doc, "section"], "left").na.fill(0, ["n_units"]).na.fill(False, ["all_boilerplate"])
    share = F.round(F.sum("w") / F.first("n_units"), 3)
    profile = live.select(*doc, "section", F.explode("labels").alias("label", "w")).join(facts.select(*doc, "section", "n_units"), [*doc, "section"]).groupBy(*doc, "section", "label").agg(share.alias("share"))
    labelled = label_scores(profile, targets, [*doc, "section"], "target", match)

    words = lambda df, key, c: df.select(*key, F.explode(t.tokens(F.col(c))).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("n"))
    bag, tbag = words(live, [*doc, "section"], "text"), words(targets, ["target"], "text").withColumnRenamed("n", "tn")
    norm = lambda df, key, c, to: df.groupBy(*key).agg(F.sqrt(F.sum(F.col(c) * F.col(c))).alias(to))
    dot = bag.join(tbag, "word").groupBy(*doc, "section", "target").agg(F.sum(F.col("n") * F.col("tn")).alias("dot"))
    cosine = dot.join(norm(bag, [*doc, "section"], "n", "a"), [*doc, "section"]).join(norm(tbag, ["target"], "tn", "b"), "target").select(*doc, "section", "target", (F.col("dot") / (F.col("a") * F.col("b"))).alias("cosine"))

    heads = sections.select(*doc, "section", t.tokens(F.col("heading")).alias("h"))
    names = targets.select("target", t.tokens(F.col("name")).alias("a"))
    met = heads.select("*", F.explode(F.array_distinct("h")).alias("word")).join(names.select("*", F.explode(F.array_distinct("a")).alias("word")), "word").dropDuplicates([*doc, "section", "target"])
    name = met.select(*doc, "section", "target", t.name_score(F.col("h"), F.col("a")).alias("name"))
    key = [*doc, "section", "target"]
    both = name.join(labelled, key, "full_outer").join(cosine, key, "full_outer").na.fill(0.0)
    return out, both.select(*key, "name", F.round(0.75 * F.col("label_score") + 0.25 * F.col("cosine"), 3).alias("content"))


def combined_scores(scores: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds score: .7 name + .3 content where the best name is strong (.8), else .35 and .65; rounded to 3."""
    weight = F.when(F.max("name").over(W.partitionBy(*key)) >= STRONG_NAME, 0.7).otherwise(0.35)
    return scores.withColumn("_w", weight).withColumn("score", F.round(F.col("_w") * F.col("name") + (1 - F.col("_w")) * F.col("content"), 3)).drop("_w")


def propose_sections(sections: DataFrame, scores: DataFrame, doc: Sequence[str] = ("doc",), skip_preamble: bool = True) -> DataFrame:
    """A decision per section: doc, section, parent, target, kind (mapped, omit, unresolved), reason, confidence, doubt, inherited, moved_from.

    sections: doc, section, parent, ord, heading, number, n_units, all_boilerplate; scores: doc, section, target, name, content (no row: 0).
    Roots: contents pages, the cover (number 0) and what stands before the first numbered chapter are omitted; without a target of ``MIN_TARGET_SCORE`` a root is unresolved; boilerplate without a
    strong name is omitted; else it goes to its best target (ties: the smaller one), with a doubt 'close call' where the second is nearer than ``LOW_CONFIDENCE``.  Children inherit their
    parent's decision, whatever it came from; where the parent is mapped and another target fits the child's content better, by ``AUTO_SPLIT`` (three units or more) the child moves there and takes
    its children along, by ``CHECK_SPLIT`` (two or more) it stays with a doubt.  Sections under a cycle of parents are unresolved.

    One join per level of the tree, all documents at once; what a level needs of the sections is worked out once and written to the shared folder.
    """
    doc = list(doc)
    key = [*doc, "section"]
    ranked = combined_scores(scores, key).withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), "target"))).withColumn("_second", F.lead(F.struct("score", "target")).over(W.partitionBy(*key).orderBy(F.desc("score"), "target"))).withColumn("_name", F.max("name").over(W.partitionBy(*key)))
    best = ranked.where("_n = 1").select(*key, F.struct("target", "score", (F.col("score") - F.coalesce("_second.score", F.lit(0.0))).alias("margin"), F.col("_second.target").alias("second"), F.col("_name").alias("name")).alias("best"))
    contents = scores.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("target", "content"))).alias("contents"), F.min(F.struct((-F.col("content")).alias("m"), "target")).alias("alt"))
    rows = sections.join(best, key, "left").join(contents, key, "left").withColumn("toc", F.coalesce(F.col("heading").rlike(CONTENTS), F.lit(False)))
    rows = stored(rows, "proposal-sections")
    known = rows.select(*doc, F.col("section").alias("parent")).distinct()
    roots = rows.join(known, [*doc, "parent"], "left_anti")

    chapter = F.col("number").rlike(r"^[0-9]+(\.|$)") & (F.col("number") != "0")
    first = F.min(F.when(chapter, F.col("ord"))).over(W.partitionBy(*doc))
    b, none = F.col("best"), F.lit(None)
    good = F.coalesce((b["score"] > 0) & (b["score"] >= MIN_TARGET_SCORE), F.lit(False))
    say = lambda kind, reason, confidence, target=none, doubt=none: F.struct(target.cast(scores.schema["target"].dataType).alias("target"), F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"), doubt.cast("string").alias("doubt"))
    close = F.when(F.round(b["margin"], 3) < LOW_CONFIDENCE, F.concat(F.lit("close call: "), b["target"].cast("string"), F.lit(" vs "), b["second"].cast("string")))
    decision = (
        F.when(F.col("toc"), say("omit", "contents", 1.0))
        .when((F.col("number") == "0") & skip_preamble, say("omit", "cover", 1.0))
        .when((F.col("ord") < F.col("_first")) & skip_preamble, say("omit", "front matter", 1.0))
        .when(~good, say("unresolved", "no match", 0.0, doubt=F.lit("no confident match")))
        .when(F.col("all_boilerplate") & (b["name"] < STRONG_NAME), say("omit", "administrative", 0.9))
        .otherwise(say("mapped", "best match", _confidence(b["margin"]), b["target"], close))
    )
    none_moved = F.lit(None).cast(scores.schema["target"].dataType)
    start = roots.withColumn("_first", first).select(*key, "parent", decision.alias("d"), F.lit(False).alias("inherited"), none_moved.alias("moved_from"))

    children = rows.select(*doc, F.col("section").alias("_child"), F.col("parent").alias("section"), "toc", "n_units", "contents", "alt")

    def step(left: DataFrame) -> tuple[DataFrame, DataFrame]:
        met = left.select(*key, "d").join(children, key)
        d, alt = F.col("d"), F.col("alt")
        gap = F.round(-alt["m"] - F.coalesce(F.col("contents")[d["target"]], F.lit(0.0)), 3)
        other = F.coalesce((d["kind"] == "mapped") & (F.col("n_units") >= 2) & (alt["m"] < 0) & (alt["target"] != d["target"]), F.lit(False))
        moves = other & (gap >= AUTO_SPLIT) & (F.col("n_units") >= 3)
        doubts = other & (gap >= CHECK_SPLIT)
        new = (
            F.when(F.col("toc"), say("omit", "contents", 1.0))
            .when(moves, say("mapped", "content belongs elsewhere", _confidence(gap), alt["target"]))
            .when(doubts, F.struct(d["target"].alias("target"), d["kind"].alias("kind"), F.lit("inherited").alias("reason"), F.least(d["confidence"], F.lit(0.5)).alias("confidence"), F.concat(F.lit("content suggests "), alt["target"].cast("string")).alias("doubt")))
            .otherwise(F.struct(d["target"].alias("target"), d["kind"].alias("kind"), F.lit("inherited").alias("reason"), d["confidence"].alias("confidence"), F.lit(None).cast("string").alias("doubt")))
        )
        stays = ~F.col("toc") & ~moves
        below = met.select(*doc, F.col("_child").alias("section"), F.col("section").alias("parent"), new.alias("d"), stays.alias("inherited"), F.when(~F.col("toc") & moves, d["target"]).alias("moved_from"))
        return left, below

    done = until_empty(start, step, "proposal")
    lost = rows.join(done.select(*key), key, "left_anti").select(*key, "parent", say("unresolved", "parents form a cycle", 0.0).alias("d"), F.lit(False).alias("inherited"), none_moved.alias("moved_from"))
    return done.unionByName(lost).select(*key, "parent", "d.target", "d.kind", "d.reason", "d.confidence", "d.doubt", "inherited", "moved_from")


def build_section_plan(decisions: DataFrame, sections: DataFrame, units: DataFrame, targets: DataFrame, doc: Sequence[str] = ("doc",)) -> DataFrame:
    """The plan made of decisions, a mapping a row: doc, target (null: omitted or unresolved), type, status, sections, units, confidence, reasons.

    sections: doc, section, parent, ord; units: doc, section, unit, n; targets: target, required.  A target of one root is one_to_one, of several merge; where a root feeds more than one
    target these are split and list the units of such roots; a doubt asks for review; a target that nobody feeds is unresolved (source_content_not_found if required).  What is omitted or unresolved is one
    mapping per root and kind.  Lists are in document order and hold one document's sections and units.
    """
    doc = list(doc)
    tree = levels(sections, doc, "section", "parent").select(*doc, "section", "ord", "root")
    rows = stored(decisions.join(tree, [*doc, "section"], "left").withColumn("root", F.coalesce("root", "section")), "decisions")
    mapped = rows.where("kind = 'mapped'")
    split = mapped.groupBy(*doc, "root").agg((F.count_distinct("target") > 1).alias("is_split"))
    mapped = mapped.join(split, [*doc, "root"])
    listed = lambda c, by, when=None: F.transform(F.array_sort(F.collect_list(F.struct(*by, c) if when is None else F.when(when, F.struct(*by, c)))), lambda s: s[c])
    per_unit = mapped.where("is_split").join(units, [*doc, "section"]).groupBy(*doc, "target").agg(listed("unit", ["ord", "n"]).alias("units"))
    found = mapped.groupBy(*doc, "target").agg(
        listed("section", ["ord"]).alias("sections"), F.count_distinct("root").alias("_roots"), F.bool_or(F.col("doubt").isNotNull()).alias("_doubt"), F.round(F.min("confidence"), 2).alias("confidence"),
        F.array_sort(F.collect_set(F.when(~F.col("inherited"), F.col("reason")))).alias("reasons"),
    )
    found = found.join(per_unit, [*doc, "target"], "left").withColumn("units", F.coalesce("units", F.array().cast(f"array<{units.schema['unit'].dataType.simpleString()}>")))
    kind = F.when(F.size("units") > 0, "split").when(F.col("_roots") > 1, "merge").otherwise("one_to_one")
    found = found.select(*doc, "target", kind.alias("type"), F.when(F.col("_doubt"), "needs_review").otherwise("mapped").alias("status"), "sections", "units", "confidence", "reasons")
    no_sections, no_units, no_reasons = (F.array().cast(found.schema[c].dataType) for c in ("sections", "units", "reasons"))
    docs = rows.select(*doc).distinct()
    n = targets.count()
    wanted = docs.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0))))).join(targets.withColumn("_t", F.row_number().over(W.orderBy("target")) - 1), "_t").drop("_t")
    missing = wanted.join(found, [*doc, "target"], "left_anti").select(*doc, "target", F.lit("unresolved").alias("type"), F.when(F.col("required"), "source_content_not_found").otherwise("not_applicable").alias("status"), no_sections.alias("sections"), no_units.alias("units"), F.lit(1.0).alias("confidence"), no_reasons.alias("reasons"))
    rest = rows.where("kind <> 'mapped'").groupBy(*doc, "root", "kind").agg(listed("section", ["ord"]).alias("sections"), F.min_by("confidence", F.struct("ord", "section")).alias("confidence"), F.min_by("reason", F.struct("ord", "section")).alias("reason"))
    rest = rest.select(*doc, F.lit(None).cast(found.schema["target"].dataType).alias("target"), F.col("kind").alias("type"), F.when(F.col("kind") == "omit", "not_applicable").otherwise("needs_review").alias("status"), "sections", no_units.alias("units"), "confidence", F.array("reason").alias("reasons"))
    return found.unionByName(missing).unionByName(rest)

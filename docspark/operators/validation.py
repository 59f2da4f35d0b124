"""Validation of plans and reports of quality: issues as rows, gates they hold up, and what a reviewer has settled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .loops import stored

SEVERITIES = ("info", "low", "medium", "high", "critical")


def rank(severity: Column) -> Column:
    """0 for info to 4 for critical."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1


def validate_slot_plan(scope: DataFrame, slots: DataFrame, mappings: DataFrame, placed: DataFrame, unplaced: DataFrame, doc: Sequence[str] = ("doc",)) -> tuple[DataFrame, DataFrame]:
    """(issues: doc, section, slot, issue, severity, gate, units; coverage: doc, n_units, n_accounted, coverage).

    scope: doc, section, unit, seq (what the section plan gives to a section); slots: doc, section, slot, required, grp (of slots one of which is enough; null: none); mappings: doc, section, slot,
    status, review; placed: doc, section, slot (null: a choice of region), unit, pos; unplaced: doc, section, unit.

    Sections: ``no_plan`` if nothing is mapped, placed or set aside (nothing else is said of it then); ``unaccounted`` units in scope that are nowhere; ``outside`` ones placed though another section has them; ``unplaced`` ones set aside.
    Slots: ``no_mapping``; with units ``order`` if they aren't in source order and ``review`` if the mapping asks for it; without units ``gap`` if no source was found, else ``required`` if the
    slot is required, its section has a scope and no other slot of its group is filled or a gap.  Unit lists are in source order.

    What is said of units (in scope, placed, set aside) travels once, to its document; a unit's first place, the order in slots and a section's lists follow there.  A section then meets its slots and their
    mappings as two lists, and issues are read off its row.  Tables meet by sorting, never through the driver: compressed files look small enough to be sent to all tasks when they aren't.
    """
    doc = list(doc)
    sec, key = [*doc, "section"], [*doc, "section", "slot"]
    slot_type = slots.schema["slot"].dataType
    no_slot, no_pos = F.lit(None).cast(slot_type).alias("slot"), F.lit(None).cast(placed.schema["pos"].dataType).alias("pos")
    no_seq = F.lit(None).cast(scope.schema["seq"].dataType).alias("seq")
    said = scope.select(*sec, "unit", F.lit("scope").alias("_as"), "seq", no_slot, no_pos).unionByName(placed.select(*sec, "unit", F.lit("placed").alias("_as"), no_seq, F.col("slot").cast(slot_type).alias("slot"), "pos"))
    said = said.unionByName(unplaced.select(*sec, "unit", F.lit("aside").alias("_as"), no_seq, no_slot, no_pos)).repartition(*doc)
    first = F.when(F.col("unit").isNotNull(), F.min("seq").over(W.partitionBy(*doc, "unit")))
    said = said.withColumn("seq", F.coalesce(first, F.lit(0)))
    said = said.withColumn("_bad", F.coalesce(F.col("seq") < F.lag("seq").over(W.partitionBy(*key, "_as").orderBy("pos", "unit")), F.lit(False)))
    # A null unit is never the same as another one.
    same, is_ = F.col("unit").isNotNull(), lambda how: F.max(F.col("_as") == how)
    in_slot = F.when((F.col("_as") == "placed") & F.col("slot").isNotNull(), F.struct("slot", F.col("_bad").alias("bad")))
    units = said.groupBy(*sec, "unit").agg(F.min("seq").alias("s"), is_("scope").alias("_scope"), is_("placed").alias("_placed"), is_("aside").alias("_aside"), F.collect_set(in_slot).alias("_slots"))
    units = units.withColumn("_u", F.struct("s", F.col("unit").cast("string").alias("u"))).withColumn("_found", same & (F.col("_placed") | F.col("_aside")))
    listed = lambda rows: F.transform(F.sort_array(F.collect_set(F.when(rows, F.col("_u")))), lambda x: x["u"])
    by_section = units.groupBy(*sec).agg(
        F.max("_scope").alias("_scoped"), F.max(F.col("_placed") | F.col("_aside")).alias("_touched"), listed(F.col("_scope") & ~F.col("_found")).alias("_lost"),
        listed(F.col("_placed") & ~(same & F.col("_scope"))).alias("_outside"), listed(F.col("_aside")).alias("_left"), F.array_distinct(F.flatten(F.collect_list("_slots"))).alias("_filled"),
    )
    mapped = mappings.groupBy(*sec).agg(F.collect_list(F.struct("slot", "status", "review")).alias("_mappings"))
    sections = slots.groupBy(*sec).agg(F.collect_list(F.struct("slot", "required", "grp")).alias("_slots")).join(by_section.hint("merge"), sec, "left").join(mapped.hint("merge"), sec, "left")
    sections = sections.withColumns({"_known": F.col("_mappings").isNotNull() | F.coalesce("_touched", F.lit(False)), "_scoped": F.coalesce("_scoped", F.lit(False))})

    def state(slot: Column) -> Column:
        """A slot with each of its mappings, or none."""
        mine = F.filter("_mappings", lambda m: m["slot"] == slot["slot"])
        full = lambda bad: F.coalesce(F.exists("_filled", lambda f: (f["slot"] == slot["slot"]) & (f["bad"] | F.lit(not bad))), F.lit(False))

        def row(mapping: Column, is_mapped: bool) -> Column:
            gap = F.coalesce(mapping["status"] == "source_content_not_found", F.lit(False)) if is_mapped else F.lit(False)
            review = F.coalesce(mapping["review"], F.lit(False)) | (mapping["status"] == "needs_review") if is_mapped else F.lit(False)
            serves = (full(False) | gap) & F.lit(is_mapped)
            return F.struct(slot["slot"].alias("slot"), slot["required"].alias("required"), slot["grp"].alias("grp"), F.lit(is_mapped).alias("mapped"), review.alias("review"), gap.alias("gap"), full(False).alias("filled"), full(True).alias("bad"), serves.alias("serves"))

        return F.when(F.coalesce(F.size(mine), F.lit(0)) > 0, F.transform(mine, lambda m: row(m, True))).otherwise(F.array(row(slot, False)))

    sections = sections.withColumn("_state", F.when(F.col("_known"), F.flatten(F.transform("_slots", state)))).drop("_slots", "_mappings", "_filled")
    none, no_units = F.lit(None).cast("string"), F.array().cast("array<string>")

    def say(when: Column, slot: Column, issue: str, severity: str, gate: str | None, units: Column = no_units) -> Column:
        return F.when(when, F.struct(slot.alias("slot"), F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), (F.lit(gate) if gate else none).alias("gate"), units.alias("units")))

    def about_slot(x: Column) -> Column:
        others = F.size(F.filter("_state", lambda y: (y["grp"] == x["grp"]) & y["serves"])) - x["serves"].cast("int")
        full, empty = x["mapped"] & x["filled"], x["mapped"] & ~x["filled"]
        bare = empty & ~x["gap"] & x["required"] & F.col("_scoped") & (x["grp"].isNull() | (others == 0))
        return F.array(
            say(~x["mapped"], x["slot"], "no_mapping", "high", "missing_slot"), say(full & x["bad"], x["slot"], "order", "high", "sequence_violation"), say(full & x["review"], x["slot"], "review", "medium", None),
            say(empty & x["gap"], x["slot"], "gap", "medium", None), say(bare, x["slot"], "required", "high", "missing_slot"),
        )

    some = lambda c: F.col("_known") & (F.size(c) > 0)
    about_section = F.array(
        say(~F.col("_known"), no_slot, "no_plan", "high", "missing_slot"), say(some("_lost"), no_slot, "unaccounted", "critical", "unaccounted_source", F.col("_lost")),
        say(some("_outside"), no_slot, "outside", "high", "unaccounted_source", F.col("_outside")), say(some("_left"), no_slot, "unplaced", "medium", None, F.col("_left")),
    )
    about_slots = F.when(F.col("_known"), F.flatten(F.transform("_state", about_slot)))
    issues = sections.select(*sec, F.explode_outer(F.array_compact(F.concat(about_section, F.coalesce(about_slots, F.array(say(F.lit(False), no_slot, "", "", None)))))).alias("_i")).where("_i is not null")
    hit = units.where("_scope").groupBy(*doc, "unit").agg(F.max("_found").alias("_hit"))
    coverage = hit.groupBy(*doc).agg(F.count("*").alias("n_units"), F.count_if("_hit").alias("n_accounted")).withColumn("coverage", F.round(F.col("n_accounted") / F.col("n_units"), 3))
    return issues.select(*sec, "_i.*"), coverage


def quality_report(issues: DataFrame, risks: DataFrame, previous: DataFrame, doc: Sequence[str] = ("doc",)) -> tuple[DataFrame, DataFrame]:
    """(issues, gates) of a new version: what the last version's reviewer settled stays settled, open issues on risky passages hold up completion.

    issues: doc, issue_id, severity, gate, critic (whether a model's opinion), units (array of text), in any number of copies, of which the most severe counts; risks: doc, unit, tag; previous: doc, issue_id, resolved, note.
    An open issue without a gate on a unit with a risk gets the gate ``high_risk_unresolved`` and is high at least, if it is medium at least (high, if a critic's).  Issues are numbered in the order they are shown:
    open before resolved, with a gate before without, then by severity and id.  gates: doc, gate, n_open, and per document also gate ``all``, for a document without open ones 0.
    Joins sort (see ``validate_slot_plan``); issues travel once, to be merged with what was settled, and are written to the shared folder; only those that a risk can change meet risks.
    """
    doc = list(doc)
    key = [*doc, "issue_id"]
    by = F.struct(rank(F.col("severity")).alias("r"), F.coalesce("gate", F.lit("")).alias("g"))
    said = issues.select(*key, F.struct("severity", "gate", "critic", "units").alias("_x"), by.alias("_by"))
    settled = previous.where("resolved").dropna(subset=key).select(*key, "note", F.lit(True).alias("resolved"))
    rows = said.unionByName(settled, allowMissingColumns=True).groupBy(*key).agg(F.max_by("_x", "_by").alias("_x"), F.min("note").alias("note"), F.coalesce(F.max("resolved"), F.lit(False)).alias("resolved"))
    rows = stored(rows.where("_x is not null").select(*key, "_x.*", "note", "resolved"), "report-issues")
    tags = risks.select(*doc, F.col("unit").cast("string").alias("_u"), "tag")
    floor = F.when(F.coalesce("critic", F.lit(False)), 3).otherwise(2)
    can_rise = F.coalesce(F.col("gate").isNull() & ~F.col("resolved") & (rank(F.col("severity")) >= floor) & (F.size("units") > 0), F.lit(False))
    rising = rows.where(can_rise)
    risky = rising.select(*key, F.explode("units").alias("_u")).join(tags.hint("merge"), [*doc, "_u"]).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("risk"))
    rows = rising.join(risky.hint("merge"), key, "left").unionByName(rows.where(~can_rise).withColumn("risk", F.lit(None).cast("string")))
    raised = F.col("risk").isNotNull()
    rows = rows.withColumn("_raised", raised)
    rows = rows.withColumn("gate", F.when(F.col("_raised"), "high_risk_unresolved").otherwise(F.col("gate"))).withColumn("severity", F.when(F.col("_raised") & (rank(F.col("severity")) < 3), "high").otherwise(F.col("severity")))
    rows = rows.withColumn("risk", F.when(F.col("_raised"), F.col("risk"))).drop("_raised")
    order = [F.col("resolved"), F.col("gate").isNull(), rank(F.col("severity")).desc(), F.col("issue_id")]
    shown = rows.withColumn("n", F.row_number().over(W.partitionBy(*doc).orderBy(*order)))
    open_ = F.col("gate").isNotNull() & ~F.col("resolved")
    each = rows.select(*doc, open_.alias("_open"), F.explode(F.array(F.lit("all"), F.when(open_, F.col("gate")))).alias("gate")).where("gate is not null")
    gates = each.groupBy(*doc, "gate").agg(F.count_if("_open").alias("n_open"))
    return shown, gates

"""Facts of units and whether the claims that cite them keep them: values, obligations, roles, terms, quoted names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts
from ..functions import text as t
from . import reconcile
from .loops import stored


def per_text(units: DataFrame, read: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ("text",)) -> DataFrame:
    """``units`` joined with what ``read`` makes of their distinct texts (any number of rows each, with the columns ``keys``), so that a text which recurs is read once.

    What was read is written to the shared folder: its size is known then, and while it is small, units stay where they are.
    """
    return units.join(stored(read(units.select(*keys).distinct()), "texts"), list(keys))


def _bound(texts: DataFrame, keys: Sequence[str], known: Column | None) -> DataFrame:
    """A row per sentence of a text and modality: keys, pos, statement, modality, actor."""
    rows = texts.select(*keys, F.posexplode_outer(t.sentences(F.col("text"))).alias("pos", "statement")).where("statement is not null")
    rows = rows.select("*", F.explode_outer(facts.modalities(F.col("statement"))).alias("modality")).where("modality is not null")
    return rows.select(*keys, "pos", "statement", "modality", F.get(facts.roles(F.col("statement"), known), F.lit(0)).alias("actor"))


def obligations(units: DataFrame, unit: str, text: str = "text", known: Column | None = None) -> DataFrame:
    """A row per sentence and modality: unit, pos (of the sentence, from 0), statement, modality, actor (the sentence's first role; null without one).  Sentences that bind nobody have no row."""
    keys = ["text"] if known is None else ["text", "_known"]
    rows = units.select(unit, F.col(text).alias("text"), *([] if known is None else [F.coalesce(known, F.array().cast("array<string>")).alias("_known")]))
    return per_text(rows, lambda texts: _bound(texts, keys, None if known is None else F.col("_known")), keys).select(unit, "pos", "statement", "modality", "actor")


def role_rows(units: DataFrame, text: str = "text") -> DataFrame:
    """``units`` with a row per role that its text names: role, in place of the text."""
    rows = units.withColumnRenamed(text, "text")
    return per_text(rows, lambda texts: texts.select("text", F.explode_outer(facts.roles(F.col("text"))).alias("role")).where("role is not null")).drop("text")


def term_rows(units: DataFrame, text: str = "text") -> DataFrame:
    """``units`` with a row per term that its text defines: term, abbr, in place of the text."""
    rows = units.withColumnRenamed(text, "text")
    found = lambda texts: texts.select("text", F.explode_outer(facts.defined_terms(F.col("text"))).alias("d")).where("d is not null").select("text", "d.term", "d.abbr")
    return per_text(rows, found).drop("text")


def known_roles(units: DataFrame, doc: list[str]) -> DataFrame:
    """Per document: roles (those its units name, and defined terms that are roles, with their abbreviations; sorted) and full ({abbr, term} of all defined terms; of several terms the first in order).

    units: doc, named (roles of its text), terms ({term, abbr}).  Names are summed up in tasks before they are shuffled, once.
    """
    none = F.lit(None).cast("string")
    is_role = lambda d: d["term"].rlike(f"^{facts.ROLE}$") | d["term"].isin(*facts.COMMON_ROLES)
    spelled = F.flatten(F.transform(F.filter("terms", is_role), lambda d: F.array(d["term"], d["abbr"])))
    said = F.concat(F.transform(F.array_union("named", spelled), lambda r: F.struct(r.alias("role"), none.alias("abbr"), none.alias("term"))), F.transform("terms", lambda d: F.struct(none.alias("role"), d["abbr"].alias("abbr"), d["term"].alias("term"))))
    each = units.select(*doc, F.explode_outer(said).alias("s"))
    pair = F.when(F.col("s.abbr").isNotNull(), F.struct("s.abbr", "s.term"))
    known = each.groupBy(*doc).agg(F.sort_array(F.collect_set("s.role")).alias("roles"), F.sort_array(F.collect_set(pair)).alias("_pairs"))
    abbrs = F.array_distinct(F.transform("_pairs", lambda x: x["abbr"]))
    return known.select(*doc, "roles", F.transform(abbrs, lambda k: F.get(F.filter("_pairs", lambda x: x["abbr"] == k), F.lit(0))).alias("full"))


def extract_facts(units: DataFrame, doc: list[str], unit: str, text: str = "text") -> DataFrame:
    """All protected facts, a row each: doc, unit, fact (value, obligation, term, role), kind, raw, normalized.

    Values have their kind; obligations the modality as kind, the statement as raw and the actor as normalized (future ones are no obligations); terms the abbreviation as kind; roles their
    canonical form.  Blank units have none.  What a document knows as roles is collected from all its units first, a list of distinct names.

    Texts are read once each and have a number from then on.  Of what a document knows, only what stands in a text (or in a sentence of it) matters for it; a text is read once more with each such list, for
    all its facts.  Units carry numbers and lists, through one shuffle, and meet their facts at the end.
    """
    doc = list(doc)
    rows = units.where(F.trim(F.coalesce(text, F.lit(""))) != "").select(*doc, unit, F.col(text).alias("text"))
    none = F.lit(None).cast("string")
    read = facts.with_values(rows.select("text").distinct(), "text", "_values").select(
        F.monotonically_increasing_id().alias("_id"), "text", "_values", facts.roles(F.col("text")).alias("named"), facts.defined_terms(F.col("text")).alias("terms"),
        F.concat_ws("\n", "text", t.clean_text(F.col("text")), F.transform(t.sentences(F.col("text")), t.clean_text)).alias("_shown"),
    )
    read = stored(read, "texts")
    known = known_roles(rows.join(read.select("text", "named", "terms"), "text"), doc)
    met = rows.join(read.select("text", "_id"), "text").drop("text").join(known.hint("merge"), doc, "left").join(read.select("_id", "_shown"), "_id")
    shown = lambda c, of: F.coalesce(F.filter(c, lambda x: F.contains("_shown", of(x))), F.filter(F.array().cast(known.schema[c].dataType), lambda x: F.lit(True)))
    met = stored(met.select(*doc, unit, "_id", shown("roles", lambda r: r).alias("roles"), shown("full", lambda x: x["abbr"]).alias("full")), "met-texts")

    key = ["_id", "roles", "full"]
    texts = met.select(*key).distinct().join(read, "_id")
    fact = lambda name, kind, raw, normalized: F.struct(F.lit(name).alias("fact"), kind.alias("kind"), raw.alias("raw"), normalized.alias("normalized"))
    canonical = lambda r: facts.canonical_role(r, F.map_from_entries("full"))
    plain = F.concat(
        F.transform("_values", lambda v: fact("value", v["kind"], v["raw"], v["normalized"])), F.transform("terms", lambda d: fact("term", d["abbr"], d["term"], d["term"])),
        F.transform(facts.roles(F.col("text"), F.col("roles")), lambda r: fact("role", none, r, canonical(r))),
    )
    bound = _bound(texts, key, F.col("roles")).where("modality <> 'future'").select(*key, F.array(fact("obligation", F.col("modality"), F.col("statement"), F.col("actor"))).alias("_facts"))
    said = texts.select(*key, plain.alias("_facts")).unionByName(bound).groupBy(*key).agg(F.flatten(F.collect_list("_facts")).alias("_facts"))
    return met.join(stored(said, "facts"), key).select(*doc, unit, F.explode("_facts").alias("_f")).select(*doc, unit, "_f.*")


def set_diff(source: DataFrame, claims: DataFrame, key: str, value: str) -> DataFrame:
    """Values of a key in one of two frames only, as sets: key, value, change (missing or added)."""
    a, b = source.select(key, value).distinct().withColumn("_a", F.lit(True)), claims.select(key, value).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, [key, value], "full_outer").where("_a is null or _b is null")
    return both.select(key, value, F.when(F.col("_a"), "missing").otherwise("added").alias("change"))


def role_diff(units: DataFrame, claims: DataFrame, unit: str, full: Column | None = None, known: Column | None = None) -> DataFrame:
    """Roles that the claims citing a unit don't name (missing) or name beyond it (added), in canonical form: unit, role, change.

    Both frames: unit, text and the columns that ``full`` (abbreviations) and ``known`` (roles) name.
    """
    if full is None and known is None:
        named = lambda df: role_rows(df.select(unit, "text")).select(unit, facts.canonical_role(F.col("role")).alias("role")).where("role <> ''")
    else:
        named = lambda df: df.select(unit, F.explode_outer(F.transform(facts.roles(F.col("text"), known), lambda r: facts.canonical_role(r, full))).alias("role")).where("role <> ''")
    return set_diff(named(units), named(claims), unit, "role")


def facts_of_texts(texts: DataFrame) -> DataFrame:
    """Each distinct text with all it commits to: text, values, strengths, roles (canonical), names (quoted), plain; written to the shared folder, as several comparisons read it."""
    strengths = F.array_distinct(F.flatten(F.transform(t.sentences(F.col("text")), facts.modalities)))
    out = facts.with_values(texts.select("text").distinct())
    named = F.filter(F.transform(facts.roles(F.col("text")), lambda r: facts.canonical_role(r)), lambda r: r != "")
    return stored(out.select("text", "values", strengths.alias("strengths"), named.alias("roles"), facts.quoted_names(F.col("text")).alias("names"), t.norm_lower(F.col("text")).alias("plain")), "facts")


def check_preservation(units: DataFrame, claims: DataFrame, unit: str) -> DataFrame:
    """Units without a claim, and what claims lost, added or changed: unit, issue, kind, lost, added.

    Both frames: unit, text.  Issues: uncited; missing, added and changed values; modality_lost and modality_added; role_missing and role_added; quote_lost (a quoted name that no claim has word
    for word, any case).  A unit's claims count together; claims of units that aren't there are not looked at.  Equal texts are read once.
    """
    none = F.lit(None).cast("string")
    out = lambda df, issue, kind, lost, added: df.select(unit, issue.alias("issue"), kind.alias("kind"), lost.alias("lost"), added.alias("added"))
    ids = claims.select(unit).distinct()
    uncited = out(units.join(ids, unit, "left_anti"), F.lit("uncited"), none, none, none)
    read = facts_of_texts(units.select("text").union(claims.select("text")))
    cited, citing = units.join(ids, unit, "left_semi").join(read, "text"), claims.join(units.select(unit).distinct(), unit, "left_semi").join(read, "text")

    rows = lambda df: df.select(unit, F.posexplode("values").alias("pos", "v")).select(unit, F.col("v.kind").alias("kind"), F.col("v.normalized").alias("normalized"), "pos")
    values = reconcile.value_diff(rows(cited), rows(citing), unit)
    values = out(values, F.col("change"), F.col("kind"), F.col("lost"), F.col("added"))

    def pick(column: str, kind: str, missing: str, added: str) -> DataFrame:
        listed = lambda df: df.select(unit, F.explode(column).alias("x"))
        gone = F.col("change") == "missing"
        return out(set_diff(listed(cited), listed(citing), unit, "x"), F.when(gone, missing).otherwise(added), F.lit(kind), F.when(gone, F.col("x")), F.when(~gone, F.col("x")))

    names = cited.select(unit, F.explode("names").alias("name")).distinct()
    kept = names.join(citing.select(unit, "plain"), unit).where(F.contains("plain", t.norm_lower(F.col("name")))).select(unit, "name").distinct()
    quotes = out(names.join(kept, [unit, "name"], "left_anti"), F.lit("quote_lost"), F.lit("quote"), F.col("name"), none)
    changes = values.unionByName(pick("strengths", "modality", "modality_lost", "modality_added")).unionByName(pick("roles", "role", "role_missing", "role_added"))
    return uncited.unionByName(changes).unionByName(quotes)

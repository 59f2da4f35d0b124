"""Personal data: base patterns with positions, and information-theoretic sanitisation of terms that reveal them.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
#: The base patterns with possessive repeats: they match what the plain ones match, without backtracking or recursion on long runs.  The
#: look-behinds only skip starts from which the leftmost match can't begin (it would have begun earlier in the run).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TERM = r"[^\p{L}]+"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= F.when(F.coalesce(F.try_to_number(F.substring(F.ltrim(p, F.lit("0")), 1, 3), F.lit("999")), F.lit(0)) <= 255, 3).otherwise(-1))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _may_have(kind: str, text: Column) -> Column:
    """A cheap test that no text with a span of the kind fails."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")


def _next_words(gap: Column, near: int, back: bool) -> Column:
    """The ``near`` words of a text nearest to its start (``back``: its end), nearest first, lower-cased, e-mail addresses left out."""
    bare = F.regexp_replace(gap, PATTERNS["email"], " 0 ")
    some = F.regexp_extract(F.reverse(bare) if back else bare, rf"^(?:\P{{L}}*+\p{{L}}++){{0,{near}}}", 0)
    words = F.filter(F.split(some, _TERM), lambda w: F.length(w) > 0)
    return F.transform(words, lambda w: F.lower(F.reverse(w) if back else w))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(items: Column, start: Column, empty: Column, step, block: int = 256) -> Column:
    """What ``step(state, item) -> (state, array to add)`` adds along an array, in order.

    Appending to an array copies it; so the results of ``block`` items at a time are gathered by themselves, and a text costs block / 2 copies per item, not half its items.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(items) / block).cast("int")), lambda k: F.slice(items, k * block + 1, block))

    def inner(acc: Column, x: Column) -> Column:
        state, more = step(acc["state"], x)
        return F.struct(state.alias("state"), F.when(F.size(more) > 0, F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    def outer(acc: Column, b: Column) -> Column:
        done = F.aggregate(b, F.struct(acc["state"].alias("state"), empty.alias("out")), inner)
        return _once(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["outs"], F.array(d["out"])).alias("outs")))

    return F.aggregate(blocks, F.struct(start.alias("state"), F.filter(F.array(empty), lambda x: F.lit(False)).alias("outs")), outer, lambda acc: F.flatten(acc["outs"]))


def matches(kind: str, text: Column, near: int = 3) -> Column:
    """Array of {kind, start, end, value, left, right}: valid matches, code points, end exclusive, with the ``near`` words on either side,
    whole and however far away; other matches of the kind hold none."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    no_words, empty = F.array().cast("array<string>"), F.array().cast("array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>")
    checked = F.transform(F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("l"), F.slice(between, 2, F.size(found)).alias("r")), lambda x: F.struct(x["m"].alias("m"), x["l"].alias("l"), x["r"].alias("r"), _valid(kind, x["m"]).alias("ok")))

    def spans(all_: Column) -> Column:
        def forth(state: Column, x: Column):
            words = F.slice(F.concat(_next_words(x["l"], near, True), state["words"]), 1, near)
            start = state["at"] + F.char_length(x["l"])
            end = start + F.char_length(x["m"])
            one = lambda w: F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("value"), F.array_join(F.reverse(w), " ").alias("left"))
            some = F.array(one(words))
            return F.struct(end.alias("at"), words.alias("words")), F.when(x["ok"], some).otherwise(F.filter(some, lambda s: F.lit(False)))

        def back(state: Column, x: Column):
            words = F.slice(F.concat(_next_words(x["r"], near, False), state), 1, near)
            return words, F.when(x["ok"], F.array(F.array_join(words, " "))).otherwise(no_words)

        left = _fold(all_, F.struct(F.lit(0).alias("at"), no_words.alias("words")), F.array().cast("array<struct<kind:string,start:int,end:int,value:string,left:string>>"), forth)
        right = F.reverse(_fold(F.reverse(all_), no_words, no_words, back))
        both = F.transform(F.arrays_zip(left.alias("s"), right.alias("right")), lambda x: F.struct(*[x["s"][f].alias(f) for f in ("kind", "start", "end", "value", "left")], x["right"].alias("right")))
        return F.when(F.exists(all_, lambda x: x["ok"]), both).otherwise(empty)

    return F.when(_may_have(kind, text), _once(checked, spans)).otherwise(empty)


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = 3) -> DataFrame:
    """(doc_id, text, base): the spans of all base kinds, by kind, then start, with ``near`` words on either side; null text is empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("base", F.concat(*[matches(k, F.col("text"), near) for k in KINDS]))


def revealing_terms(spans: DataFrame, words: DataFrame, min_contexts: int = 3, min_share: float = 0.5, min_bits: float = 4.0, near: int = 3) -> DataFrame:
    """Terms that give an entity away: entity, term, contexts, together, term_docs, entity_docs, share, bits.

    ``spans`` (doc_id, base), ``words`` (doc_id, term: the distinct words of each document), both over the whole corpus.  An
    entity is a kind and a normalised value.  A term near it (one of ``near`` words on either side) reveals it if the two meet in
    ``min_contexts`` different surroundings, if of all documents that have the term a share of ``min_share`` have it near the entity
    (p(entity | term)), and if that is ``min_bits`` bits above the entity's own share: log2(p(entity | term) / p(entity)).
    Document counts of terms are summed before they meet the candidates, so no join has a row per document.
    """
    one = spans.select("doc_id", F.explode("base").alias("s"))
    clean = lambda c: F.lower(F.regexp_replace(c, PATTERNS["email"], " 0 "))
    terms = lambda c: F.filter(F.split(clean(c), _TERM), lambda t: F.length(t) > 0)
    value = F.when(F.col("s.kind") == "email", F.lower("s.value")).when(F.col("s.kind") == "ip", F.col("s.value")).otherwise(_digits(F.col("s.value")))
    around = one.select("doc_id", F.concat_ws(":", F.col("s.kind"), value).alias("entity"), F.slice(F.reverse(terms(F.col("s.left"))), 1, near).alias("l"), F.slice(terms(F.col("s.right")), 1, near).alias("r"))
    around = around.withColumn("context", F.xxhash64("l", "r"))
    entities = around.groupBy("entity").agg(F.count_distinct("doc_id").alias("entity_docs"))
    met = around.select("doc_id", "entity", "context", F.explode(F.array_distinct(F.concat("l", "r"))).alias("term")).where(F.length("term") >= 3)
    met = met.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("doc_id").alias("together")).where(F.col("contexts") >= min_contexts)
    counts = words.groupBy("term").agg(F.count("*").alias("term_docs"))
    n = spans.count()
    scored = met.join(counts, "term").join(entities, "entity").withColumn("share", F.col("together") / F.col("term_docs"))
    scored = scored.withColumn("bits", F.log2(F.col("share") * F.lit(float(max(n, 1))) / F.col("entity_docs")))
    return stored(scored.where((F.col("share") >= min_share) & (F.col("bits") >= min_bits)), "revealing")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", literal_terms: int = 5000, **thresholds) -> DataFrame:
    """A row per document: doc_id, text, base and spans, arrays of {kind, start, end, value}; spans has the base ones and those of kind 'term'.

    Base kinds by pattern and check (see PATTERNS); terms by ``revealing_terms``, wherever in the corpus they stand, unless inside a
    base span.  Up to ``literal_terms`` of them are looked for in place; more are joined with the documents' words.  Null text is empty and has no spans.  Rows without an id have base spans only and count in no statistics; rows that repeat an id count as one document in the
    statistics and are searched each on its own.  Without entities there are no terms.
    """
    found = stored(base_spans(docs, id_col, text_col, thresholds.get("near", 3)).select("doc_id", "base", "text"), "base")
    known = found.where("doc_id is not null")
    words = known.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), _TERM))).alias("term")).where(F.length("term") >= 3)
    chosen = revealing_terms(known.select("doc_id", "base"), words, **thresholds).select("term").distinct()
    some = [r.term for r in chosen.limit(literal_terms + 1).collect()]
    if len(some) <= literal_terms:
        own = F.array_intersect(F.split(F.lower("text"), _TERM), F.array(*map(F.lit, sorted(some))).cast("array<string>"))
        joined = found.withColumn("terms", F.array_sort(own)) if some else found.withColumn("terms", F.lit(None).cast("array<string>"))
        joined = joined.withColumn("terms", F.when(F.col("doc_id").isNotNull() & (F.size("terms") > 0), F.col("terms")))
    else:
        held = words.join(chosen, "term").groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
        joined = found.join(held.select(F.col("doc_id").alias("_term_id"), "terms").hint("merge"), F.col("doc_id") == F.col("_term_id"), "left").drop("_term_id")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    hits, gaps = F.regexp_extract_all("text", pattern, F.lit(0)), F.split("text", pattern, -1)
    pairs = F.arrays_zip(hits.alias("m"), F.slice(gaps, 1, F.size(hits)).alias("l"))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def step(at: Column, x: Column):
        start = at + F.char_length(x["l"])
        end = start + F.char_length(x["m"])
        return end, F.array(F.struct(F.lit("term").alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("value")))

    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    terms = _fold(pairs, F.lit(0), empty, step)
    free = F.filter(terms, lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return joined.select("doc_id", "text", base.alias("base"), F.concat(base, F.when(F.col("terms").isNotNull(), free).otherwise(empty)).alias("spans"))


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitised(found: DataFrame) -> DataFrame:
    """(doc_id, text) of a ``find_private`` table: base spans are generalised to <KIND>, revealing terms are removed."""

    def step(at: Column, s: Column):
        gap = F.substring(F.col("text"), at + 1, F.greatest(s["start"] - at, F.lit(0)))
        tag = F.when((s["kind"] == "term") | (s["start"] < at), F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.greatest(at, s["end"]), F.array(gap, tag)

    # The end of the text stands as a last span, so that what follows the others comes along.
    last = F.char_length("text")
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    ordered = F.concat(ordered, F.array(F.struct(last.alias("start"), last.alias("end"), F.lit("term").alias("kind"))))
    pieces = _fold(ordered, F.lit(0), F.array().cast("array<string>"), step)
    return found.select("doc_id", F.when(F.size("spans") > 0, F.array_join(pieces, "")).otherwise(F.col("text")).alias("text"))

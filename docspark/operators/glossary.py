"""Glossaries: terms of several words found in texts, and target terms looked for in translations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as t
from .loops import stored

#: A text as words, single blanks and single other signs; joined they are the text again, its blanks made plain.
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]| "
WORD = r"[\p{L}\p{N}_]"
EAST_ASIAN = ("ja", "zh", "ko")


def tokens(c: Column) -> Column:
    return t.extract(t.norm_ws(c), TOKEN)


def forms(term: Column) -> Column:
    """The spellings of a term that count as its use: itself and English plurals of its last word, lower- and upper-case endings."""
    plain = t.norm_ws(term)
    y = plain.rlike(r"(?i)[^aeiou\s]y$")
    stem = F.left(plain, F.char_length(plain) - 1)
    plural = F.when(y, F.array(F.concat(stem, F.lit("ies")), F.concat(stem, F.lit("IES")))).otherwise(F.array(*[F.concat(plain, F.lit(e)) for e in ("s", "es", "S", "ES")]))
    return F.when(plain.rlike(r"\p{L}$"), F.concat(F.array(plain), plural)).otherwise(F.array(plain))


def _folded(words: Column, text: Column) -> Column:
    """A number per token of a text, the same for all its cases."""
    number = lambda plain: F.transform(words, lambda x: F.xxhash64(F.lower(plain(x))))
    return F.when(F.contains(text, F.lit("Σ")) | F.contains(text, F.lit("ς")), number(lambda x: F.translate(x, "Σς", "σσ"))).otherwise(number(lambda x: x))


def _spelled(terms: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(term, cased, form, _at, n (tokens), written to the shared folder; how many spellings have n tokens)."""
    cased = F.col("case_sensitive") if "case_sensitive" in terms.columns else F.lit(False)
    known = terms.where(F.trim("term") != "").groupBy("term").agg(F.bool_and(F.coalesce(cased, F.lit(False))).alias("cased"))
    spelled = known.select("term", "cased", F.explode(forms(F.col("term"))).alias("form")).withColumn("form", F.when(F.col("cased"), F.col("form")).otherwise(F.lower("form"))).distinct()
    spelled = spelled.withColumn("_t", tokens(F.col("form"))).select("term", "cased", "form", F.xxhash64(_folded(F.col("_t"), F.col("form"))).alias("_at"), F.size("_t").alias("n"))
    spelled = stored(spelled, "spellings")
    return spelled, {r["n"]: r["k"] for r in spelled.groupBy("n").agg(F.count("*").alias("k")).collect()}


def _places(units: DataFrame, key: list[str], text: str, sizes: list[int]) -> DataFrame:
    """A row per place in a text and number of tokens from it: key, _w (the text's tokens), start, m, _at.

    Tokens are read and folded once a text, the outer way (an inner explode has them worked out twice); from there to the join nothing but numbers is made.
    """
    rows = units.select(*key, F.col(text).alias("_text"), tokens(F.col(text)).alias("_w")).withColumn("_h", _folded(F.col("_w"), F.col("_text"))).select(*key, "_w", "_h", F.posexplode_outer("_h").alias("_k", "_x"))
    rows = rows.where(F.col("_x").isNotNull() & (F.col("_x") != F.xxhash64(F.lit(" "))))
    # The number of an array is that of its elements in turn.
    number = lambda n: F.xxhash64(*[F.get("_h", F.col("_k") + j) for j in range(n)]) if n <= 16 else F.xxhash64(F.slice("_h", F.col("_k") + 1, n))
    rows = rows.select(*key, "_w", (F.col("_k") + 1).alias("start"), F.explode(F.array(*[F.struct(F.lit(n).alias("m"), number(n).alias("_at")) for n in sizes])).alias("_x"))
    return rows.select(*key, "_w", "start", "_x.m", "_x._at").where(F.col("start") + F.col("m") - 1 <= F.size("_w"))


def _read(places: DataFrame) -> DataFrame:
    """Places with what they say in place of the text: matched, before and after (the tokens beside it)."""
    before, after = F.get("_w", F.col("start") - 2), F.get("_w", F.col("start") + F.col("m") - 1)
    return places.withColumns({"matched": F.array_join(F.slice("_w", F.col("start"), F.col("m")), ""), "before": before, "after": after}).drop("_w")


def _uses(met: DataFrame, key: list[str]) -> DataFrame:
    """Places that met a spelling's number, if they are that spelling and no part of a longer word: key, term, start, n, matched."""
    met = met.where("m = n").where(F.when(F.col("cased"), F.col("matched")).otherwise(F.lower("matched")) == F.col("form"))
    met = met.where(F.col("form").rlike(f"^{WORD}") | ~F.coalesce("before", F.lit("")).rlike(f"{WORD}$")).where(F.col("form").rlike(f"{WORD}$") | ~F.coalesce("after", F.lit("")).rlike(f"^{WORD}"))
    return met.select(*key, "term", "start", "n", "matched")


def texts_with_terms(texts: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """The distinct texts in which a term is used, as ``glossary_match`` finds them; for short texts and as many terms: both sides are sorted, nothing is sent to all tasks or passes the driver."""
    spelled, sizes = _spelled(terms)
    places = _read(_places(texts.select(text), [text], text, sorted(sizes) or [1]))
    return _uses(places.join(spelled.hint("merge"), "_at"), [text]).select(text).distinct()


def glossary_match(units: DataFrame, terms: DataFrame, key: list[str], text: str = "text", most_terms: int = 200_000) -> DataFrame:
    """Uses of glossary terms in units, without overlaps: key, term, start (the number of the first token, from 1), n (tokens), matched.

    terms: term and, if it is there, case_sensitive.  Words are whole, blanks between them may be any, the last word may be an English plural.  Where uses overlap, the one that starts
    first stays, of those that start together the longest (then the first term in order).  Null and empty texts and terms match nothing; equal terms count once, case-sensitive only if all of them are.

    Spellings meet texts by a number made of all their tokens, tried at every place in every length that spellings have, so a place meets only what is used there, however many terms begin with its
    word; spelling and neighbours are then compared.  Texts never travel, only uses do.  Up to ``most_terms`` spellings go to all tasks.  Of a larger glossary only the numbers do, twenty times as many at once, and
    the places that have one meet their spellings by sorting; each part of the numbers is done before the next is sent.  Overlaps are settled inside runs of overlapping uses, so a long unit is no long list.
    """
    spelled, sizes = _spelled(terms)
    total, most = sum(sizes.values()), max(most_terms, 1)
    places = _places(units, key, text, sorted(sizes) or [1])

    def found(part: int, parts: int) -> DataFrame:
        here = spelled.where(F.pmod("_at", F.lit(parts)) == part)
        some = _read(places.join(F.broadcast(here.select("_at").distinct()), "_at", "left_semi"))
        return stored(_uses(some.join(here.hint("merge"), "_at"), key), "uses")

    if total <= most:
        met = _uses(_read(places.join(F.broadcast(spelled), "_at").where("m = n")), key)
    else:
        parts = -(-total // (20 * most))
        met = reduce(DataFrame.unionAll, [found(k, parts) for k in range(parts)])
    along = W.partitionBy(*key).orderBy("start", F.desc("n"), "term")
    runs = met.withColumn("_reach", F.max(F.col("start") + F.col("n")).over(along.rowsBetween(W.unboundedPreceding, -1)))
    runs = runs.withColumn("_run", F.sum(F.when(F.col("start") < F.col("_reach"), 0).otherwise(1)).over(along.rowsBetween(W.unboundedPreceding, 0)))
    uses = F.sort_array(F.collect_list(F.struct("start", (-F.col("n")).alias("m"), "term", "n", "matched")))
    keep = lambda acc, u: F.when(u["start"] >= acc["end"], F.struct((u["start"] + u["n"]).alias("end"), F.array_append(acc["kept"], u).alias("kept"))).otherwise(acc)
    settled = F.when(F.size("_u") == 1, F.col("_u")).otherwise(F.aggregate("_u", F.struct(F.lit(0).alias("end"), F.slice("_u", 1, 0).alias("kept")), keep, lambda acc: acc["kept"]))
    return runs.groupBy(*key, "_run").agg(uses.alias("_u")).select(*key, F.explode_outer(settled).alias("u")).select(*key, "u.term", "u.start", "u.n", "u.matched")


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([^\p{L}\p{N}_\s])", r"\\$1")


def _ending(word: Column, short: str, long: str) -> Column:
    """A pattern of a word whose ending may change: from five letters on its last letter may differ (from seven on the last two), then up to ``long`` letters may follow; up to ``short`` after a shorter one."""
    size = F.char_length(word)
    cut = F.left(word, size - F.when(size >= 7, 2).otherwise(1))
    return F.when(~word.rlike(r"\p{L}$"), _escaped(word)).when(size <= 4, F.concat(_escaped(word), F.lit(short))).otherwise(F.concat(_escaped(cut), F.lit(long)))


def _squashed(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def term_present(translation: Column, term: Column, language: Column) -> Column:
    """Whether a translation uses a term, both folded (``unicode_fold``): every word may change its ending, words may be joined by a hyphen, the last may go on, and a single word of six letters or
    more may end a longer one.  In East Asian languages: contained, blanks aside.  A blank term is there; null translations use nothing."""
    words = F.split(F.trim(term), r"\s+")
    last = F.element_at(words, -1)
    size = F.char_length(last)
    body = F.left(last, size - F.when(size >= 7, 2).when(size > 4, 1).otherwise(0))
    front = F.transform(F.slice(words, 1, F.size(words) - 1), lambda w: _ending(w, r"\w{0,3}", r"\w{0,4}"))
    pattern = F.concat(F.lit("(?U)"), F.when((F.size(words) == 1) & (size >= 6), "").otherwise(r"(?<!\w)"), F.array_join(F.concat(front, F.array(F.concat(_escaped(body), F.lit(r"\w*")))), r"[\s-]+"))
    found = F.when(language.isin(*EAST_ASIAN), F.contains(_squashed(translation), _squashed(term))).otherwise(F.rlike(translation, pattern))
    return F.when(F.trim(term) == "", True).otherwise(F.coalesce(found, F.lit(False)))


def target_present(translation: Column, term: Column, language: Column, do_not_translate: Column) -> Column:
    """Whether a translation uses a glossary's target term, both folded: whole words, of which the last may change its ending; a term that isn't translated must stand as it is."""
    words = F.split(F.trim(term), r"\s+")
    front = F.transform(F.slice(words, 1, F.size(words) - 1), _escaped)
    last = F.when(do_not_translate, _escaped(F.element_at(words, -1))).otherwise(_ending(F.element_at(words, -1), r"\w{0,2}", r"\w{0,4}"))
    pattern = F.concat(F.lit(r"(?U)(?<!\w)"), F.array_join(F.concat(front, F.array(last)), r"\s+"), F.lit(r"(?!\w)"))
    found = F.when(language.isin(*EAST_ASIAN) & ~do_not_translate, F.contains(_squashed(translation), _squashed(term))).otherwise(F.rlike(translation, pattern))
    return F.when(F.trim(term) == "", True).otherwise(F.coalesce(found, F.lit(False)))

"""Terms: phrase mining, spellings, glossary matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import glossary
from .loops import stored


# Words that no term holds.
NO_TERM = """
    a an the and or nor but of to in on at by for from with without within into onto over under as per via than then that this these those it its they them their there here which who whom whose what
    when where why how if whether is are was were be been being am has have had do does did must shall should may might can could will would not no all any each every some such both either neither
    only also other another more most less least very so e.g i.e etc according based using used one two three new same further following include includes including require requires required
""".split()
#: What ends a chunk, and a word inside one.
BREAK = r"""[.,;:!?()\[\]{}"“”„|/–—]|\s-\s"""
WORD = r"[\p{L}\p{N}](?:[\p{L}\p{N}_&'’-]*[\p{L}\p{N}])?"


def singular(word: Column) -> Column:
    """An English plural's singular; words of up to three letters, abbreviations in capitals and words in -ss, -us and -is stay."""
    stays = (F.char_length(word) <= 3) | ~word.rlike(r"\p{Ll}") | ~word.rlike("s$") | word.rlike("[sui]s$")
    short = lambda n: F.left(word, F.char_length(word) - n)
    return F.when(word.rlike(r"\p{Ll}") & word.rlike("ies$") & (F.char_length(word) > 3), F.concat(short(3), F.lit("y"))).when(stays, word).otherwise(short(1))


def _inner(size: int) -> list[tuple[int, int]]:
    """The parts (first word from 0, number of words) of a phrase that end before its last word."""
    return [(first, n) for n in range(2, size) for first in range(size - n)]


def _phrases(texts: DataFrame, most: int, text: str, signed: bool = True) -> DataFrame:
    """A row per distinct text: ``_p``, its phrases, each once; ``signed``: behind a sign per part of ``_inner``, 1 if the text has that part as a phrase of its own, and a colon.

    A part that ends in a word without plural stands where the phrase stands.  Only one that ends in a plural (a phrase's last word is singular) has to be looked for in the text, and only if the text has
    a phrase that may end so.  What a text says is worked out in its row; breaks stay between the words as words that no phrase holds.
    """
    stop = lambda c: c.isin(NO_TERM)
    letter = lambda c: c.rlike(r"\p{L}")
    rows = texts.select(text).where(F.col(text).isNotNull()).distinct()
    rows = rows.select(F.transform(t.extract(F.col(text), f"{WORD}|{BREAK}"), lambda w: F.struct(F.lower(w).alias("w"), F.lower(F.when(F.endswith(w, F.lit("s")), singular(w)).otherwise(w)).alias("last"))).alias("_w"))
    rows = rows.select(F.transform("_w", lambda x: F.struct(x["w"], x["last"], (letter(x["w"]) & ~stop(x["w"])).alias("good"), (letter(x["last"]) & ~stop(x["last"])).alias("ends"), (x["w"] == x["last"]).alias("same"))).alias("_w"))
    at = lambda k, j: F.get("_w", (k + j).cast("int"))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("_w") - 2, F.lit(0))), lambda k: F.get("_w", k)["good"])

    def every(tests: list[Column]) -> Column:
        out = tests[0]
        for c in tests[1:]:
            out = out & c
        return out

    def said(k: Column, n: int, last: str) -> Column:
        return F.concat_ws(" ", *[at(k, j)["w"] for j in range(n - 1)], at(k, n - 1)[last])

    def listed(one) -> Column:
        return F.array_distinct(F.array_compact(F.flatten(F.transform(starts, lambda k: F.array(*one(k))))))

    def signs(k: Column, n: int) -> list[Column]:
        return [F.when(at(k, first + size - 1)["same"] | (F.col("_odd") & F.array_contains("_found", said(k + first, size, "w"))), "1").otherwise("0") for first, size in _inner(n)]

    whole = lambda k, n: every([at(k, j)["good"] for j in range(1, n - 1)] + [at(k, n - 1)["ends"]])
    plural = lambda k, n: every([at(k, j)["good"] for j in range(1, n)] + [~at(k, n - 1)["same"]])
    if not signed:
        return rows.select(listed(lambda k: [F.when(whole(k, n), said(k, n, "last")) for n in range(2, most + 1)]).alias("_p"))
    odd = F.arrays_overlap(F.transform(F.filter("_w", lambda x: ~x["same"]), lambda x: x["w"]), F.transform("_w", lambda x: x["last"]))
    rows = rows.withColumn("_odd", odd)
    if most > 2:
        plain = listed(lambda k: [F.when(whole(k, n), said(k, n, "last")) for n in range(2, most)])
        ends = listed(lambda k: [F.when(plural(k, n), said(k, n, "w")) for n in range(2, most)])
        rows = rows.withColumn("_found", F.when(F.col("_odd"), F.array_intersect(ends, plain)).otherwise(F.array().cast("array<string>")))
    return rows.select(listed(lambda k: [F.when(whole(k, n), F.concat(*signs(k, n), F.lit(":"), said(k, n, "last"))) for n in range(2, most + 1)]).alias("_p"))


def _per_phrase(texts: DataFrame, most: int, text: str) -> DataFrame:
    """Every phrase of the texts: term, size, n_texts and, for each part of ``_inner``, in how many of them it is a phrase too (_n0, _n1 and so on).  The one shuffle of phrases, summed up in tasks before."""
    # An inner explode would have its phrases worked out once more, before, to find texts without any.
    each = _phrases(texts, most, text).select(F.explode_outer("_p").alias("_p")).where(F.col("_p").isNotNull())
    colon = F.locate(":", F.col("_p"))
    each = each.select(F.substr("_p", colon + 1).alias("term"), F.left("_p", colon - 1).alias("_s"))
    counts = each.groupBy("term").agg(F.count("*").alias("n_texts"), *[F.count_if(F.substring("_s", j + 1, 1) == "1").alias(f"_n{j}") for j in range(len(_inner(most)))])
    return counts.withColumn("size", F.regexp_count("term", F.lit(" ")) + 1)


def phrase_grams(texts: DataFrame, most: int = 4, text: str = "text") -> DataFrame:
    """The phrases of the distinct texts: term, size, n_texts (texts that have it).

    2 to ``most`` words of one chunk, lower-cased, the last one singular, none of them in ``NO_TERM`` or without a letter.
    """
    each = _phrases(texts, most, text, signed=False).select(F.explode_outer("_p").alias("term")).where(F.col("term").isNotNull())
    return each.groupBy("term").agg(F.count("*").alias("n_texts")).select("term", (F.regexp_count("term", F.lit(" ")) + 1).alias("size"), "n_texts")


def phrase_counts(units: DataFrame, min_texts: int = 3, covered: float = 0.75, most: int = 4, text: str = "text") -> DataFrame:
    """Terms of 2 to ``most`` words in ``min_texts`` distinct texts or more: term, size, n_texts.

    A term goes if a longer one, itself frequent, contains it and is in ``covered`` of its texts or more.  A text says of each of its phrases which parts of it are phrases of that text, so both come out of
    the same sums; only frequent phrases, written to the shared folder, meet their parts.
    """
    counts = stored(_per_phrase(units, most, text).where(F.col("n_texts") >= min_texts), "phrases")
    words = F.split("term", " ")
    parts = []
    for size in range(3, most + 1):
        inner = _inner(size)
        for n in range(2, size):
            parts += [F.when(F.col("size") == size, F.struct(F.array_join(F.slice(words, first + 1, n), " ").alias("term"), (F.col(f"_n{inner.index((first, n))}") if first + n < size else F.col("n_texts")).alias("n"))) for first in range(size - n + 1)]
    counted = counts.select("term", "size", "n_texts")
    if not parts:
        return counted
    shared = counts.where("size > 2").select(F.explode(F.array_compact(F.array(*parts))).alias("p")).where("p.n > 0").groupBy("p.term").agg(F.max("p.n").alias("_most"))
    return counted.join(shared.hint("merge"), "term", "left").where(F.col("_most").isNull() | (F.col("_most") < covered * F.col("n_texts"))).drop("_most")


def find_terms(counts: DataFrame, known: DataFrame) -> DataFrame:
    """Counted terms in which no known term is used (whole words, plurals too); known: term."""
    used = glossary.texts_with_terms(counts.select(F.col("term").alias("phrase")), known, "phrase")
    return counts.join(used.select(F.col("phrase").alias("term")).hint("merge"), "term", "left_anti")


def mode_form(forms: DataFrame, key: Column, name: str, form: str = "form") -> DataFrame:
    """The most frequent form of each key, the first in order among ties: key, form, n."""
    counts = forms.groupBy(key.alias(name), form).agg(F.count("*").alias("n"))
    best = counts.groupBy(name).agg(F.min(F.struct((-F.col("n")).alias("m"), form)).alias("b"))
    return best.select(name, F.col(f"b.{form}").alias(form), (-F.col("b.m")).alias("n"))

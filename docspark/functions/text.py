"""Text as columns: canonical forms, hashes, extraction, tests.  Patterns avoid look-around, so other engines can run them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

STOP = tuple(fixed.STOP)
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+"
URL = r"https?://[^\s)>\]]+"
# The bodies whose standards are cited by number.
STANDARDS = ("ISO", "IEC", "ICH", "EN", "USP", r"Ph\.\s?Eur\.")
DOC_ID = r"[A-Z][A-Z0-9]{0,6}(?:-[A-Z0-9]{1,10}){2,6}"
#: Ids of documents: dashed capitals with a digit somewhere, number-letters-number, standards, paragraphs of the federal code.
DOCUMENT_IDS = (
    r"\b(?:(?=[A-Z0-9-]*[0-9])" + DOC_ID + r"|[0-9]{2,4}-[A-Z]{2,6}-[0-9]{2,6}(?:-[A-Z0-9]{1,8})*"
    + rf"|(?:{'|'.join(STANDARDS)})\s?[A-Z]?[0-9]+[A-Z]?(?:[-:.][0-9]+)*" + r"|[0-9]+\s+CFR\s+(?:Part\s+)?[0-9]+(?:\.[0-9]+)*)\b"
)
PERCENT = r"[0-9]+(?:\.[0-9]+)?\s*%"
NUMBER = r"[0-9]+(?:[.,' ][0-9]{3})*"
REF_TOKEN = r"\{\{ref:[^}]*\}\}"
#: What stands in front of a list item: a number or a letter with an opening or closing mark, or a sign.
_NUMBERED = "|".join(rf"\(?{body}{close}" for body in ("[0-9]{1,2}", "[a-zA-Z]") for close in (r"\.", r"\)"))
LIST_MARKER = rf"^\s*(?:{_NUMBERED}|[{fixed.LIST_SIGNS}])\s+"
HEADING_NUMBER = r"^\s*[0-9]+(?:\.[0-9]+)*\.?\s+"
#: Risk cues: tag and pattern.
RISK = (
    ("safety", r"(?i)\b(?:safety|hazard|danger|injur|toxic|flammable)"), ("approval", r"(?i)\b(?:approv|sign.?off|authori[sz])"),
    ("retention", r"(?i)\b(?:retain|retention|archiv|destroy)"), ("escalation", r"(?i)\b(?:escalat|immediately)"), ("numeric_limit", r"[<>≤≥±]\s*[0-9]"),
)


def norm_ws(c: Column) -> Column:
    """Runs of blanks become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_lower(c: Column) -> Column:
    return F.lower(norm_ws(c))


def norm_alnum(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def content_hash(path: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(path, F.lit("|"), norm_lower(text)), 256), 1, 16)


def issue_id(*parts: Column) -> Column:
    """Stable across runs: the check, what it is about, and the ids it names."""
    return F.concat(F.lit("ISS-"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 10))


def clean_text(c: Column) -> Column:
    """Without reference tokens, heading number and list marker; dashes and hard spaces made plain."""
    c = F.regexp_replace(c, REF_TOKEN, " ")
    c = F.translate(c, " –—‑", " ---")
    return F.regexp_replace(F.regexp_replace(c, r"^\s*[0-9]+(?:\.[0-9]+)+\s+", ""), LIST_MARKER, "")


def emails_urls(c: Column) -> Column:
    """E-mail addresses and URLs in order, lower-cased, without punctuation at the end."""
    found = F.concat(F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0)), F.regexp_extract_all(c, F.lit(URL), F.lit(0)))
    return F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"[.,;]+$", "")))


def extract(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def number_value(c: Column) -> Column:
    """Digits with thousands separators and leading zeros removed, as text."""
    bare = F.regexp_replace(c, r"[.,' ]", "")
    short = F.regexp_replace(bare, r"^0+", "")
    return F.when(short == "", F.lit("0")).otherwise(short)


def neutral_numbers(c: Column) -> Column:
    """Numbers that no letter precedes, language-neutral."""
    return F.transform(extract(c, r"(?:^|[^\p{L}0-9])([0-9]+(?:[.,' ][0-9]{3})*)", 1), number_value)


def sentences(c: Column) -> Column:
    """Split after . ! ? ; where a capital, digit or quote follows."""
    marked = F.regexp_replace(norm_ws(c), r"([.!?;]) ([\p{Lu}0-9\"“(])", "$1\u0001$2")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")


def words(c: Column) -> Column:
    return extract(F.lower(c), r"\p{L}+")


def stem(c: Column) -> Column:
    ies = F.char_length(c) > 4
    s = (F.char_length(c) > 3) & c.endswith("s") & ~c.endswith("ss")
    return F.when(ies & c.endswith("ies"), F.concat(F.left(c, F.char_length(c) - 3), F.lit("y"))).when(s, F.left(c, F.char_length(c) - 1)).otherwise(c)


def tokens(c: Column) -> Column:
    """Lower-case a-z words, stop words out, stemmed."""
    stop = F.array(*[F.lit(x) for x in STOP])
    return F.transform(F.filter(extract(F.lower(c), "[a-z]+"), lambda w: ~F.array_contains(stop, w)), stem)


def name_score(heading: Column, alias: Column) -> Column:
    """1 for equal token sets; .55 + .4 x heading's share if all of the alias is in it; else .4 x Jaccard."""
    a, b = F.array_distinct(heading), F.array_distinct(alias)
    common, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when(common == union, 1.0).when(common == F.size(b), 0.55 + 0.4 * common / F.size(a)).otherwise(0.4 * common / union)


def syllables(word: Column) -> Column:
    """Runs of vowels, a run of more than two counted by pairs, at least one; words of up to three letters have one.

    What isn't spoken doesn't count: -ed, -es and -e after most consonants, and a y that opens the word.
    """
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    size = F.char_length(letters)
    at = lambda k: F.substring(letters, size - k, F.lit(1))
    silent = lambda k: ~at(k).isin(*fixed.SPOKEN_BEFORE_E)
    e_s = (at(1) == "e") & (at(0) == "s") & silent(2)
    cut = F.when(F.endswith(letters, F.lit("ed")) | e_s, 2).when((at(0) == "e") & silent(1), 1).otherwise(0)
    first = F.when(F.startswith(letters, F.lit("y")), 2).otherwise(1)
    spoken = F.substring(letters, first, size - cut - first + 1)
    runs = F.transform(F.split(spoken, f"[^{fixed.VOWELS}]+"), lambda run: F.floor((F.char_length(run) + 1) / 2))
    return F.when(size <= 3, 1).otherwise(F.greatest(F.lit(1), F.aggregate(runs, F.lit(0).cast("long"), lambda n, k: n + k)))


def is_passive(sentence: Column) -> Column:
    """Whether a form of be is followed, with at most an adverb in -ly between, by a participle."""
    tokens = F.split(F.lower(sentence), r"\s+")
    be, participle = "|".join(fixed.BE), "|".join(fixed.PARTICIPLES)

    def found(kinds: Column) -> Column:
        word = lambda k: F.get(kinds, k)
        opens = F.filter(F.sequence(F.lit(0), F.size(kinds) - 1), lambda k: word(k)["be"])
        return F.exists(opens, lambda k: F.coalesce(word(k + 1)["done"] | (word(k + 1)["ly"] & word(k + 2)["done"]), word(k + 1)["done"], F.lit(False)))

    kinds = F.transform(tokens, lambda w: F.struct(w.rlike(rf"(?:^|\W)(?:{be})$").alias("be"), w.rlike(r"^\w+ly$").alias("ly"), w.rlike(rf"^(?:\w+ed|{participle})(?:$|\W)").alias("done")))
    return F.coalesce(F.element_at(F.transform(F.array(kinds), found), 1), F.lit(False))


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.char_length(c) / 4) + 1


def lead_sentence(c: Column) -> Column:
    """The first sentence if shorter than 180 characters, else the first 140."""
    first = F.element_at(sentences(c), 1)
    return F.when(F.char_length(first) < 180, first).otherwise(F.left(norm_ws(c), F.lit(140)))


def risk_tags(c: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(t)) for t, p in RISK]))


def paragraph_type(c: Column) -> Column:
    return F.when(c.rlike(r"(?i)^\s*(?:figure|table)\s+[0-9]"), "caption").when(c.rlike(r"(?i)^\s*(?:warning|caution)\b"), "warning").when(c.rlike(r"(?i)^\s*note\b"), "note").otherwise("paragraph")


def multiset_minus(a: Column, b: Column) -> Column:
    """What array a has more often than b, each value as often as it is in excess, sorted."""
    values = F.array_sort(F.array_distinct(a))
    more = lambda v: F.size(F.filter(a, lambda x: x == v)) - F.size(F.filter(b, lambda x: x == v))
    return F.flatten(F.transform(values, lambda v: F.array_repeat(v, F.greatest(more(v), F.lit(0)))))


def latin_share(c: Column) -> Column:
    letters = F.char_length(F.regexp_replace(c, r"[^\p{L}]", ""))
    latin = F.char_length(F.regexp_replace(c, r"[^A-Za-z\x{C0}-\x{24F}]", ""))
    return F.when(letters > 0, latin / letters).otherwise(0.0)


def roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999."""
    out = F.lit("")
    for scale, one, five, ten in ((1000, "M", "", ""), (100, "C", "D", "M"), (10, "X", "L", "C"), (1, "I", "V", "X")):
        d = F.floor(n / scale) % 10
        rep = lambda s, k: F.repeat(F.lit(s), k.cast("int"))
        part = F.when(d <= 3, rep(one, d)).when(d == 4, one + five).when(d <= 8, F.concat(F.lit(five), rep(one, d - 5))).otherwise(one + ten)
        out = F.concat(out, part)
    return out


def is_blue(hex6: Column) -> Column:
    """Whether a colour's blue clearly exceeds its red and green."""
    r, g, b = (F.conv(F.substring(hex6, k, 2), 16, 10).cast("int") for k in (1, 3, 5))
    return (b >= 128) & (b > r + 40) & (b > g + 40)

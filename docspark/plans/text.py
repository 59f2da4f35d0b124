"""Queries over units: forms, hashes, extraction, style."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as t
from ..operators import terms
from . import inputs as i
from .registry import query

U = f"WITH {i.UNITS}"
WS = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
STOP = "[" + ", ".join(f"'{w}'" for w in t.STOP) + "]"


def ws(x):
    return WS.format(x)


@query(f"{U} SELECT doc_id, seq, text FROM units")
def a4_text_lines(spark, sf):
    return i.units(spark, sf).select("doc_id", "seq", "text")


@query(f"WITH {i.ELEMENTS} SELECT doc_id, seq, kind, text FROM elements")
def a3_html_blocks(spark, sf):
    return i.elements(spark, sf)


@query(f"WITH {i.ELEMENTS} SELECT seq, kind, text FROM elements WHERE doc_id = 7")
def b8_page_filter(spark, sf):
    return i.elements(spark, sf).where("doc_id = 7").select("seq", "kind", "text")


@query(f"{U} SELECT doc_id, seq, {ws('text')} AS ws, lower({ws('text')}) AS low, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS alnum FROM units")
def b1_norm_forms(spark, sf):
    c = F.col("text")
    return i.units(spark, sf).select("doc_id", "seq", t.norm_ws(c).alias("ws"), t.norm_lower(c).alias("low"), t.norm_alnum(c).alias("alnum"))


@query(f"{U} SELECT doc_id, seq, substr(sha256(source || '|' || lower({ws('text')})), 1, 16) AS content_hash FROM units")
def b2_content_hash(spark, sf):
    return i.units(spark, sf).select("doc_id", "seq", t.content_hash(F.col("source"), F.col("text")).alias("content_hash"))


@query(f"WITH {i.ISSUES} SELECT issue_id, 'ISS-' || substr(sha1(concat_ws('|', severity, gate, issue_id)), 1, 10) AS stable_id FROM issues")
def b3_issue_id(spark, sf):
    return i.issues(spark, sf).select("issue_id", t.issue_id(F.col("severity"), F.col("gate"), F.col("issue_id")).alias("stable_id"))


@query(rf"""{U} SELECT doc_id, seq, regexp_replace(regexp_replace(translate(regexp_replace(text, '{t.REF_TOKEN}', ' ', 'g'), chr(160) || '–—‑', ' ---'), '^\s*[0-9]+(?:\.[0-9]+)+\s+', ''), '{t.LIST_MARKER}', '') AS text FROM units""")
def h1_clean_text(spark, sf):
    return i.units(spark, sf).select("doc_id", "seq", t.clean_text(F.col("text")).alias("text"))


def _found(name, pattern, doc):
    quoted = pattern.replace("'", "''")

    @query(f"{U} SELECT doc_id, seq, array_to_string(regexp_extract_all(text, '{quoted}'), ' ') AS found FROM units WHERE regexp_matches(text, '{quoted}')", name=name)
    def run(spark, sf):
        c = F.col("text")
        return i.units(spark, sf).where(c.rlike(pattern)).select("doc_id", "seq", F.array_join(t.extract(c, pattern), " ").alias("found"))

    run.__doc__ = doc


_found("h3_doc_ids", t.DOC_ID, "Document ids.")
_found("h7_percentages", t.PERCENT, "Percentages.")
_found("h8_numbers", t.NUMBER, "Numbers.")


@query(rf"""{U}, f AS (SELECT doc_id, seq, unnest(list_concat(regexp_extract_all(text, '{t.EMAIL}'), regexp_extract_all(text, '{t.URL}'))) AS x FROM units)
SELECT doc_id, seq, lower(regexp_replace(x, '[.,;]+$', '')) AS value FROM f""")
def h2_emails_urls(spark, sf):
    return i.units(spark, sf).select("doc_id", "seq", F.explode(t.emails_urls(F.col("text"))).alias("value"))


NUMS = r"list_transform(regexp_extract_all({}, '(?:^|[^\p{{L}}0-9])([0-9]+(?:[.,'' ][0-9]{{3}})*)', 1), lambda x: coalesce(nullif(regexp_replace(regexp_replace(x, '[.,'' ]', '', 'g'), '^0+', ''), ''), '0'))"


@query(f"{U}, n AS (SELECT doc_id, seq, {NUMS.format('text')} AS ns FROM units) SELECT doc_id, seq, array_to_string(ns, ' ') AS numbers FROM n WHERE len(ns) > 0")
def h36_neutral_numbers(spark, sf):
    n = i.units(spark, sf).select("doc_id", "seq", t.neutral_numbers(F.col("text")).alias("ns"))
    return n.where(F.size("ns") > 0).select("doc_id", "seq", F.array_join("ns", " ").alias("numbers"))


SENT = rf"""list_filter(string_split(regexp_replace({ws('{}')}, '([.!?;]) ([\p{{{{Lu}}}}0-9"“(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: s <> '')"""


@query(f"SELECT doc_id, len({SENT.format('text')})::BIGINT AS n_sentences, sha256(array_to_string({SENT.format('text')}, chr(2))) AS digest FROM documents")
def h12_sentences(spark, sf):
    s = t.sentences(F.col("text"))
    return i.table(spark, sf, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.sha2(F.array_join(s, "\u0002"), 256).alias("digest"))


STEM = "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END"
TOK = f"list_transform(list_filter(regexp_extract_all(lower({{}}), '[a-z]+'), lambda w: NOT list_contains({STOP}, w)), lambda w: {STEM})"


@query(f"{U} SELECT doc_id, seq, array_to_string({TOK.format('text')}, ' ') AS tokens FROM units")
def h22_tokens(spark, sf):
    return i.units(spark, sf).select("doc_id", "seq", F.array_join(t.tokens(F.col("text")), " ").alias("tokens"))


@query(f"""WITH p AS (SELECT p_partkey, list_distinct({TOK.format('p_name')}) AS a, list_distinct({TOK.format('p_type')}) AS b FROM part),
s AS (SELECT p_partkey, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS c, len(list_distinct(list_concat(a, b))) AS u FROM p)
SELECT p_partkey, CASE WHEN na = 0 OR nb = 0 THEN 0.0::DOUBLE WHEN c = u THEN 1.0::DOUBLE WHEN c = nb THEN 0.55::DOUBLE + 0.4::DOUBLE * c / na ELSE 0.4::DOUBLE * c / u END AS score FROM s""")
def h23_name_score(spark, sf):
    return i.table(spark, sf, "part").select("p_partkey", t.name_score(t.tokens(F.col("p_name")), t.tokens(F.col("p_type"))).alias("score"))


@query(f"{U} SELECT doc_id, seq, regexp_replace(text, '{t.LIST_MARKER}', '') AS item, regexp_matches(text, '{t.LIST_MARKER}') AS is_item, regexp_extract(text, '{t.HEADING_NUMBER}') AS number FROM units")
def h30_list_prefix(spark, sf):
    c = F.col("text")
    return i.units(spark, sf).select("doc_id", "seq", F.regexp_replace(c, t.LIST_MARKER, "").alias("item"), c.rlike(t.LIST_MARKER).alias("is_item"), F.regexp_extract(c, t.HEADING_NUMBER, 0).alias("number"))


@query(rf"""{U} SELECT CASE WHEN regexp_matches(text, '(?i)^\s*(?:figure|table)\s+[0-9]') THEN 'caption' WHEN regexp_matches(text, '(?i)^\s*(?:warning|caution)\b') THEN 'warning'
WHEN regexp_matches(text, '(?i)^\s*note\b') THEN 'note' ELSE 'paragraph' END AS kind, lang, count(*) AS n FROM units GROUP BY 1, 2""")
def h28_paragraph_type(spark, sf):
    return i.units(spark, sf).groupBy(t.paragraph_type(F.col("text")).alias("kind"), "lang").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, lower(regexp_replace(regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) || '_' || coalesce(nullif(lower(c_mktsegment), ''), 'untitled') || '_v' || (c_custkey % 5 + 1) AS document_id FROM customer")
def h33_document_id(spark, sf):
    name = F.lower(F.regexp_replace(F.regexp_replace("c_name", "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return i.table(spark, sf, "customer").select("c_custkey", F.concat(name, F.lit("_"), F.coalesce(F.nullif(F.lower("c_mktsegment"), F.lit("")), F.lit("untitled")), F.lit("_v"), (F.col("c_custkey") % 5 + 1).cast("string")).alias("document_id"))


SYL = "CASE WHEN length(regexp_replace(lower({w}), '[^a-z]', '', 'g')) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(lower({w}), '[^a-z]', '', 'g'), '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy]{{1,2}}'))) END"


@query(f"{U}, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM units) SELECT word, ({SYL.format(w='word')})::INTEGER AS syllables FROM w")
def h44_syllables(spark, sf):
    w = i.units(spark, sf).select(F.explode(t.extract(F.lower("text"), "[a-z]+")).alias("word")).distinct()
    return w.select("word", t.syllables(F.col("word")).cast("int").alias("syllables"))


PASSIVE = r"(?i)(?:^|\W)(?:is|are|was|were|be|been|being)\s+(?:\w+ly\s+)?(?:\w+ed|" + "|".join(fixed.PARTICIPLES) + r")(?:$|\W)"


@query(rf"""WITH s AS (SELECT lang, unnest({SENT.format('text')}) AS s FROM documents), n AS (SELECT lang, len(regexp_extract_all(lower(s), '\p{{L}}+')) AS w, regexp_matches(s, '{PASSIVE}') AS p FROM s)
SELECT lang, count(*) AS n_sentences, sum(w)::BIGINT AS n_words, count(*) FILTER (p) AS n_passive, sum(w) / count(*) AS words_per_sentence, count(*) FILTER (p) / count(*) AS passive_share, count(*) FILTER (w > 25) AS n_long FROM n GROUP BY lang""")
def d15_style_scores(spark, sf):
    s = i.table(spark, sf, "documents").select("lang", F.explode(t.sentences(F.col("text"))).alias("s"))
    n = s.select("lang", F.size(t.words(F.col("s"))).alias("w"), t.is_passive(F.col("s")).alias("p"))
    out = n.groupBy("lang").agg(F.count("*").alias("n_sentences"), F.sum("w").alias("n_words"), F.count_if("p").alias("n_passive"), F.count_if(F.col("w") > 25).alias("n_long"))
    return out.select("lang", "n_sentences", "n_words", "n_passive", (F.col("n_words") / F.col("n_sentences")).alias("words_per_sentence"), (F.col("n_passive") / F.col("n_sentences")).alias("passive_share"), "n_long")


@query(f"WITH s AS (SELECT doc_id, text, {SENT.format('text')}[1] AS f FROM documents) SELECT doc_id, CASE WHEN length(f) < 180 THEN f ELSE left({ws('text')}, 140) END AS lead, (length(text) // 4 + 1)::BIGINT AS tokens FROM s")
def h49_lead_sentence(spark, sf):
    return i.table(spark, sf, "documents").select("doc_id", t.lead_sentence(F.col("text")).alias("lead"), t.estimate_tokens(F.col("text")).alias("tokens"))


RISKS = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in t.RISK)


@query(f"{U}, r AS (SELECT doc_id, seq, list_filter([{RISKS}], lambda x: x IS NOT NULL) AS tags FROM units) SELECT doc_id, seq, array_to_string(tags, ' ') AS tags FROM r WHERE len(tags) > 0")
def h18_risk_tags(spark, sf):
    r = i.units(spark, sf).select("doc_id", "seq", t.risk_tags(F.col("text")).alias("tags"))
    return r.where(F.size("tags") > 0).select("doc_id", "seq", F.array_join("tags", " ").alias("tags"))


@query("""WITH d AS (SELECT p_partkey, p_partkey % 3999 + 1 AS n FROM part)
SELECT p_partkey, repeat('M', (n // 1000)::INT) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] AS roman,
chr((97 + n % 26)::INT) AS letter FROM d""")
def h52_roman(spark, sf):
    n = F.col("p_partkey") % 3999 + 1
    return i.table(spark, sf, "part").select("p_partkey", t.roman(n).alias("roman"), F.chr(97 + n % 26).alias("letter"))


@query("""WITH h AS (SELECT doc_id, substr(md5(doc_id::VARCHAR), 1, 6) AS hex FROM documents), c AS (SELECT doc_id, hex, ('0x' || substr(hex, 1, 2))::INT AS r, ('0x' || substr(hex, 3, 2))::INT AS g, ('0x' || substr(hex, 5, 2))::INT AS b FROM h)
SELECT doc_id, hex, b >= 128 AND b > r + 40 AND b > g + 40 AS blue FROM c""")
def h48_is_blue(spark, sf):
    return i.table(spark, sf, "documents").select("doc_id", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6).alias("hex")).withColumn("blue", t.is_blue(F.col("hex")))


@query(f"{U}, w AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Z]{{2,}}')) AS ids FROM units) SELECT doc_id, sum(len(ids))::BIGINT AS n_ids FROM w GROUP BY 1 HAVING sum(len(ids)) > 0")
def h51_ids_in_text(spark, sf):
    w = i.units(spark, sf).select("doc_id", F.size(F.array_distinct(t.extract(F.col("text"), "[A-Z]{2,}"))).alias("n"))
    return w.groupBy("doc_id").agg(F.sum("n").alias("n_ids")).where("n_ids > 0")


# Terms of two to four words.
def _q(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


SINGULAR = r"CASE WHEN length(w) <= 3 OR NOT regexp_matches(w, '\p{Ll}') OR NOT ends_with(w, 's') THEN w WHEN ends_with(w, 'ies') THEN w[:-4] || 'y' WHEN regexp_matches(w, '(ss|us|is)$') THEN w ELSE w[:-2] END"
GRAMS = rf"""{U}, tx AS (SELECT text, row_number() OVER () AS t FROM (SELECT DISTINCT text FROM units)), ck AS (SELECT t, regexp_extract_all(c, '{terms.WORD.replace("'", "''")}') AS ws FROM (SELECT t, unnest(regexp_split_to_array(text, '{terms.BREAK}')) AS c FROM tx)),
gr AS (SELECT DISTINCT t, size, list_append(list_transform(ws[i:i + size - 2], lambda w: lower(w)), lower(list_transform([ws[i + size - 1]], lambda w: {SINGULAR})[1])) AS g FROM (SELECT t, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM ck, (SELECT unnest([2, 3, 4])::INT AS size) WHERE len(ws) >= size)),
ok AS (SELECT t, size, array_to_string(g, ' ') AS term, g FROM gr WHERE NOT list_has_any(g, {_q(terms.NO_TERM)}) AND len(list_filter(g, lambda w: NOT regexp_matches(w, '\p{{L}}'))) = 0),
cnt AS (SELECT term, size, count(*) AS n_texts FROM ok GROUP BY ALL HAVING count(*) >= 3), fr AS (SELECT ok.* FROM ok SEMI JOIN cnt ON cnt.term = ok.term),
sub AS (SELECT DISTINCT t, longer, array_to_string(g[i:i + k - 1], ' ') AS term FROM (SELECT t, term AS longer, g, k, unnest(range(1, size - k + 2)) AS i FROM fr, (SELECT unnest([2, 3]) AS k) WHERE size > k)),
cov AS (SELECT term, max(n) AS most FROM (SELECT sub.term, longer, count(*) AS n FROM sub JOIN fr ON fr.t = sub.t AND fr.term = sub.term GROUP BY ALL) GROUP BY term),
df AS (SELECT cnt.term, cnt.size, n_texts FROM cnt LEFT JOIN cov ON cov.term = cnt.term WHERE most IS NULL OR most < 0.75 * n_texts)"""


@query(f"{GRAMS} SELECT term, size, n_texts FROM df")
def d18_term_df(spark, sf):
    return terms.phrase_counts(i.units(spark, sf))


@query(f"{GRAMS} SELECT term, size, n_texts FROM df ORDER BY n_texts DESC, size DESC, term LIMIT 80")
def f2_top_terms(spark, sf):
    return terms.phrase_counts(i.units(spark, sf)).orderBy(F.desc("n_texts"), F.desc("size"), "term").limit(80)


@query(f"{GRAMS} SELECT size, count(*) AS n, count(DISTINCT term) AS n_terms FROM ok GROUP BY size")
def h53b_phrase_grams(spark, sf):
    return terms.phrase_grams(i.units(spark, sf)).groupBy("size").agg(F.sum("n_texts").alias("n"), F.count("*").alias("n_terms"))


@query(rf"""{U}, w AS (SELECT unnest(regexp_extract_all(text, '\p{{L}}+')) AS form FROM units), c AS (SELECT lower(form) AS word, form, count(*) AS n FROM w GROUP BY 1, 2)
SELECT word, form, n FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, form) = 1""")
def d20_spelling_mode(spark, sf):
    return terms.mode_form(i.units(spark, sf).select(F.explode(t.extract(F.col("text"), r"\p{L}+")).alias("form")), F.lower("form"), "word")


@query(rf"""{U}, w AS (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM units) SELECT w AS word, count(*) AS n FROM w WHERE contains(w, 'tion') AND w <> 'tion' GROUP BY 1""")
def d26_longer_words(spark, sf):
    w = i.units(spark, sf).select(F.explode(t.words(F.col("text"))).alias("word"))
    return w.where(F.contains("word", F.lit("tion")) & (F.col("word") != "tion")).groupBy("word").agg(F.count("*").alias("n"))

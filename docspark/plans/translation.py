"""Queries over source and target texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fold
from ..functions import text as t
from ..operators import glossary, structure, terms
from ..operators import translation as tr
from . import inputs as i
from .registry import query
from .text import NUMS, STEM, STOP, TOK, U

S = f"WITH {i.SEGMENTS}"
SRC, TGT = "source_text", "coalesce(target_text, '')"
EXCESS = "list_filter(list_distinct({a}), lambda v: len(list_filter({a}, lambda x: x = v)) > len(list_filter({b}, lambda x: x = v)))"
BASE = f"""{S}, p AS (SELECT job_id, segment_id, source_text AS s, coalesce(target_text, '') AS g, {NUMS.format('source_text')} AS ns, {NUMS.format("coalesce(target_text, '')")} AS ng FROM segments)"""
REFS = rf"list_distinct(list_transform(list_concat(regexp_extract_all({{}}, '{t.EMAIL}'), regexp_extract_all({{}}, '{t.URL}')), lambda x: lower(regexp_replace(x, '[.,;]+$', ''))))"
COUNT = "(length({c}) - length(replace({c}, {x}, '')))"


def _sql(code, severity, cond):
    return f"SELECT job_id, segment_id, '{code}' AS code, '{severity}' AS severity FROM p WHERE trim(g) <> '' AND {cond}"


CHECKS = " UNION ALL ".join([
    "SELECT job_id, segment_id, 'EMPTY' AS code, 'critical' AS severity FROM p WHERE trim(g) = ''",
    _sql("CELLS", "critical", f"contains(s, '|') AND {COUNT.format(c='s', x=chr(39) + '|' + chr(39))} <> {COUNT.format(c='g', x=chr(39) + '|' + chr(39))}"),
    _sql("REFERENCES", "critical", f"len(list_filter({REFS.format('s', 's')}, lambda r: NOT list_contains({REFS.format('g', 'g')}, r))) > 0"),
    _sql("NUMBERS", "critical", f"len({EXCESS.format(a='ns', b='ng')}) > 0"), _sql("NUMBERS_ADDED", "low", f"len({EXCESS.format(a='ng', b='ns')}) > 0"),
    _sql("UNTRANSLATED", "medium", r"trim(s) = trim(g) AND regexp_matches(s, '\p{Ll}')"), _sql("LINE_BREAKS", "medium", f"{COUNT.format(c='s', x='chr(10)')} <> {COUNT.format(c='g', x='chr(10)')}"),
    _sql("LENGTH", "low", "length(trim(s)) >= 20 AND (length(trim(g)) / length(trim(s)) < 0.5 OR length(trim(g)) / length(trim(s)) > 2.0)"),
])


@query(f"{BASE} {CHECKS}")
def k18_check_translations(spark, sf):
    return tr.check_segments(i.segments(spark, sf))


@query(f"{BASE}, c AS ({CHECKS}) SELECT code, severity, count(*) AS n FROM c GROUP BY 1, 2")
def k18_report(spark, sf):
    return tr.check_segments(i.segments(spark, sf)).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query(f"{BASE}, c AS ({CHECKS}) SELECT DISTINCT job_id, segment_id FROM c WHERE severity IN ('medium', 'high', 'critical') AND code <> 'EMPTY'")
def k19_repair_candidates(spark, sf):
    return tr.check_segments(i.segments(spark, sf)).where("severity in ('medium', 'high', 'critical') and code <> 'EMPTY'").select("job_id", "segment_id").distinct()


@query(f"""{BASE}, x AS (SELECT job_id, segment_id, unnest({EXCESS.format(a='ns', b='ng')}) AS value, 'lost' AS side FROM p UNION ALL SELECT job_id, segment_id, unnest({EXCESS.format(a='ng', b='ns')}), 'added' FROM p) SELECT * FROM x""")
def g5_number_multiset_diff(spark, sf):
    p = i.segments(spark, sf).select("job_id", "segment_id", t.neutral_numbers(F.col(SRC)).alias("ns"), t.neutral_numbers(F.coalesce("target_text", F.lit(""))).alias("ng"))
    lost = p.select("job_id", "segment_id", F.explode(F.array_distinct(t.multiset_minus(F.col("ns"), F.col("ng")))).alias("value"), F.lit("lost").alias("side"))
    return lost.unionByName(p.select("job_id", "segment_id", F.explode(F.array_distinct(t.multiset_minus(F.col("ng"), F.col("ns")))).alias("value"), F.lit("added").alias("side")))


@query(f"{BASE} SELECT job_id, segment_id, array_to_string(list_sort(list_filter({REFS.format('s', 's')}, lambda r: NOT list_contains({REFS.format('g', 'g')}, r))), ' ') AS lost FROM p WHERE len({REFS.format('s', 's')}) > 0")
def g8_reference_diff(spark, sf):
    refs = lambda c: F.array_distinct(t.emails_urls(c))
    p = i.segments(spark, sf).select("job_id", "segment_id", refs(F.col(SRC)).alias("a"), refs(F.coalesce("target_text", F.lit(""))).alias("b"))
    return p.where(F.size("a") > 0).select("job_id", "segment_id", F.array_join(F.array_sort(F.array_except("a", "b")), " ").alias("lost"))


@query(f"{S} SELECT job_id, segment_id, CASE WHEN trim(coalesce(target_text, '')) = '' THEN NULL ELSE length(trim(target_text)) / length(trim(source_text)) END AS ratio FROM segments WHERE length(trim(source_text)) >= 20")
def h39_length_ratio(spark, sf):
    g = F.trim(F.coalesce("target_text", F.lit("")))
    return i.segments(spark, sf).where(F.char_length(F.trim(SRC)) >= 20).select("job_id", "segment_id", F.when(g != "", F.char_length(g) / F.char_length(F.trim(SRC))).alias("ratio"))


@query(f"{S} SELECT job_id, segment_id, NOT regexp_matches(regexp_replace(source_text, '{t.REF_TOKEN}', ' ', 'g'), '\\p{{L}}') AS copy_only FROM segments")
def h40_copy_only(spark, sf):
    return i.segments(spark, sf).select("job_id", "segment_id", (~F.regexp_replace(SRC, t.REF_TOKEN, " ").rlike(r"\p{L}")).alias("copy_only"))


@query(f"{S}, l AS (SELECT job_id, segment_id, length(regexp_replace(source_text, '[^\\p{{L}}]', '', 'g')) AS n, length(regexp_replace(source_text, '[^A-Za-zÀ-ɏ]', '', 'g')) AS k FROM segments) SELECT job_id, segment_id, CASE WHEN n > 0 THEN k / n ELSE 0.0 END AS share FROM l")
def h38_latin_share(spark, sf):
    return i.segments(spark, sf).select("job_id", "segment_id", t.latin_share(F.col(SRC)).alias("share"))


@query(f"{S} SELECT job_id, segment_id, first_value(job_id) OVER w AS first_job_id, first_value(segment_id) OVER w AS first_segment_id, count(*) OVER (PARTITION BY source_text) AS group_size FROM segments WINDOW w AS (PARTITION BY source_text ORDER BY job_id, segment_id)")
def d21_distinct_groups(spark, sf):
    return tr.distinct_groups(i.segments(spark, sf), ["job_id", "segment_id"])


@query(f"{S}, h AS (SELECT DISTINCT source_text FROM segments WHERE job_id % 10 = 0) SELECT job_id, segment_id FROM segments WHERE job_id % 10 <> 0 AND source_text IN (SELECT source_text FROM h)")
def g12_edit_propagation(spark, sf):
    s = i.segments(spark, sf).select("job_id", "segment_id", F.sha2(SRC, 256).alias("h"))
    return s.where("job_id % 10 <> 0").join(s.where("job_id % 10 = 0").select("h").distinct(), "h", "left_semi").select("job_id", "segment_id")


@query(f"{S} SELECT job_id % 20 AS scope, count(*) AS n_segments, count(target_text) AS n_done, count(target_text) / count(*) AS coverage, min(segment_id) AS first_segment FROM segments GROUP BY 1")
def d10_segment_counts(spark, sf):
    out = i.segments(spark, sf).groupBy((F.col("job_id") % 20).alias("scope")).agg(F.count("*").alias("n_segments"), F.count("target_text").alias("n_done"), F.min("segment_id").alias("first_segment"))
    return out.withColumn("coverage", F.col("n_done") / F.col("n_segments"))


BAG = f"""{S}, b AS (SELECT job_id, segment_id, {TOK.format('source_text')} AS a, {TOK.format("coalesce(target_text, '')")} AS b FROM segments),
wa AS (SELECT job_id, segment_id, w, count(*) AS n FROM (SELECT job_id, segment_id, unnest(a) AS w FROM b) GROUP BY ALL), wb AS (SELECT job_id, segment_id, w, count(*) AS n FROM (SELECT job_id, segment_id, unnest(b) AS w FROM b) GROUP BY ALL),
na AS (SELECT job_id, segment_id, sum(n * n) AS q FROM wa GROUP BY ALL), nb AS (SELECT job_id, segment_id, sum(n * n) AS q FROM wb GROUP BY ALL),
d AS (SELECT wa.job_id, wa.segment_id, sum(wa.n * wb.n) AS dot FROM wa JOIN wb USING (job_id, segment_id, w) GROUP BY ALL)"""


@query(f"{BAG} SELECT s.job_id, s.segment_id, CASE WHEN na.q > 0 AND nb.q > 0 THEN round(coalesce(dot, 0) / sqrt((na.q * nb.q)::DOUBLE), 9) ELSE 0.0 END AS cosine FROM segments s LEFT JOIN d USING (job_id, segment_id) LEFT JOIN na USING (job_id, segment_id) LEFT JOIN nb USING (job_id, segment_id)")
def d12_bow_cosine(spark, sf):
    s = i.segments(spark, sf).withColumn("target_text", F.coalesce("target_text", F.lit("")))
    return tr.bow_cosine(s, ["job_id", "segment_id"], SRC, "target_text").withColumn("cosine", F.round("cosine", 9))


@query(rf"""{S}, w AS (SELECT job_id, segment_id, unnest(list_distinct(regexp_extract_all(lower(source_text), '\p{{L}}+'))) AS w, regexp_extract_all(lower(coalesce(target_text, '')), '\p{{L}}+') AS g FROM segments)
SELECT job_id * 1000 + segment_id AS key, count(*) AS n_words, count(*) FILTER (list_contains(g, w)) AS n_found, count(*) FILTER (list_contains(g, w)) / count(*) AS recall,
coalesce(array_to_string((list(w ORDER BY w) FILTER (NOT list_contains(g, w)))[1:8], ' '), '') AS missing FROM w GROUP BY 1""")
def d4_word_recall(spark, sf):
    s = i.segments(spark, sf).select((F.col("job_id") * 1000 + F.col("segment_id")).alias("key"), t.words(F.col(SRC)).alias("words"), t.words(F.coalesce("target_text", F.lit(""))).alias("tw"))
    return structure.word_recall(s.select("key", "words"), s.select("key", F.col("tw").alias("words")), "key")


# A glossary of one to five words: the first words of every seventeenth document's lines, some without their plural s, half of them case-sensitive, beside nations and brands.
TOKENS = r"'[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]| '"
GLOSSARY = rf"""{U}, l AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x, 1 + (seq % 5)::INT AS k FROM units WHERE doc_id % 17 = 0),
gl AS (SELECT term, bool_and(cased) AS cased FROM (SELECT regexp_replace(array_to_string(string_split(x, ' ')[1:k], ' '), 's$', '') AS term, doc_id % 2 = 0 AS cased FROM l WHERE regexp_matches(array_to_string(string_split(x, ' ')[1:k], ' '), '^\p{{L}}{{4,}}( \p{{L}}+){{0,4}}$')
  UNION ALL SELECT n_name, false FROM nation UNION ALL SELECT DISTINCT p_brand, true FROM part) GROUP BY term),
gf AS (SELECT term, cased, unnest(CASE WHEN regexp_matches(term, '(?i)[^aeiou\s]y$') THEN [term, term[:-2] || 'ies', term[:-2] || 'IES'] WHEN regexp_matches(term, '\p{{L}}$') THEN [term, term || 's', term || 'es', term || 'S', term || 'ES'] ELSE [term] END) AS form FROM gl),
fm AS (SELECT DISTINCT term, cased, CASE WHEN cased THEN form ELSE lower(form) END AS form, len(regexp_extract_all(form, {TOKENS})) AS n FROM gf),
tk AS (SELECT doc_id, seq, regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), {TOKENS}) AS w FROM units),
wi AS (SELECT doc_id, seq, i, n, array_to_string(w[i:i + n - 1], '') AS win FROM (SELECT doc_id, seq, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM tk, (SELECT DISTINCT n FROM fm) WHERE len(w) >= n)),
ma AS (SELECT doc_id, seq, term, i, wi.n, win FROM wi JOIN fm ON fm.n = wi.n AND lower(win) = lower(form) AND (NOT cased OR win = form)),
nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY i, n DESC, term) AS k FROM ma),
gr AS (SELECT doc_id, seq, k, i + n AS ends, true AS kept FROM nu WHERE k = 1 UNION ALL SELECT nu.doc_id, nu.seq, nu.k, CASE WHEN nu.i >= ends THEN nu.i + nu.n ELSE ends END, nu.i >= ends FROM gr JOIN nu ON nu.doc_id = gr.doc_id AND nu.seq = gr.seq AND nu.k = gr.k + 1),
us AS (SELECT nu.doc_id, nu.seq, term, i AS start, n, win AS matched FROM nu JOIN gr USING (doc_id, seq, k) WHERE kept)"""


def glossary_terms(spark, sf):
    first = F.array_join(F.slice(F.split(t.norm_ws(F.col("text")), " "), 1, (1 + F.col("seq") % 5).cast("int")), " ")
    lines = i.units(spark, sf).where("doc_id % 17 = 0").select(first.alias("term"), (F.col("doc_id") % 2 == 0).alias("case_sensitive")).where(F.col("term").rlike(r"^\p{L}{4,}( \p{L}+){0,4}$"))
    lines = lines.withColumn("term", F.regexp_replace("term", "s$", ""))
    names = i.table(spark, sf, "nation").select("n_name", F.lit(False)).union(i.table(spark, sf, "part").select("p_brand", F.lit(True)).distinct())
    return lines.union(names)


@query(f"{GLOSSARY.replace('WITH ', 'WITH RECURSIVE ', 1)} SELECT doc_id, seq, term, start, n, matched FROM us")
def c16_glossary_match(spark, sf):
    return glossary.glossary_match(i.units(spark, sf), glossary_terms(spark, sf), ["doc_id", "seq"])


@query(f"{GLOSSARY.replace('WITH ', 'WITH RECURSIVE ', 1)}, n AS (SELECT doc_id, seq, len(regexp_extract_all(lower(text), '\\p{{L}}+'))::BIGINT AS n_words FROM units), m AS (SELECT doc_id, seq, count(*) AS n FROM us GROUP BY ALL) SELECT lang, sum(n_words)::BIGINT AS n_words, sum(coalesce(m.n, 0))::BIGINT AS n_terms FROM units JOIN n USING (doc_id, seq) LEFT JOIN m USING (doc_id, seq) GROUP BY lang")
def d23_facts_summary(spark, sf):
    u = i.units(spark, sf)
    m = glossary.glossary_match(u, glossary_terms(spark, sf), ["doc_id", "seq"]).groupBy("doc_id", "seq").agg(F.count("*").alias("n"))
    rows = u.select("doc_id", "seq", "lang", F.size(t.words(F.col("text"))).alias("k")).join(m, ["doc_id", "seq"], "left")
    return rows.groupBy("lang").agg(F.sum("k").alias("n_words"), F.sum(F.coalesce("n", F.lit(0))).alias("n_terms"))


@query(rf"""{U}, w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{{L}}+')) AS word FROM units) SELECT word, replace(lower(strip_accents(word)), 'ß', 'ss') AS folded FROM w""")
def j1_unicode_fold(spark, sf):
    words = i.units(spark, sf).select(F.explode(t.extract(F.col("text"), r"\p{L}+")).alias("word")).distinct()
    return words.select("word", fold.unicode_fold(F.col("word")).alias("folded"))


@query(rf"""{U}, v AS (SELECT doc_id, seq, unnest({NUMS.format('text')}) AS v FROM units) SELECT doc_id, count(DISTINCT v) AS n_values, min(v) AS first_value FROM v GROUP BY 1""")
def d27_values_per_document(spark, sf):
    v = i.units(spark, sf).select("doc_id", F.explode(t.neutral_numbers(F.col("text"))).alias("v"))
    return v.groupBy("doc_id").agg(F.count_distinct("v").alias("n_values"), F.min("v").alias("first_value"))


@query(rf"""WITH b AS (SELECT item_id, lower(trim(regexp_replace(string_split(text, chr(10))[1], '\s+', ' ', 'g'))) AS phrase FROM benchmark), {i.UNITS},
l AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS line FROM units) SELECT item_id, count(DISTINCT doc_id) AS n_docs, count(DISTINCT doc_id) > 0 AS preserved FROM b LEFT JOIN l ON b.phrase = l.line GROUP BY item_id""")
def c25_must_preserve(spark, sf):
    b = i.table(spark, sf, "benchmark").select("item_id", t.norm_lower(F.element_at(F.split("text", "\n"), 1)).alias("line"))
    met = b.join(i.units(spark, sf).select("doc_id", t.norm_lower(F.col("text")).alias("line")), "line", "left")
    return met.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs")).withColumn("preserved", F.col("n_docs") > 0)


@query(f"""WITH e AS (SELECT vec_id, label, list_sum(list_transform(range(0, 16), lambda k: CASE WHEN embedding[k + 1] > 0 THEN (1::BIGINT << k::INT) ELSE 0 END))::BIGINT AS h FROM embeddings), l AS (SELECT label, min(h) AS h FROM e GROUP BY label)
SELECT vec_id, min(CASE WHEN bit_count(xor(e.h, l.h)) <= 5 THEN l.label END) AS meaning FROM e CROSS JOIN l GROUP BY vec_id""")
def c21_hamming_match(spark, sf):
    from ..operators import matching

    e = i.table(spark, sf, "embeddings").select("vec_id", "label", matching.sign_hash(F.col("embedding"), 16).alias("h"))
    return matching.hamming_match(e.select("vec_id", "h"), e.groupBy("label").agg(F.min("h").alias("h")), "vec_id", "label", 5, 16)


# Markers: sources with pairs nested three deep and an object; targets keep, lose, cross, repeat or unbalance them.
TAGGED = ("⟦1⟧a⟦2⟧b⟦3⟧c⟦/3⟧⟦/2⟧d⟦/1⟧ ⟦4⟧", "⟦4⟧ ⟦1⟧a⟦2⟧b⟦3⟧c⟦/3⟧⟦/2⟧d⟦/1⟧", "⟦1⟧a⟦2⟧b⟦/1⟧c⟦/2⟧ ⟦3⟧⟦/3⟧⟦4⟧", "⟦1⟧a⟦/2⟧b⟦2⟧c⟦/1⟧⟦4⟧", "⟦4⟧⟦4⟧⟦1⟧⟦/1⟧", "none", "⟦1⟧⟦1⟧⟦/1⟧⟦/1⟧⟦10⟧", "⟦/1⟧x⟦1⟧")
TAGS = f"""g AS (SELECT o_orderkey AS id, {"['" + "', '".join(TAGGED) + "']"}[1 + o_custkey % {len(TAGGED)}] AS s, CASE WHEN o_orderkey % 9 > 0 THEN {"['" + "', '".join(TAGGED) + "']"}[1 + o_orderkey % {len(TAGGED)}] END AS t FROM orders),
m AS (SELECT id, side, k, starts_with(x, '⟦/') AS closes, regexp_extract(x, '[0-9]+')::BIGINT AS n FROM (SELECT id, side, unnest(regexp_extract_all(x, '⟦/?[0-9]+⟧')) AS x, generate_subscripts(regexp_extract_all(x, '⟦/?[0-9]+⟧'), 1) AS k FROM (SELECT id, 's' AS side, s AS x FROM g UNION ALL SELECT id, 't', coalesce(t, '') FROM g))),
d AS (SELECT m.*, CASE WHEN closes THEN 'close' WHEN EXISTS (SELECT 1 FROM m c WHERE c.id = m.id AND c.side = m.side AND c.closes AND c.n = m.n) THEN 'open' ELSE 'object' END AS kind FROM m),
b AS (SELECT id, kind, n, count(*) FILTER (side = 's') - count(*) FILTER (side = 't') AS more FROM d GROUP BY ALL),
h AS (SELECT id, kind, n, more, '⟦' || CASE kind WHEN 'close' THEN '/' ELSE '' END || n || '⟧' AS shown FROM b WHERE more <> 0),
w AS (SELECT id, coalesce(string_agg(repeat(shown, more::INT), '' ORDER BY kind, n) FILTER (more > 0), '') AS missing, coalesce(string_agg(repeat(shown, -more::INT), '' ORDER BY kind, n) FILTER (more < 0), '') AS extra FROM h GROUP BY id),
v AS (SELECT id, 0::BIGINT AS k, []::BIGINT[] AS open, NULL::VARCHAR AS broken, NULL::BIGINT AS pair FROM g UNION ALL
  SELECT v.id, d.k, CASE WHEN kind = 'open' THEN list_prepend(n, open) WHEN kind = 'close' AND open[1] = n THEN open[2:] ELSE open END, CASE WHEN kind = 'close' AND open[1] IS DISTINCT FROM n THEN CASE WHEN list_contains(open, n) THEN 'crossing' ELSE 'unbalanced' END END, CASE WHEN kind = 'close' AND open[1] IS DISTINCT FROM n THEN n END
  FROM v JOIN d ON d.id = v.id AND d.side = 't' AND d.k = v.k + 1 WHERE broken IS NULL)"""


@query(f"WITH RECURSIVE {TAGS} SELECT g.id, coalesce(missing, '') AS missing, coalesce(extra, '') AS extra, max(broken) AS broken, max(pair) AS pair FROM g LEFT JOIN w ON w.id = g.id LEFT JOIN v ON v.id = g.id GROUP BY g.id, missing, extra")
def g7_tag_diff(spark, sf):
    pick = lambda c: F.element_at(F.array(*map(F.lit, TAGGED)), (1 + c % len(TAGGED)).cast("int"))
    rows = i.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), pick(F.col("o_custkey")).alias("s"), F.when(F.col("o_orderkey") % 9 > 0, pick(F.col("o_orderkey"))).alias("t"))
    return tr.tag_diff(rows, "s", "t").select("id", F.array_join("missing", "").alias("missing"), F.array_join("extra", "").alias("extra"), "broken", "pair")

"""Queries over changes, references, alignments and rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as t
from ..operators import duplicates as dups
from ..operators import chunks
from ..operators import reconcile as rc
from . import inputs as i
from .registry import query
from .structure import TF
from .text import U

# Line items with odd and even line numbers stand for the source's values and the claims'.
VALUES = "v AS (SELECT l_orderkey AS unit_id, l_returnflag AS kind, (l_quantity::BIGINT % 7)::VARCHAR AS normalized, l_linenumber AS pos FROM lineitem)"
DIFF = f"""WITH {VALUES}, s AS (SELECT unit_id, kind, normalized, min(pos) AS pos FROM v WHERE pos % 2 = 1 GROUP BY ALL), c AS (SELECT unit_id, kind, normalized, min(pos) AS pos FROM v WHERE pos % 2 = 0 GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY unit_id, kind ORDER BY pos, normalized) AS k FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.unit_id = s.unit_id AND c.kind = s.kind AND c.normalized = s.normalized)),
a AS (SELECT *, row_number() OVER (PARTITION BY unit_id, kind ORDER BY pos, normalized) AS k FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE c.unit_id = s.unit_id AND c.kind = s.kind AND c.normalized = s.normalized))"""


@query(f"{DIFF} SELECT coalesce(l.unit_id, a.unit_id) AS unit_id, coalesce(l.kind, a.kind) AS kind, CASE WHEN l.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'missing' ELSE 'changed' END AS change, l.normalized AS lost, a.normalized AS added FROM l FULL JOIN a ON l.unit_id = a.unit_id AND l.kind = a.kind AND l.k = a.k")
def g1_value_diff(spark, sf):
    v = i.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_returnflag").alias("kind"), (F.col("l_quantity").cast("long") % 7).cast("string").alias("normalized"), F.col("l_linenumber").alias("pos"))
    return rc.value_diff(v.where("pos % 2 = 1"), v.where("pos % 2 = 0"), "unit_id")


MODS = "(CASE p_partkey % 3 WHEN 0 THEN ['mandatory'] WHEN 1 THEN ['permitted', 'future'] ELSE [] END)"
MODC = "(CASE p_size % 3 WHEN 0 THEN ['mandatory'] WHEN 1 THEN ['future'] ELSE [] END)"


@query(f"""WITH p AS (SELECT p_partkey, {MODS}::VARCHAR[] AS s, {MODC}::VARCHAR[] AS c FROM part), d AS (SELECT p_partkey, s, array_to_string(list_filter(s, lambda x: NOT list_contains(c, x)), ',') AS lost, array_to_string(list_filter(c, lambda x: NOT list_contains(s, x)), ',') AS added FROM p)
SELECT p_partkey, lost, added, CASE WHEN lost = '' AND added = '' THEN NULL WHEN len(s) = 0 AND added = 'mandatory' THEN 'medium' ELSE 'high' END AS severity FROM d""")
def g2_modality_diff(spark, sf):
    pick = lambda c, b: F.when(c % 3 == 0, F.array(F.lit("mandatory"))).when(c % 3 == 1, F.array(*map(F.lit, b))).otherwise(F.array().cast("array<string>"))
    p = i.table(spark, sf, "part").select("p_partkey", pick(F.col("p_partkey"), ["permitted", "future"]).alias("s"), pick(F.col("p_size"), ["future"]).alias("c"))
    return rc.modality_diff(p, "s", "c").drop("s", "c")


@query(rf"""WITH {i.SEGMENTS}, q AS (SELECT job_id, segment_id, unnest(regexp_extract_all(source_text, '[\p{{Lu}}][\p{{Ll}}]+ [\p{{Ll}}]+')) AS phrase, coalesce(target_text, '') AS g FROM segments) SELECT job_id, segment_id, count(DISTINCT phrase) AS n_phrases, count(DISTINCT phrase) FILTER (NOT contains(g, phrase)) AS n_lost FROM q GROUP BY 1, 2""")
def g4_quote_diff(spark, sf):
    q = i.segments(spark, sf).select("job_id", "segment_id", F.explode(F.array_distinct(t.extract(F.col("source_text"), r"[\p{Lu}][\p{Ll}]+ [\p{Ll}]+"))).alias("phrase"), F.coalesce("target_text", F.lit("")).alias("g"))
    return q.groupBy("job_id", "segment_id").agg(F.count("*").alias("n_phrases"), F.count_if(~F.contains("g", F.col("phrase"))).alias("n_lost"))


@query("""WITH f AS (SELECT l_orderkey AS claim_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), o AS (SELECT o_orderkey AS claim_id, o_custkey AS a, o_orderstatus AS b FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey AS claim_id, o_custkey AS a, o_orderstatus AS b FROM orders WHERE o_orderkey % 2 = 1)
SELECT DISTINCT f.claim_id, f.n, n.claim_id AS new_claim_id FROM f JOIN o ON f.claim_id = o.claim_id JOIN n ON o.a = n.a AND o.b = n.b""")
def g14_carry_findings(spark, sf):
    f = i.table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.count("*").alias("n"))
    o = i.table(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b"))
    return rc.carry_findings(f, o.where("claim_id % 2 = 0"), o.where("claim_id % 2 = 1"), ["a", "b"])


@query("""WITH r AS (SELECT l_orderkey AS ref_id, l_linenumber AS n, l_partkey AS num, l_suppkey AS sup, l_returnflag AS kind FROM lineitem),
x AS (SELECT r.*, s.s_name AS t0, p.p_name AS t1 FROM r LEFT JOIN supplier s ON kind = 'R' AND sup % 3 <> 0 AND s.s_suppkey = sup LEFT JOIN part p ON kind <> 'N' AND num % 5 <> 0 AND p.p_partkey = num)
SELECT ref_id, n, num, sup, kind, coalesce(t0, t1) AS target, CASE WHEN t0 IS NOT NULL THEN 'section' WHEN t1 IS NOT NULL THEN 'step' ELSE 'unresolved' END AS resolution FROM x""")
def c17_resolve_xrefs(spark, sf):
    r = i.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ref_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("num"), F.col("l_suppkey").alias("sup"), F.col("l_returnflag").alias("kind"))
    s = i.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("target"))
    p = i.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("target"))
    return rc.resolve_in_order(r, "ref_id", [("section", s, F.when((F.col("kind") == "R") & (F.col("sup") % 3 != 0), F.col("sup"))), ("step", p, F.when((F.col("kind") != "N") & (F.col("num") % 5 != 0), F.col("num")))])


@query(f"""WITH {i.RECORDS}, j AS (SELECT *, coalesce(lag(status) OVER w = status AND abs(price - lag(price) OVER w) <= 0.3 * lag(price) OVER w, false) AS x FROM records WINDOW w AS (PARTITION BY document_uid ORDER BY version))
SELECT document_uid, version, sum((NOT x)::BIGINT) OVER (PARTITION BY document_uid ORDER BY version)::BIGINT AS run FROM j""")
def c14_stitch_runs(spark, sf):
    along = W.partitionBy("document_uid").orderBy("version")
    before = F.lag("price").over(along)
    same = (F.lag("status").over(along) == F.col("status")) & (F.abs(F.col("price") - before) <= 0.3 * before)
    return rc.stitched_runs(i.records(spark, sf), ["document_uid"], ["version"], same).select("document_uid", "version", "run")


@query("""WITH a AS (SELECT l_orderkey AS g, l_partkey AS icon, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')),
b AS (SELECT l_orderkey AS g, l_partkey AS slot, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'A')) SELECT a.g, icon, slot FROM a JOIN b ON a.g = b.g AND a.k = b.k AND a.n = b.n""")
def c28_icon_row_align(spark, sf):
    li = i.table(spark, sf, "lineitem")
    side = lambda f, n: li.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias(n)).distinct()
    return rc.align_by_rank(side("R", "icon"), side("A", "slot"), ["g"], "icon", "slot")


@query("""WITH a AS (SELECT l_orderkey AS g, l_partkey AS icon, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS k FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')),
b AS (SELECT l_orderkey AS g, l_partkey AS slot, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS k FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'N')) SELECT a.g, icon, slot FROM a JOIN b ON a.g = b.g AND a.k = b.k""")
def e26_spread_icons(spark, sf):
    li = i.table(spark, sf, "lineitem")
    side = lambda f, n: li.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias(n)).distinct()
    return rc.spread(side("R", "icon"), side("N", "slot"), ["g"], "icon", "slot")


@query("""WITH e AS (SELECT doc_id, quality AS x FROM labels), a AS (SELECT doc_id, (n_chars > 300)::INT AS x FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(e.doc_id, a.doc_id) AS doc_id, e.x AS expected, a.x AS actual, CASE WHEN a.x IS NULL THEN 'missing' WHEN e.x IS NULL THEN 'unexpected' WHEN e.x = a.x THEN 'ok' ELSE 'wrong' END AS verdict FROM e FULL JOIN a ON e.doc_id = a.doc_id""")
def c23_golden_compare(spark, sf):
    a = i.table(spark, sf, "documents").where("doc_id % 4 <> 0").select("doc_id", (F.col("n_chars") > 300).cast("int").alias("x"))
    return rc.golden_compare(i.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("x")), a, "doc_id", "x")


@query("SELECT o_orderkey AS claim_id, o_orderstatus AS kind, l_partkey AS unit_id, p_brand AS section FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') l ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey")
def c27_traceability(spark, sf):
    bridge = i.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("unit_id")).distinct()
    return rc.trace(i.table(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderstatus").alias("kind")), bridge, i.table(spark, sf, "part").select(F.col("p_partkey").alias("unit_id"), F.col("p_brand").alias("section")), "claim_id", "unit_id")


@query(f"WITH {i.ISSUES} SELECT section_id, gate, string_agg(DISTINCT severity, '; ' ORDER BY severity) AS reasons, count(*) AS n FROM issues WHERE NOT resolved GROUP BY 1, 2")
def c30_affected_passages(spark, sf):
    return rc.affected(i.issues(spark, sf).where("not resolved"), ["section_id", "gate"], "severity")


@query(f"""WITH {i.ELEMENTS}, k AS (SELECT doc_id, kind, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS n FROM elements WHERE kind IN ('title', 'heading')) SELECT DISTINCT a.doc_id, b.doc_id AS linked FROM k a JOIN k b ON a.n = b.n AND a.kind = 'title' AND b.kind = 'heading'""")
def c29_linked_instructions(spark, sf):
    k = i.elements(spark, sf).where("kind in ('title', 'heading')").select("doc_id", "kind", t.norm_alnum(F.col("text")).alias("n"))
    return rc.linked_pairs(k.where("kind = 'title'").select("doc_id", "n"), k.where("kind = 'heading'").select(F.col("doc_id").alias("linked"), "n"), "doc_id", "linked", "n")


@query("""WITH e AS (SELECT DISTINCT l_partkey AS id, min(l_orderkey) OVER (PARTITION BY l_partkey) AS s FROM lineitem WHERE l_returnflag <> 'R'), x AS (SELECT p_partkey AS id, p_size AS p FROM part WHERE p_size < 20)
SELECT coalesce(e.id, x.id) AS id, coalesce(p, s + 1000000)::BIGINT AS place, p IS NOT NULL AS explicit, s IS NULL AS orphan FROM e FULL JOIN x ON e.id = x.id""")
def c34_complete_placements(spark, sf):
    e = i.table(spark, sf, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_orderkey").alias("s"))
    x = i.table(spark, sf, "part").where("p_size < 20").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("place"))
    return rc.complete_placements(e, x, "id", "s").withColumn("place", F.col("place").cast("long"))


CELLS = "c AS (SELECT l_suppkey AS tab, l_orderkey AS r, l_linenumber AS k, max(CASE WHEN l_quantity > 20 THEN l_returnflag || (l_partkey % 9) END) AS v FROM lineitem GROUP BY ALL)"


@query(f"""WITH {CELLS}, f AS (SELECT *, last_value(nullif(v, '') IGNORE NULLS) OVER (PARTITION BY tab, r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, last_value(nullif(v, '') IGNORE NULLS) OVER (PARTITION BY tab, k ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM c)
SELECT tab, r, k, coalesce(nullif(v, ''), l, u) AS filled FROM f""")
def e13_merge_spans(spark, sf):
    v = F.max(F.when(F.col("l_quantity") > 20, F.concat("l_returnflag", (F.col("l_partkey") % 9).cast("string"))))
    c = i.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("tab"), F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("k")).agg(v.alias("v"))
    return rc.fill_from_neighbours(c, ["tab"], "r", "k", "v").select("tab", "r", "k", "filled")


RULES = "r AS (SELECT p_partkey AS rule_id, p_brand AS category, string_split(p_type, ' ') AS applies, p_size < 40 AS approved, p_size AS max_words FROM part)"


def rules(spark, sf):
    return i.table(spark, sf, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("category"), F.split("p_type", " ").alias("applies"), (F.col("p_size") < 40).alias("approved"), F.col("p_size").alias("max_words"))


@query(f"WITH {RULES} SELECT rule_id, category FROM r WHERE approved AND substr(category, -2, 1) IN ('1', '3') AND (len(applies) = 0 OR list_has_any(applies, ['STEEL', 'TIN', 'SMALL', 'PROMO']))")
def b10_select_rules(spark, sf):
    r = rules(spark, sf).where("approved").where(F.substring("category", -2, 1).isin("1", "3"))
    return r.where((F.size("applies") == 0) | F.arrays_overlap("applies", F.array(*map(F.lit, ("STEEL", "TIN", "SMALL", "PROMO"))))).select("rule_id", "category")


@query(rf"""{U}, n AS (SELECT source, lang, len(regexp_extract_all(text, '\S+')) AS w FROM units), m AS (SELECT source, avg(w) AS mean, max(w) AS most FROM n GROUP BY 1), {RULES}, k AS (SELECT min(max_words) AS lim FROM r WHERE approved)
SELECT source, mean, most, most > lim AS over_limit FROM m, k""")
def d16_style_limits(spark, sf):
    n = i.units(spark, sf).select("source", F.size(t.extract(F.col("text"), r"\S+")).alias("w"))
    m = n.groupBy("source").agg(F.avg("w").alias("mean"), F.max("w").alias("most"))
    return m.join(F.broadcast(rules(spark, sf).where("approved").agg(F.min("max_words").alias("lim")))).select("source", "mean", "most", (F.col("most") > F.col("lim")).alias("over_limit"))


@query(f"""{U}, p AS (SELECT DISTINCT doc_id FROM units WHERE length(text) > 80), d AS (SELECT source, count(*) AS n, count(p.doc_id) AS k FROM documents LEFT JOIN p ON documents.doc_id = p.doc_id GROUP BY 1)
SELECT source, least(100, (100 * k) // n)::BIGINT AS pct, CASE WHEN k = n THEN 'pass' WHEN 100 * k >= 80 * n THEN 'warn' ELSE 'review' END AS status FROM d""")
def d25_placement_coverage(spark, sf):
    p = i.units(spark, sf).where(F.char_length("text") > 80).select("doc_id", F.lit(1).alias("hit")).distinct()
    d = i.table(spark, sf, "documents").join(p, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("hit").alias("k"))
    status = F.when(F.col("k") == F.col("n"), "pass").when(100 * F.col("k") >= 80 * F.col("n"), "warn").otherwise("review")
    return d.select("source", F.least(F.lit(100), F.floor(100 * F.col("k") / F.col("n"))).alias("pct"), status.alias("status"))


@query("SELECT l_suppkey AS section_id, avg((l_returnflag IN ('R', 'A'))::INT) AS share, bool_or(l_quantity > 49) AS required, count(DISTINCT l_linestatus) AS n_kinds, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS kinds FROM lineitem GROUP BY 1")
def d30_template_finalize(spark, sf):
    return i.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("section_id")).agg(F.avg(F.col("l_returnflag").isin("R", "A").cast("int")).alias("share"), F.bool_or(F.col("l_quantity") > 49).alias("required"), F.count_distinct("l_linestatus").alias("n_kinds"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "").alias("kinds"))


@query(f"""{U}, a AS (SELECT doc_id, seq, unnest(list_distinct(regexp_extract_all(text, '[A-Z]{{2,5}}'))) AS abbr FROM units), f AS (SELECT abbr, count(*) AS n, min(doc_id) AS first_doc FROM a GROUP BY 1)
SELECT f.abbr, n, first_doc, CASE WHEN length(f.abbr) = 2 THEN 'defined' ELSE 'undefined' END AS state FROM f""")
def e20_first_use(spark, sf):
    a = i.units(spark, sf).select("doc_id", F.explode(F.array_distinct(t.extract(F.col("text"), "[A-Z]{2,5}"))).alias("abbr"))
    f = a.groupBy("abbr").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return f.withColumn("state", F.when(F.char_length("abbr") == 2, "defined").otherwise("undefined"))


@query(rf"""{U} SELECT doc_id, seq, CASE WHEN regexp_matches(text, '^\s*[0-9]+\.[0-9]+') THEN 2 WHEN regexp_matches(text, '^\s*[0-9]+\.\s') THEN 1 WHEN length(text) <= 40 AND NOT regexp_matches(text, '[.!?;:,]$') THEN 3 END AS level FROM units""")
def h29_classify_block(spark, sf):
    c = F.col("text")
    level = F.when(c.rlike(r"^\s*[0-9]+\.[0-9]+"), 2).when(c.rlike(r"^\s*[0-9]+\.\s"), 1).when((F.char_length(c) <= 40) & ~c.rlike(r"[.!?;:,]$"), 3)
    return i.units(spark, sf).select("doc_id", "seq", level.alias("level"))


@query(rf"""{U}, w AS (SELECT doc_id, seq, text, list_filter(regexp_split_to_array(text, '(?i)\bthe\b'), lambda x: true) AS parts FROM units) SELECT doc_id, seq, len(parts) - 1 AS n, sha256(regexp_replace(text, '(?i)\bthe\b', 'THE', 'g')) AS replaced FROM w WHERE len(parts) > 1""")
def h54_find_replace(spark, sf):
    n = F.size(t.extract(F.col("text"), r"(?i)\bthe\b"))
    return i.units(spark, sf).where(n > 0).select("doc_id", "seq", n.cast("long").alias("n"), F.sha2(F.regexp_replace("text", r"(?i)\bthe\b", "THE"), 256).alias("replaced"))


@query(f"WITH {i.SEGMENTS} SELECT job_id, segment_id, NOT contains(source_text, string_split(coalesce(target_text, ''), chr(10))[1]) AS reworded FROM segments")
def h56_reworded(spark, sf):
    first = F.element_at(F.split(F.coalesce("target_text", F.lit("")), "\n"), 1)
    return i.segments(spark, sf).select("job_id", "segment_id", (~F.contains("source_text", first)).alias("reworded"))


@query(f"{U}, c AS (SELECT source, doc_id, count(*) AS n_units, sum(length(text))::BIGINT AS n_chars FROM units GROUP BY 1, 2) SELECT doc_id, n_units, n_chars, CASE WHEN n_chars = 0 THEN 'empty' WHEN n_chars > 9000 THEN 'long' ELSE 'ok' END AS verdict FROM c")
def k21_chunk_validate(spark, sf):
    c = i.units(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_units"), F.sum(F.char_length("text")).alias("n_chars"))
    return c.withColumn("verdict", F.when(F.col("n_chars") == 0, "empty").when(F.col("n_chars") > 9000, "long").otherwise("ok"))


@query(f"""{TF}, q AS (SELECT l.doc_id, l.seq, coalesce(dot / (ka.norm * kb.norm), 0) AS cosine FROM l LEFT JOIN p USING (doc_id, seq) LEFT JOIN k ka ON ka.doc_id = l.doc_id AND ka.seq = l.seq LEFT JOIN k kb ON kb.doc_id = l.doc_id AND kb.seq = l.nxt WHERE l.nxt IS NOT NULL),
b AS (SELECT u.doc_id, u.seq, length(text) AS n, coalesce(lag(cosine) OVER (PARTITION BY u.doc_id ORDER BY u.seq) < 0.05, true) AS fresh FROM units u LEFT JOIN q ON q.doc_id = u.doc_id AND q.seq = u.seq),
s AS (SELECT *, sum(fresh::BIGINT) OVER (PARTITION BY doc_id ORDER BY seq)::BIGINT AS part FROM b) SELECT doc_id, part, min(seq) AS first, count(*) AS n_units, sum(n)::BIGINT AS n_chars FROM s GROUP BY 1, 2""")
def e10_semantic_split(spark, sf):
    return chunks.semantic_split(i.units(spark, sf), "doc_id", "seq", 0.05)


# Lines as rules: those that say nearly the same, in one language or from one source, are merged.
RULE_SQL = r"""ru AS (SELECT doc_id * 100000 + seq AS id, text, lang AS category, source, length(text) % 5 AS severity FROM units),
rw AS (SELECT *, list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains({stop}, w)), lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN w[:-2] ELSE w END))) AS w FROM ru),
cl AS (SELECT w, category, min(id) AS id, count(*) AS n, list(DISTINCT source) FILTER (source IS NOT NULL) AS sources, max(severity) AS severity FROM rw GROUP BY w, category, CASE WHEN len(w) = 0 THEN id END),
df AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM cl) GROUP BY x), tk AS (SELECT id, x, len(w) AS z, row_number() OVER (PARTITION BY id ORDER BY n, x) AS place FROM (SELECT id, w, unnest(w) AS x FROM cl) JOIN df USING (x)),
px AS (SELECT * FROM tk WHERE place <= z - ceil(0.6 * z) + 1), cd AS (SELECT DISTINCT a.id AS a, b.id AS b FROM px a JOIN px b ON a.x = b.x AND a.id < b.id AND 100 * least(a.z, b.z) >= 60 * greatest(a.z, b.z)),
cm AS (SELECT a, b, len(l.w) AS za, len(r.w) AS zb, len(list_intersect(l.w, r.w)) AS c FROM cd JOIN cl l ON l.id = a JOIN cl r ON r.id = b),
pr AS (SELECT cm.a, cm.b FROM cm JOIN cl x ON x.id = cm.a JOIN cl y ON y.id = cm.b WHERE 100 * c >= 60 * (za + zb - c) AND (x.category IS NOT DISTINCT FROM y.category OR coalesce(list_has_any(x.sources, y.sources), false))),
nb AS (SELECT b AS id, list(a ORDER BY a) AS before, row_number() OVER (ORDER BY b) AS k FROM pr GROUP BY b),
fl AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS leader, []::BIGINT[] AS led UNION ALL
  SELECT nb.k, nb.id, coalesce(list_filter(before, lambda x: NOT list_contains(led, x))[1], nb.id), CASE WHEN len(list_filter(before, lambda x: NOT list_contains(led, x))) > 0 THEN list_append(led, nb.id) ELSE led END FROM fl JOIN nb ON nb.k = fl.k + 1)""".format(stop="[" + ", ".join(f"'{w}'" for w in dups.RULE_STOP) + "]")


@query(f"""WITH RECURSIVE {i.UNITS}, {RULE_SQL} SELECT coalesce(fl.leader, cl.id) AS id, sum(n)::BIGINT AS n, array_to_string(list_sort(list_distinct(flatten(list(coalesce(sources, []))))), ',') AS sources, max(severity) AS severity FROM cl LEFT JOIN fl ON fl.id = cl.id GROUP BY 1""")
def c20_jaccard_dupes(spark, sf):
    rules = i.units(spark, sf).select((F.col("doc_id") * 100000 + F.col("seq")).alias("id"), "text", F.col("lang").alias("category"), "source", (F.char_length("text") % 5).cast("long").alias("severity"))
    return dups.merge_duplicates(rules).select("id", "n", F.array_join("sources", ",").alias("sources"), "severity")

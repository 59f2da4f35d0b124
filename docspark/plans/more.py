"""Queries of further checks, labels and validations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import labels
from ..functions import text as t
from ..operators import chunks
from ..operators import labelling as lb
from ..operators import plans as ops
from ..operators import structure, terms
from ..operators.loops import stored
from . import inputs as i
from .quality import MAP, mapping
from .registry import query
from .text import GRAMS, U

E = f"WITH {i.ELEMENTS}"


@query(f"{U} SELECT doc_id, seq, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id, seq) AS place FROM units")
def f7_document_order(spark, sf):
    rows = i.units(spark, sf).select("source", "lang", "doc_id", "seq")
    return chunks.numbered(rows, ["source"], [F.col("lang"), F.floor(F.col("doc_id") / (1 << 12))], ["lang", "doc_id", "seq"], "place").drop("source", "lang")


@query("""WITH a AS (SELECT l_orderkey AS id, l_partkey % 5 AS v, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1, 2), b AS (SELECT l_orderkey AS id, l_partkey % 5 AS v, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2)
SELECT coalesce(a.id, b.id) AS id, coalesce(a.v, b.v) AS v, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS lost, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS added FROM a FULL JOIN b ON a.id = b.id AND a.v = b.v WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def g6_token_multiset_diff(spark, sf):
    v = i.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 5).alias("v"), "l_linenumber")
    return lb.multiset_diff(v.where("l_linenumber % 2 = 1"), v.where("l_linenumber % 2 = 0"), ["id", "v"])


@query(f"{E}, c AS (SELECT text, count(DISTINCT doc_id) AS n_texts FROM elements WHERE kind = 'list_item' AND len(regexp_extract_all(text, '\\p{{L}}+')) BETWEEN 1 AND 4 GROUP BY 1) SELECT text AS term, n_texts FROM c WHERE n_texts >= 2")
def d19_label_terms(spark, sf):
    return lb.label_terms(i.elements(spark, sf).where("kind = 'list_item'"), 1, 4, 2)


@query("""WITH h AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN (p_size || '.' || p_partkey % 7 || ' ' || p_name) WHEN 1 THEN ('Figure ' || p_size || ': ' || p_name) ELSE p_name END AS heading FROM part)
SELECT p_partkey, regexp_extract(heading, '^[0-9]+(?:\\.[0-9]+)*') AS number, regexp_extract(heading, '(?i)^(?:figure|table) [0-9]+') AS caption_label FROM h""")
def h31_heading_number(spark, sf):
    k = F.col("p_partkey")
    heading = F.when(k % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit("."), (k % 7).cast("string"), F.lit(" "), F.col("p_name"))).when(k % 3 == 1, F.concat(F.lit("Figure "), F.col("p_size").cast("string"), F.lit(": "), F.col("p_name"))).otherwise(F.col("p_name"))
    return i.table(spark, sf, "part").select("p_partkey", heading.alias("h")).select("p_partkey", labels.heading_number(F.col("h")).alias("number"), labels.caption_label(F.col("h")).alias("caption_label"))


@query("""WITH c AS (SELECT l_suppkey AS doc_id, l_returnflag || l_linenumber AS label, l_partkey AS value, l_orderkey AS pos FROM lineitem) SELECT doc_id, label, first(value ORDER BY pos, value) AS value, count(*) AS n FROM c GROUP BY 1, 2""")
def h34_label_value_rows(spark, sf):
    rows = i.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("label"), F.col("l_partkey").alias("value"), F.col("l_orderkey").alias("pos"))
    return lb.first_values(rows, ["doc_id", "label"], "value", "pos")


@query("""WITH s AS (SELECT o_orderkey, '⟦1⟧' || o_orderpriority || '⟦/1⟧ and ⟦2⟧' || CASE WHEN o_orderkey % 3 = 0 THEN '⟦/2⟧' ELSE '' END AS x FROM orders)
SELECT o_orderkey, regexp_replace(x, '⟦/?[0-9]+⟧', '', 'g') AS bare, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '2' END AS objects FROM s""")
def h37_markers(spark, sf):
    x = F.concat(F.lit("⟦1⟧"), F.col("o_orderpriority"), F.lit("⟦/1⟧ and ⟦2⟧"), F.when(F.col("o_orderkey") % 3 == 0, "⟦/2⟧").otherwise(""))
    rows = i.table(spark, sf, "orders").select("o_orderkey", x.alias("x"))
    return rows.select("o_orderkey", labels.strip_markers(F.col("x")).alias("bare"), F.array_join(labels.object_markers(F.col("x")), " ").alias("objects"))


@query(rf"""{U}, s AS (SELECT doc_id, seq, len(regexp_extract_all(text, '\S+')) AS n, regexp_matches(text, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:the|der|que)(?:$|[^\p{{L}}\p{{N}}_])') AS f FROM units) SELECT doc_id, seq, n > 40 AS too_long, f AS forbidden FROM s WHERE n > 40 OR f""")
def h45_claim_style(spark, sf):
    rows = i.units(spark, sf).select("doc_id", "seq", (F.size(t.extract(F.col("text"), r"\S+")) > 40).alias("too_long"), F.col("text").rlike(r"(?i)(?:^|[^\p{L}\p{N}_])(?:the|der|que)(?:$|[^\p{L}\p{N}_])").alias("forbidden"))
    return rows.where("too_long or forbidden")


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'promo|economy') THEN 'optional' WHEN regexp_matches(lower(p_type), 'steel|brass') THEN 'required' ELSE 'guidance' END AS class, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug FROM part""")
def h46_instruction_class(spark, sf):
    low = F.lower("p_type")
    return i.table(spark, sf, "part").select("p_partkey", F.when(low.rlike("promo|economy"), "optional").when(low.rlike("steel|brass"), "required").otherwise("guidance").alias("class"), labels.slug(F.col("p_name")).alias("slug"))


@query(rf"""{U}, w AS (SELECT doc_id, seq, list_distinct(regexp_extract_all(lower(text), '\p{{L}}+')) AS d, regexp_extract_all(lower(text), '\p{{L}}+') AS a FROM units) SELECT doc_id, seq, len(d) AS n_distinct, len(a) - len(d) AS n_repeats FROM w""")
def h58_array_dedupe(spark, sf):
    w = t.words(F.col("text"))
    return i.units(spark, sf).select("doc_id", "seq", F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), (F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("n_repeats"))


@query(rf"""{U} SELECT doc_id, (length(string_agg(text, chr(10) ORDER BY seq)) // 4 + 1)::BIGINT AS tokens FROM units GROUP BY 1""")
def h50_estimate_tokens(spark, sf):
    rows = i.units(spark, sf).groupBy("doc_id").agg((F.sum(F.char_length("text")) + F.count("*") - 1).alias("n"))
    return rows.select("doc_id", (F.floor(F.col("n") / 4) + 1).alias("tokens"))


CUES = {"waste": ("trash", "waste", "dispos"), "en": ("the", "and", "of"), "de": ("der", "die", "das"), "es": ("el", "que", "los"), "fr": ("le", "les", "des")}


@query(f"{U}, w AS (SELECT doc_id, seq, list_distinct(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM units) SELECT doc_id, seq, " + ", ".join(f"len(list_intersect(w, [{', '.join(repr(x) for x in v)}]))::INT AS hits_{k}" for k, v in CUES.items()) + " FROM w")
def h26_cue_hits(spark, sf):
    return i.units(spark, sf).select("doc_id", "seq", *[labels.cue_hits(t.words(F.col("text")), v).alias(f"hits_{k}") for k, v in CUES.items()])


@query(f"""{U}, w AS (SELECT doc_id, seq, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM units), h AS (SELECT doc_id, seq, {', '.join(f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(x) for x in v)}], x))) AS {k}" for k, v in CUES.items())} FROM w)
SELECT doc_id, seq, """ + ", ".join(f"CASE WHEN {'+'.join(CUES)} > 0 THEN round({k} / ({'+'.join(CUES)}), 9) ELSE 0.0 END AS w_{k}" for k in CUES) + " FROM h")
def h24_unit_labels(spark, sf):
    return lb.unit_labels(i.units(spark, sf), CUES).select("doc_id", "seq", *[F.round(F.col("labels")[k], 9).alias(f"w_{k}") for k in CUES])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, 'Step ' || (l_partkey % 40 + 1) AS shown, strpos('see step ' || l_suppkey || ' here', 'step') AS at FROM lineitem WHERE l_returnflag = 'R'""")
def h21_show_ref(spark, sf):
    rows = i.table(spark, sf, "lineitem").where("l_returnflag = 'R'").withColumn("text", F.concat(F.lit("see step "), F.col("l_suppkey").cast("string"), F.lit(" here")))
    shown = labels.show_ref(F.lit("Step 1"), (F.col("l_partkey") % 40 + 1).cast("string"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", shown.alias("shown"), F.instr("text", "step").cast("long").alias("at"))


@query("""SELECT o_orderkey, replace(replace('see ' || o_orderpriority || ' and ' || o_orderstatus, o_orderpriority, '{{ref:p}}'), ' and ' || o_orderstatus, ' and {{ref:s}}') AS tokenized FROM orders""")
def h20_tokenize_refs(spark, sf):
    rows = i.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("see "), F.col("o_orderpriority"), F.lit(" and "), F.col("o_orderstatus")).alias("x"), "o_orderpriority", F.concat(F.lit(" and "), F.col("o_orderstatus")).alias("s"))
    return rows.select("o_orderkey", labels.tokenize(F.col("x"), [(F.col("o_orderpriority"), F.lit("{{ref:p}}")), (F.col("s"), F.lit(" and {{ref:s}}"))]).alias("tokenized"))


@query(f"""WITH {MAP}, o AS (SELECT target, unit, row_number() OVER (PARTITION BY target ORDER BY unit) AS new_pos FROM (SELECT DISTINCT target, unit FROM m))
SELECT a.target, a.unit, b.unit AS neighbour, a.new_pos > b.new_pos AS stays_below FROM o a JOIN o b ON a.target = b.target AND b.unit = a.unit - 1""")
def c19_relative_side(spark, sf):
    o = mapping(spark, sf).select("target", "unit").distinct().withColumn("new_pos", F.row_number().over(W.partitionBy("target").orderBy("unit")))
    return lb.relative_side(o, "target", "unit", F.col("unit") - 1)


@query("""WITH s AS (SELECT c_custkey AS id, c_name AS source FROM customer), g AS (SELECT o_custkey AS id, max(o_orderpriority) AS target FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT s.id, coalesce(target, source) AS text, target IS NULL AS fallback FROM s LEFT JOIN g ON s.id = g.id""")
def c32_write_back(spark, sf):
    g = i.table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("target"))
    return lb.write_back(i.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("source")), g, ["id"])


@query("""WITH u AS (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 20)) SELECT id, name, coalesce((SELECT min(r_regionkey) FROM region WHERE contains(u.name, substr(r_name, 1, 3))), -1)::INT AS target FROM u""")
def c33_align_unmapped(spark, sf):
    n = i.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    claimed = i.table(spark, sf, "supplier").where("s_suppkey < 20").select(F.col("s_nationkey").alias("id"))
    return lb.align_unmapped(n, claimed, i.table(spark, sf, "region").select(F.col("r_regionkey").alias("target"), F.substring("r_name", 1, 3).alias("part")), "id", "name", -1)


@query(f"""{E}, f AS (SELECT *, kind = 'list_item' AS x, kind = 'list_item' AND NOT coalesce(lag(kind = 'list_item') OVER (PARTITION BY doc_id ORDER BY seq), false) AS b FROM elements), n AS (SELECT *, sum(b::BIGINT) OVER (PARTITION BY doc_id ORDER BY seq)::BIGINT AS island FROM f WHERE x)
SELECT doc_id, island, bool_or(length(text) > 30) AS below FROM n GROUP BY 1, 2""")
def e27_below_tables(spark, sf):
    rows = structure.islands(i.elements(spark, sf), F.col("kind") == "list_item", ["doc_id"], ["seq"]).where("island is not null")
    return rows.groupBy("doc_id", "island").agg(F.bool_or(F.char_length("text") > 30).alias("below"))


@query("""WITH i AS (SELECT l_orderkey AS g, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN l_partkey END AS icon FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1),
s AS (SELECT *, first(icon ORDER BY n) OVER (PARTITION BY g) IS NOT NULL AND last(icon) OVER w IS NULL AS shift FROM i WINDOW w AS (PARTITION BY g ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT g, n, CASE WHEN shift THEN lag(icon) OVER (PARTITION BY g ORDER BY n) ELSE icon END AS icon FROM s""")
def e28_heal_shifted_icons(spark, sf):
    one = i.table(spark, sf, "lineitem").withColumn("_k", F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey"))).where("_k = 1")
    return lb.heal_shift(one.select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("n"), F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("icon")), ["g"], "n", "icon")


@query(f"""{GRAMS}, known AS (SELECT lower(n_name) AS term FROM nation UNION SELECT term FROM df WHERE n_texts % 5 = 0), top AS (SELECT * FROM df WHERE NOT EXISTS (SELECT 1 FROM known WHERE contains(' ' || df.term || ' ', ' ' || known.term || ' ') OR contains(' ' || df.term || ' ', ' ' || known.term || 's ')))
SELECT term, size, n_texts FROM top ORDER BY n_texts DESC, size DESC, term LIMIT 80""")
def k17_find_terms(spark, sf):
    df = stored(terms.phrase_counts(i.units(spark, sf)), "terms")
    known = i.table(spark, sf, "nation").select(F.lower("n_name").alias("term")).union(df.where("n_texts % 5 = 0").select("term"))
    return terms.find_terms(df, known).orderBy(F.desc("n_texts"), F.desc("size"), "term").limit(80)


@query(f"""WITH {MAP} SELECT 'double' AS issue, unit::VARCHAR AS key FROM m WHERE mode <> 'copy' GROUP BY unit HAVING count(DISTINCT target) > 1 UNION ALL SELECT 'unaccounted', p_partkey::VARCHAR FROM part WHERE p_partkey NOT IN (SELECT unit FROM m WHERE kind = 'R')
UNION ALL SELECT 'missing_required', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey NOT IN (SELECT target FROM m WHERE mode = 'copy' AND kind = 'R')""")
def k6_validate_section_plan(spark, sf):
    m = mapping(spark, sf)
    say = lambda df, name, c: df.select(F.lit(name).alias("issue"), F.col(c).cast("string").alias("key"))
    double = ops.double_placed(m.where("mode <> 'copy'"), "unit", "target")
    lost = ops.unaccounted(i.table(spark, sf, "part").select(F.col("p_partkey").alias("unit")), "unit", m.where("kind = 'R'"))
    required = ops.sections_present(i.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("section_id")), m.where("mode = 'copy' and kind = 'R'").select(F.col("target").alias("section_id")), "section_id").where("not present")
    return say(double, "double", "unit").unionByName(say(lost, "unaccounted", "unit")).unionByName(say(required, "missing_required", "section_id"))


@query(f"""WITH {MAP}, c AS (SELECT DISTINCT target, unit FROM m WHERE kind = 'R'), p AS (SELECT DISTINCT target, unit FROM m WHERE kind = 'N')
SELECT target, count(*) FILTER (p.unit IS NULL) AS n_stray, (SELECT count(*) FROM p q WHERE q.target = c.target AND NOT EXISTS (SELECT 1 FROM c d WHERE d.target = q.target AND d.unit = q.unit)) AS n_uncited FROM c LEFT JOIN p USING (target, unit) GROUP BY target""")
def k11_draft_checks(spark, sf):
    m = mapping(spark, sf)
    return lb.draft_checks(m.where("kind = 'R'").select("target", "unit").distinct(), m.where("kind = 'N'").select("target", "unit").distinct(), "target", "unit")

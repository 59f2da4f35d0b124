"""Queries over section planning: orders as the sections of their customer's document, line items as units and as scores of targets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import planning
from ..operators.loops import stored
from . import inputs as i
from .registry import query

SECTIONS = """s0 AS (SELECT o_custkey AS doc, o_orderkey AS section, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ord, o_orderpriority AS priority FROM orders),
li AS (SELECT l_orderkey AS section, count(*) FILTER (l_returnflag <> 'N') AS n_units, bool_and(l_returnflag = 'N') AS all_boilerplate FROM lineitem GROUP BY 1),
s AS (SELECT a.doc, a.section, p.section AS parent, a.ord, CASE WHEN a.section % 13 = 0 THEN 'Table of  Contents' ELSE a.priority END AS heading, CASE WHEN a.section % 11 = 0 THEN '0' WHEN a.section % 3 > 0 THEN a.ord || '.' END AS number,
    coalesce(n_units, 0) AS n_units, coalesce(all_boilerplate, false) AS all_boilerplate FROM s0 a LEFT JOIN s0 p ON p.doc = a.doc AND p.ord = CASE WHEN a.ord % 9 = 1 THEN NULL WHEN a.ord % 3 = 0 THEN a.ord - 2 ELSE a.ord - 1 END LEFT JOIN li ON li.section = a.section),
sc AS (SELECT s.doc, l_orderkey AS section, l_suppkey % 5 AS target, max(l_quantity::BIGINT % 11) / 10 AS name, max(l_partkey % 11) / 10 AS content FROM lineitem JOIN s ON s.section = l_orderkey GROUP BY ALL)"""


def sections(spark, sf):
    """(sections, scores): roots every ninth order, below them chains and pairs, up to six levels deep."""
    by = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    s = i.table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("section"), F.row_number().over(by).alias("ord"), F.col("o_orderpriority").alias("priority"))
    above = F.when(F.col("ord") % 9 != 1, F.when(F.col("ord") % 3 == 0, F.col("ord") - 2).otherwise(F.col("ord") - 1))
    parents = s.select("doc", F.col("ord").alias("_up"), F.col("section").alias("parent"))
    lines = i.table(spark, sf, "lineitem")
    facts = lines.groupBy(F.col("l_orderkey").alias("section")).agg(F.count_if(F.col("l_returnflag") != "N").alias("n_units"), F.bool_and(F.col("l_returnflag") == "N").alias("all_boilerplate"))
    heading = F.when(F.col("section") % 13 == 0, "Table of  Contents").otherwise(F.col("priority"))
    number = F.when(F.col("section") % 11 == 0, "0").when(F.col("section") % 3 > 0, F.concat(F.col("ord").cast("string"), F.lit(".")))
    out = s.withColumn("_up", above).join(parents, ["doc", "_up"], "left").join(facts, "section", "left").na.fill(0, ["n_units"]).na.fill(False, ["all_boilerplate"])
    out = stored(out.select("doc", "section", "parent", "ord", heading.alias("heading"), number.alias("number"), "n_units", "all_boilerplate"), "sections")
    scores = lines.join(out.select("doc", F.col("section").alias("l_orderkey")), "l_orderkey").groupBy("doc", F.col("l_orderkey").alias("section"), (F.col("l_suppkey") % 5).alias("target"))
    return out, scores.agg((F.max(F.col("l_quantity").cast("long") % 11) / 10).alias("name"), (F.max(F.col("l_partkey") % 11) / 10).alias("content"))


DECISIONS = f"""{SECTIONS},
c AS (SELECT *, round(CASE WHEN max(name) OVER w >= 0.8 THEN 0.7::DOUBLE * name + (1 - 0.7::DOUBLE) * content ELSE 0.35::DOUBLE * name + (1 - 0.35::DOUBLE) * content END, 3) AS score, max(name) OVER w AS top_name FROM sc WINDOW w AS (PARTITION BY doc, section)),
b AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second_score, lead(target) OVER w AS second FROM c WINDOW w AS (PARTITION BY doc, section ORDER BY score DESC, target)),
best AS (SELECT *, score - coalesce(second_score, 0) AS margin FROM b WHERE n = 1),
alt AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc, section ORDER BY content DESC, target) = 1),
r AS (SELECT s.*, best.target, best.score, margin, second, top_name, min(ord) FILTER (number <> '0' AND regexp_matches(number, '^[0-9]+(\\.|$)')) OVER (PARTITION BY s.doc) AS first FROM s LEFT JOIN best USING (doc, section) WHERE parent IS NULL),
k AS (SELECT *, CASE WHEN heading LIKE 'Table%' THEN 'contents' WHEN number = '0' THEN 'cover' WHEN ord < first THEN 'front matter' WHEN score IS NULL OR score < 0.3 THEN 'no match' WHEN all_boilerplate AND top_name < 0.8 THEN 'administrative' ELSE 'best match' END AS reason FROM r),
d AS (SELECT doc, section, parent, CASE WHEN reason = 'best match' THEN target END AS target, CASE reason WHEN 'best match' THEN 'mapped' WHEN 'no match' THEN 'unresolved' ELSE 'omit' END AS kind, reason,
    CASE reason WHEN 'best match' THEN least(1, floor((round(margin * 1000) + 305) / 10) / 100) WHEN 'no match' THEN 0 WHEN 'administrative' THEN 0.9 ELSE 1 END::DOUBLE AS confidence,
    CASE WHEN reason = 'no match' THEN 'no confident match' WHEN reason = 'best match' AND round(margin, 3) < 0.25 THEN 'close call: ' || target || ' vs ' || second END AS doubt, false AS inherited, NULL::BIGINT AS moved_from FROM k
  UNION ALL
  SELECT doc, section, parent, CASE WHEN toc THEN NULL WHEN moves THEN alt_target ELSE target END, CASE WHEN toc THEN 'omit' WHEN moves THEN 'mapped' ELSE kind END, CASE WHEN toc THEN 'contents' WHEN moves THEN 'content belongs elsewhere' ELSE 'inherited' END,
    CASE WHEN toc THEN 1 WHEN moves THEN least(1, floor((round(gap * 1000) + 305) / 10) / 100) WHEN other AND gap >= 0.3 THEN least(confidence, 0.5) ELSE confidence END::DOUBLE, CASE WHEN NOT toc AND NOT moves AND other AND gap >= 0.3 THEN 'content suggests ' || alt_target END, NOT toc AND NOT moves, CASE WHEN NOT toc AND moves THEN target END
  FROM (SELECT *, other AND gap >= 0.45 AND n_units >= 3 AS moves FROM (SELECT s.doc, s.section, s.parent, s.n_units, s.heading LIKE 'Table%' AS toc, d.target, d.kind, d.confidence, a.target AS alt_target, round(a.content - coalesce(h.content, 0), 3) AS gap,
    coalesce(d.kind = 'mapped' AND s.n_units >= 2 AND a.content > 0 AND a.target <> d.target, false) AS other FROM d JOIN s ON s.doc = d.doc AND s.parent = d.section LEFT JOIN alt a ON a.section = s.section LEFT JOIN sc h ON h.section = s.section AND h.target = d.target)))"""


@query(f"WITH RECURSIVE {DECISIONS} SELECT doc, section, parent, target, kind, reason, confidence, doubt, inherited, moved_from FROM d")
def k4_propose_sections(spark, sf):
    return planning.propose_sections(*sections(spark, sf))


@query(f"""WITH RECURSIVE {DECISIONS}, t AS (SELECT doc, section, section AS root FROM s WHERE parent IS NULL UNION ALL SELECT s.doc, s.section, t.root FROM t JOIN s ON s.doc = t.doc AND s.parent = t.section),
x AS (SELECT d.*, t.root, s.ord FROM d JOIN t USING (doc, section) JOIN s USING (doc, section)), sp AS (SELECT doc, root, count(DISTINCT target) > 1 AS is_split FROM x WHERE kind = 'mapped' GROUP BY ALL),
m AS (SELECT x.*, is_split FROM x JOIN sp USING (doc, root) WHERE kind = 'mapped'),
u AS (SELECT doc, target, string_agg(unit, ',' ORDER BY ord, n, unit) AS units FROM (SELECT m.doc, m.target, m.ord, l_linenumber AS n, l_orderkey || '-' || l_linenumber AS unit FROM m JOIN lineitem ON l_orderkey = m.section WHERE is_split) GROUP BY ALL),
f AS (SELECT doc, target, string_agg(section::VARCHAR, ',' ORDER BY ord) AS sections, count(DISTINCT root) AS roots, bool_or(doubt IS NOT NULL) AS doubted, round(min(confidence), 2) AS confidence, coalesce(array_to_string(list_sort(list_distinct(list(reason) FILTER (NOT inherited))), ','), '') AS reasons FROM m GROUP BY ALL)
SELECT doc, target, CASE WHEN units IS NOT NULL THEN 'split' WHEN roots > 1 THEN 'merge' ELSE 'one_to_one' END AS type, CASE WHEN doubted THEN 'needs_review' ELSE 'mapped' END AS status, sections, coalesce(units, '') AS units, confidence, reasons FROM f LEFT JOIN u USING (doc, target)
UNION ALL SELECT doc, target, 'unresolved', CASE WHEN target < 2 THEN 'source_content_not_found' ELSE 'not_applicable' END, '', '', 1, '' FROM (SELECT DISTINCT doc FROM d), (SELECT unnest(range(0, 6)) AS target) WHERE (doc, target) NOT IN (SELECT (doc, target) FROM f)
UNION ALL SELECT doc, NULL, kind, CASE kind WHEN 'omit' THEN 'not_applicable' ELSE 'needs_review' END, string_agg(section::VARCHAR, ',' ORDER BY ord), '', arg_min(confidence, ord), arg_min(reason, ord) FROM x WHERE kind <> 'mapped' GROUP BY doc, root, kind""")
def k5_build_section_plan(spark, sf):
    s, scores = sections(spark, sf)
    units = i.table(spark, sf, "lineitem").join(s.select("doc", F.col("section").alias("l_orderkey")), "l_orderkey").select("doc", F.col("l_orderkey").alias("section"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("unit"), F.col("l_linenumber").alias("n"))
    targets = i.table(spark, sf, "supplier").select((F.col("s_suppkey") % 6).alias("target")).distinct().withColumn("required", F.col("target") < 2)
    plan = planning.build_section_plan(planning.propose_sections(s, scores), s, units, targets)
    return plan.select("doc", "target", "type", "status", F.array_join("sections", ",").alias("sections"), F.array_join("units", ",").alias("units"), "confidence", F.array_join("reasons", ",").alias("reasons"))


MATCH = {"R": {"0": 1.0, "1": 0.4}, "A": {"2": 0.8, "3": 0.5, "4": 0.2}, "N": {"1": 0.3}}


@query("""WITH l AS (SELECT l_orderkey AS section, l_returnflag AS label, count(*) / sum(count(*)) OVER (PARTITION BY l_orderkey) AS share FROM lineitem GROUP BY 1, 2),
t AS (SELECT s_suppkey % 7 AS target, s_nationkey % 5 AS type FROM supplier GROUP BY ALL), w AS (SELECT * FROM (VALUES ('R', 0, 1.0), ('R', 1, 0.4), ('A', 2, 0.8), ('A', 3, 0.5), ('A', 4, 0.2), ('N', 1, 0.3)) v(label, type, w)),
f AS (SELECT target, label, max(w)::DOUBLE AS w FROM t JOIN w USING (type) GROUP BY ALL) SELECT section, target, round(sum(share * w), 6) AS label_score FROM l JOIN f USING (label) GROUP BY ALL""")
def h25_label_score(spark, sf):
    n = i.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("section"), F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"))
    profiles = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("section")))
    targets = i.table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 7).alias("target")).agg(F.collect_set((F.col("s_nationkey") % 5).cast("string")).alias("types"))
    return planning.label_scores(profiles, targets, ["section"], "target", MATCH).withColumn("label_score", F.round("label_score", 6))

"""Queries over issues, gates, plans and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import plans as ops
from ..operators import quality
from . import inputs as i
from .registry import query

GATES = ", ".join(f"('{g}')" for g in quality.GATES)
RANK = "CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END"


@query(f"WITH {i.ISSUES}, g(gate) AS (VALUES {GATES}) SELECT g.gate, count(issue_id) AS n FROM g LEFT JOIN issues ON g.gate = issues.gate AND NOT resolved GROUP BY 1")
def d6_gate_counts(spark, sf):
    return quality.gate_counts(spark, i.issues(spark, sf))


PER = ", ".join(f"count(*) FILTER (NOT resolved AND severity = '{s}') AS n_{s}" for s in quality.SEVERITIES)


@query(f"""WITH {i.ISSUES}, s AS (SELECT job_id, count(*) FILTER (NOT resolved) AS n_open, {PER}, count(*) FILTER (NOT resolved AND gate IS NOT NULL) AS n_gate FROM issues GROUP BY 1)
SELECT *, n_gate = 0 AND n_high = 0 AND n_critical = 0 AS passed FROM s""")
def d7_issue_summary(spark, sf):
    return quality.issue_summary(i.issues(spark, sf), ["job_id"])


@query(f"""WITH {i.ISSUES}, o AS (SELECT * FROM issues WHERE NOT resolved)
SELECT 'gate' AS dim, coalesce(gate, 'none') AS value, count(*) AS n FROM o GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM o GROUP BY 2
UNION ALL SELECT 'section', section_id::VARCHAR, count(*) FROM o GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM o HAVING count(*) > 0""")
def d8_issue_cube(spark, sf):
    return quality.issue_cube(i.issues(spark, sf))


@query(f"""WITH {i.ISSUES}, w AS (SELECT job_id, max(CASE WHEN NOT resolved THEN CASE WHEN gate IS NOT NULL THEN 4 ELSE {RANK} END END) AS w FROM issues GROUP BY 1)
SELECT job_id, CASE WHEN w >= 3 THEN 'HUMAN_REVIEW' WHEN w = 2 THEN 'COMPLETED_WITH_WARNINGS' ELSE 'COMPLETED' END AS status FROM w""")
def d9_final_status(spark, sf):
    return quality.final_status(i.issues(spark, sf), ["job_id"])


@query(f"""WITH {i.ISSUES} SELECT section_id, CASE WHEN bool_or(NOT resolved AND severity = 'critical') THEN 'NEEDS_REVIEW' WHEN bool_or(NOT resolved AND gate IS NOT NULL) THEN 'REPAIRING' ELSE 'VALIDATED' END AS status FROM issues GROUP BY 1""")
def d33_section_status(spark, sf):
    return ops.section_status(i.issues(spark, sf))


@query(f"WITH {i.ISSUES} SELECT issue_id, severity, section_id FROM issues ORDER BY resolved, gate IS NULL, {RANK} DESC, section_id, issue_id")
def f1_sort_issues(spark, sf):
    return i.issues(spark, sf).orderBy(*quality.sort_order()).select("issue_id", "severity", "section_id")


@query(f"""WITH {i.ISSUES}, n AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY {RANK} DESC, issue_id) AS r FROM issues WHERE NOT resolved)
SELECT section_id, issue_id, severity FROM n WHERE r <= 12 ORDER BY section_id, {RANK} DESC, issue_id LIMIT 60""")
def f4_capped_previews(spark, sf):
    rows = i.issues(spark, sf).where("not resolved").withColumn("_r", -quality.rank(F.col("severity")))
    return quality.capped(rows, "section_id", ["_r", "issue_id"], 12, 60).select("section_id", "issue_id", "severity")


@query(f"""WITH {i.ISSUES}, a AS (SELECT job_id, list(issue_id ORDER BY issue_id) AS ids FROM issues WHERE NOT resolved GROUP BY 1)
SELECT job_id, array_to_string(ids[1:3], ', ') || CASE WHEN len(ids) > 3 THEN ' and ' || (len(ids) - 3) || ' more' ELSE '' END AS shown FROM a""")
def f6_listed(spark, sf):
    a = i.issues(spark, sf).where("not resolved").groupBy("job_id").agg(F.array_sort(F.collect_list("issue_id")).alias("ids"))
    return a.select("job_id", quality.listed(F.col("ids"), 3).alias("shown"))


@query(f"""WITH {i.ISSUES}, p AS (SELECT issue_id FROM issues WHERE resolved AND severity = 'low'), e AS (SELECT DISTINCT section_id FROM issues WHERE severity = 'critical' AND gate = 'coverage')
SELECT issue_id, ((resolved AND severity <> 'low') OR issue_id IN (SELECT issue_id FROM p)) AND section_id NOT IN (SELECT section_id FROM e) AS resolved FROM issues""")
def g9_carry_resolutions(spark, sf):
    issues = i.issues(spark, sf)
    now = issues.withColumn("resolved", F.col("resolved") & (F.col("severity") != "low"))
    edited = issues.where("severity = 'critical' and gate = 'coverage'").select("section_id")
    return quality.carry_resolutions(now, issues.where("severity = 'low'"), edited).select("issue_id", "resolved")


@query(f"""WITH {i.ISSUES}, u AS (SELECT issue_id, severity, section_id, 0 AS c FROM issues UNION ALL SELECT issue_id, 'critical', section_id, 1 FROM issues WHERE gate = 'coverage')
SELECT issue_id, severity, section_id FROM u QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY c DESC) = 1""")
def g10_union_issues(spark, sf):
    a = i.issues(spark, sf).select("issue_id", "severity", "section_id", "gate")
    b = a.where("gate = 'coverage'").withColumn("severity", F.lit("critical"))
    return quality.union_issues([a.drop("gate"), b.drop("gate")])


@query("""SELECT 'no_lines' AS rule, o_orderkey::VARCHAR AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'negative_balance', c_custkey::VARCHAR FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'late_high_discount', l_orderkey::VARCHAR FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07
UNION ALL SELECT 'unique_id', l_orderkey::VARCHAR FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def b14_expectations(spark, sf):
    o, c, li = (i.table(spark, sf, t) for t in ("orders", "customer", "lineitem"))
    bare = o.join(li.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_anti")
    return quality.expectations({
        "no_lines": (bare, F.lit(True), "o_orderkey"), "negative_balance": (c, F.col("c_acctbal") < 0, "c_custkey"),
        "late_high_discount": (li, (F.col("l_discount") > 0.09) & (F.col("l_tax") > 0.07), "l_orderkey"),
        "unique_id": (li.groupBy("l_orderkey", "l_linenumber").count(), F.col("count") > 1, "l_orderkey"),
    })


# Plans: suppliers stand for target sections, parts for source units, line items for the mapping between them.
MAP = "m AS (SELECT DISTINCT l_suppkey AS target, l_partkey AS unit, l_returnflag AS kind, l_shipmode AS mode FROM (SELECT *, CASE WHEN l_quantity < 3 THEN 'copy' ELSE 'rewrite' END AS l_shipmode FROM lineitem))"


def mapping(spark, sf):
    mode = F.when(F.col("l_quantity") < 3, "copy").otherwise("rewrite")
    return i.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("unit"), F.col("l_returnflag").alias("kind"), mode.alias("mode")).distinct()


@query("""SELECT 'customer' AS kind, o_custkey::VARCHAR AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)
UNION SELECT 'part', l_partkey::VARCHAR FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)""")
def c2_orphan_ids(spark, sf):
    o, li = i.table(spark, sf, "orders"), i.table(spark, sf, "lineitem")
    c, p = i.table(spark, sf, "customer").where("c_custkey % 3 <> 0"), i.table(spark, sf, "part").where("p_size > 2")
    return ops.orphans({"customer": (o.select("o_custkey"), c.select("c_custkey")), "part": (li.select("l_partkey"), p.select("p_partkey"))})


@query(f"WITH {MAP} SELECT p_partkey AS unit FROM part WHERE p_partkey NOT IN (SELECT unit FROM m WHERE kind <> 'R') AND p_partkey NOT IN (SELECT unit FROM m WHERE mode = 'copy')")
def c3_unaccounted_units(spark, sf):
    m = mapping(spark, sf)
    return ops.unaccounted(i.table(spark, sf, "part").select(F.col("p_partkey").alias("unit")), "unit", m.where("kind <> 'R'"), m.where("mode = 'copy'"))


@query(f"""WITH {MAP}, s AS (SELECT target, unit, max((kind = 'A')::INT) OVER (PARTITION BY target, mode) AS any_listed, kind FROM m)
SELECT DISTINCT target, unit FROM s WHERE any_listed = 0 OR kind = 'A'""")
def c4_covered_units(spark, sf):
    return ops.covered_units(mapping(spark, sf).withColumn("listed", F.col("kind") == "A"), ["target", "mode"], "unit").select("target", "unit").distinct()


@query(f"WITH {MAP} SELECT unit, count(DISTINCT target) AS n_targets FROM m WHERE mode <> 'copy' GROUP BY unit HAVING count(DISTINCT target) > 1")
def c5_double_placed(spark, sf):
    return ops.double_placed(mapping(spark, sf).where("mode <> 'copy'"), "unit", "target")


@query(f"WITH {MAP}, planned AS (SELECT DISTINCT target, unit FROM m WHERE kind = 'N') SELECT DISTINCT target, unit FROM m WHERE kind = 'R' AND NOT EXISTS (SELECT 1 FROM planned p WHERE p.target = m.target AND p.unit = m.unit)")
def c6_stray_citations(spark, sf):
    m = mapping(spark, sf)
    return ops.stray_citations(m.where("kind = 'R'").select("target", "unit"), m.where("kind = 'N'").select("target", "unit"), ["target", "unit"])


@query(f"WITH {MAP}, cited AS (SELECT DISTINCT target, unit FROM m WHERE kind = 'R') SELECT DISTINCT target, unit FROM m WHERE kind = 'N' AND NOT EXISTS (SELECT 1 FROM cited p WHERE p.target = m.target AND p.unit = m.unit)")
def c7_uncited_units(spark, sf):
    m = mapping(spark, sf)
    return ops.stray_citations(m.where("kind = 'N'").select("target", "unit"), m.where("kind = 'R'").select("target", "unit"), ["target", "unit"])


@query(f"WITH {MAP} SELECT target, unit FROM (SELECT DISTINCT target, unit, mode FROM m) x WHERE NOT (mode = 'copy' AND EXISTS (SELECT 1 FROM m y WHERE y.target = x.target AND y.unit = x.unit AND y.mode = 'rewrite'))")
def c8_planned_units(spark, sf):
    m = mapping(spark, sf).select("target", "unit", "mode").distinct()
    return ops.planned_units(m.where("mode = 'copy'"), m.where("mode = 'rewrite'"), ["target", "unit"]).select("target", "unit")


@query(f"""WITH {MAP}, d AS (SELECT DISTINCT unit, target FROM m WHERE kind = 'N') SELECT p_brand AS section_id, count(*) AS n_units, count(d.unit) AS n_placed, count(d.unit) / count(*) AS coverage
FROM part LEFT JOIN (SELECT DISTINCT unit FROM d) d ON p_partkey = d.unit GROUP BY 1""")
def d14_coverage(spark, sf):
    units = i.table(spark, sf, "part").select(F.col("p_brand").alias("section_id"), F.col("p_partkey").alias("unit"))
    return ops.coverage(units, mapping(spark, sf).where("kind = 'N'").select("unit").distinct(), "section_id", "unit")


@query("""SELECT l_orderkey AS slot_id, l_linenumber AS claim_no, l_partkey AS position, after FROM (SELECT *, max(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM lineitem) WHERE l_partkey < after""")
def e16_order_violations(spark, sf):
    from ..operators import structure

    rows = i.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slot_id"), F.col("l_linenumber").alias("claim_no"), F.col("l_partkey").alias("position"), F.col("l_suppkey").alias("section"))
    return structure.order_violations(rows, ["slot_id"], ["claim_no", "position", "section"], "position").drop("section")


@query("""WITH s AS (SELECT l_partkey AS source, l_suppkey AS target, sum(l_quantity)::BIGINT AS score FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS n, lead(score) OVER (PARTITION BY source ORDER BY score DESC, target) AS second FROM s)
SELECT source, target, score, score - coalesce(second, 0) AS margin FROM r WHERE n = 1""")
def e18_best_and_margin(spark, sf):
    s = i.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).agg(F.sum("l_quantity").cast("long").alias("score"))
    return ops.best_and_margin(s, "source", "target", "score")


@query("""WITH o AS (SELECT o_orderkey AS source, o_totalprice AS price FROM orders), t AS (SELECT r_regionkey AS target, r_name FROM region)
SELECT target, count(*) AS n, sum((source % 7 = target)::BIGINT)::BIGINT AS hits FROM o CROSS JOIN t GROUP BY 1""")
def c22_score_matrix(spark, sf):
    o = i.table(spark, sf, "orders").select(F.col("o_orderkey").alias("source"))
    t = i.table(spark, sf, "region").select(F.col("r_regionkey").alias("target"))
    pairs = ops.score_matrix(o, t, (F.col("source") % 7 == F.col("target")).cast("long"))
    return pairs.groupBy("target").agg(F.count("*").alias("n"), F.sum("score").alias("hits"))


@query("""SELECT n_nationkey AS section_id, coalesce(CASE WHEN r_regionkey IN (1, 3) THEN upper(r_name) END, n_name) AS heading, n_regionkey = 2 AS optional FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def c31_apply_overrides(spark, sf):
    detected = i.table(spark, sf, "nation").select(F.col("n_nationkey").alias("section_id"), F.col("n_name").alias("heading"), "n_regionkey")
    over = i.table(spark, sf, "region").where("r_regionkey in (1, 3)").select(F.col("r_regionkey").alias("n_regionkey"), F.upper("r_name").alias("heading"))
    return ops.apply_overrides(detected, over, "n_regionkey", ["heading"]).select("section_id", "heading", (F.col("n_regionkey") == 2).alias("optional"))


@query(f"WITH {MAP} SELECT unit FROM (SELECT DISTINCT unit FROM m WHERE kind = 'N') EXCEPT SELECT unit FROM m WHERE kind = 'R' EXCEPT SELECT unit FROM m WHERE mode = 'copy'")
def g13_uncovered_guidance(spark, sf):
    m = mapping(spark, sf)
    return ops.uncovered(m.where("kind = 'N'").select("unit"), m.where("kind = 'R'").select("unit"), m.where("mode = 'copy'").select("unit"))


@query(f"WITH {MAP} SELECT s_suppkey AS section_id, s_suppkey IN (SELECT target FROM m WHERE mode = 'copy' AND kind = 'R') AS present FROM supplier")
def g11_sections_present(spark, sf):
    sections = i.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("section_id"))
    live = mapping(spark, sf).where("mode = 'copy' and kind = 'R'").select(F.col("target").alias("section_id"))
    return ops.sections_present(sections, live, "section_id")


@query(f"WITH {MAP} SELECT target, string_agg(unit::VARCHAR, ' ' ORDER BY unit) AS units FROM (SELECT DISTINCT target, unit FROM m) GROUP BY target")
def a10_trace_csv(spark, sf):
    return ops.trace_rows(mapping(spark, sf).select("target", "unit").distinct(), ["target"], "unit", "unit", "units")


@query("""SELECT count(*) AS n_claims, count(DISTINCT l_partkey) AS n_units, l_orderkey % 10 AS bucket FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 3""")
def c1_claims_by_unit(spark, sf):
    li = i.table(spark, sf, "lineitem").where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("units"), F.count("*").alias("k"))
    lines = li.select((F.col("l_orderkey") % 10).alias("bucket"), "k")
    bridge = ops.claims_by_unit(li.select(F.col("l_orderkey").alias("claim_id"), "units"), "claim_id", "units")
    return lines.groupBy("bucket").agg(F.sum("k").alias("n_claims")).join(bridge.groupBy((F.col("claim_id") % 10).alias("bucket")).agg(F.count_distinct("unit_id").alias("n_units")), "bucket")

"""Queries over slot plans and quality reports: orders as sections with five slots, line items as the units placed in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation
from ..operators.loops import stored
from . import inputs as i
from .registry import query

#: Line items: units of their order's section; the supplier decides the slot (0 to 4; 5: region, 6: set aside, 7: nowhere, 8: also in the next section), the part the place in it.
SLOTS = """li AS (SELECT o_custkey AS doc, l_orderkey AS section, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS unit, l_linenumber AS seq, l_suppkey * 7 % 9 AS k, l_partkey AS pos FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
scope AS (SELECT doc, section, unit, min(seq) AS seq FROM li GROUP BY ALL), placed AS (SELECT doc, section, CASE WHEN k < 5 THEN k END AS slot, unit, min(pos) AS pos FROM li WHERE k < 6 AND section % 11 > 0 GROUP BY ALL UNION ALL SELECT doc, section + 1, 0, unit, min(pos) FROM li WHERE k = 8 GROUP BY ALL),
unplaced AS (SELECT DISTINCT doc, section, unit FROM li WHERE k = 6 AND section % 11 > 0),
slots AS (SELECT o_custkey AS doc, o_orderkey AS section, unnest(range(0, 5)) AS slot FROM orders), sl AS (SELECT *, slot <> 1 AS required, CASE WHEN slot IN (2, 3) THEN 'g' END AS grp FROM slots),
mappings AS (SELECT doc, section, slot, CASE (section + slot) % 7 WHEN 0 THEN 'source_content_not_found' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'not_applicable' ELSE 'mapped' END AS status, section % 5 = 0 AS review FROM slots WHERE section % 11 > 0 AND (section + slot) % 13 > 0)"""


def slot_plan(spark, sf):
    """(scope, slots, mappings, placed, unplaced)."""
    orders = i.table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("section"))
    li = i.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("section"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("unit"), F.col("l_linenumber").alias("seq"), (F.col("l_suppkey") * 7 % 9).alias("k"), F.col("l_partkey").alias("pos")).join(orders.hint("merge"), "section").distinct()
    li = stored(li, "slot-items")
    here = F.col("section") % 11 > 0
    # Items are distinct, a unit's name holds its place and number, and slots are numbers of suppliers below 6: no selection of them says anything twice but the scope, whose copies count once.
    placed = li.where((F.col("k") < 6) & here).select("doc", "section", F.when(F.col("k") < 5, F.col("k")).alias("slot"), "unit", "pos")
    moved = li.where("k = 8").select("doc", (F.col("section") + 1).alias("section"), F.lit(0).cast("long").alias("slot"), "unit", "pos")
    slots = orders.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    k = (F.col("section") + F.col("slot")) % 7
    status = F.when(k == 0, "source_content_not_found").when(k == 1, "needs_review").when(k == 2, "not_applicable").otherwise("mapped")
    mappings = slots.where(here & ((F.col("section") + F.col("slot")) % 13 > 0)).withColumn("status", status).withColumn("review", F.col("section") % 5 == 0)
    scope = li.select("doc", "section", "unit", "seq")
    return scope, slots.withColumn("required", F.col("slot") != 1).withColumn("grp", F.when(F.col("slot").isin(2, 3), "g")), mappings, placed.unionByName(moved), li.where((F.col("k") == 6) & here).select("doc", "section", "unit")


ISSUES = f"""{SLOTS}, sections AS (SELECT DISTINCT doc, section FROM sl), touched AS (SELECT doc, section FROM mappings UNION SELECT doc, section FROM placed UNION SELECT doc, section FROM unplaced), known AS (SELECT * FROM sections SEMI JOIN touched USING (doc, section)),
mine AS (SELECT DISTINCT doc, section, unit FROM scope SEMI JOIN known USING (doc, section)), used AS (SELECT DISTINCT doc, section, unit FROM placed), acc AS (SELECT * FROM used UNION SELECT * FROM unplaced), sq AS (SELECT doc, unit, min(seq) AS seq FROM scope GROUP BY ALL),
st AS (SELECT sl.*, m.slot IS NOT NULL AS mapped, m.status, coalesce(m.review, false) AS review, f.slot IS NOT NULL AS filled, coalesce(bad, false) AS bad, coalesce(m.status = 'source_content_not_found', false) AS gap FROM sl SEMI JOIN known USING (doc, section) LEFT JOIN mappings m USING (doc, section, slot)
  LEFT JOIN (SELECT doc, section, slot, bool_or(seq < before) AS bad FROM (SELECT p.*, coalesce(seq, 0) AS seq, lag(coalesce(seq, 0)) OVER (PARTITION BY p.doc, section, slot ORDER BY pos, p.unit) AS before FROM placed p LEFT JOIN sq ON sq.doc = p.doc AND sq.unit = p.unit WHERE slot IS NOT NULL) GROUP BY ALL) f USING (doc, section, slot)),
s2 AS (SELECT *, sum((mapped AND (filled OR gap))::INT) OVER (PARTITION BY doc, section, grp) - (mapped AND (filled OR gap))::INT AS others, EXISTS (SELECT 1 FROM scope WHERE scope.doc = st.doc AND scope.section = st.section) AS scoped FROM st),
u AS (SELECT 'unaccounted' AS issue, 'critical' AS severity, 'unaccounted_source' AS gate, doc, section, unit FROM mine ANTI JOIN acc USING (doc, section, unit) UNION ALL SELECT 'outside', 'high', 'unaccounted_source', doc, section, unit FROM (SELECT * FROM used SEMI JOIN known USING (doc, section)) ANTI JOIN mine USING (doc, section, unit)
  UNION ALL SELECT 'unplaced', 'medium', NULL, doc, section, unit FROM unplaced SEMI JOIN known USING (doc, section)),
issues AS (SELECT doc, section, NULL::BIGINT AS slot, 'no_plan' AS issue, 'high' AS severity, 'missing_slot' AS gate, '' AS units FROM sections ANTI JOIN touched USING (doc, section)
  UNION ALL SELECT u.doc, section, NULL, issue, severity, gate, string_agg(u.unit, ' ' ORDER BY coalesce(seq, 0), u.unit) FROM u LEFT JOIN sq ON sq.doc = u.doc AND sq.unit = u.unit GROUP BY ALL
  UNION ALL SELECT doc, section, slot, 'no_mapping', 'high', 'missing_slot', '' FROM s2 WHERE NOT mapped UNION ALL SELECT doc, section, slot, 'order', 'high', 'sequence_violation', '' FROM s2 WHERE mapped AND filled AND bad
  UNION ALL SELECT doc, section, slot, 'review', 'medium', NULL, '' FROM s2 WHERE mapped AND filled AND (review OR status = 'needs_review') UNION ALL SELECT doc, section, slot, 'gap', 'medium', NULL, '' FROM s2 WHERE mapped AND NOT filled AND gap
  UNION ALL SELECT doc, section, slot, 'required', 'high', 'missing_slot', '' FROM s2 WHERE mapped AND NOT filled AND NOT gap AND required AND scoped AND (grp IS NULL OR others = 0))"""


@query(f"WITH {ISSUES} SELECT * FROM issues")
def k9_validate_slot_plan(spark, sf):
    return validation.validate_slot_plan(*slot_plan(spark, sf))[0].withColumn("units", F.array_join("units", " "))


@query(f"WITH {ISSUES}, h AS (SELECT DISTINCT s.doc, s.unit, bool_or(acc.unit IS NOT NULL) OVER (PARTITION BY s.doc, s.unit) AS hit FROM scope s LEFT JOIN acc ON acc.doc = s.doc AND acc.section = s.section AND acc.unit = s.unit) SELECT doc, count(*) AS n_units, count(*) FILTER (hit) AS n_accounted, round(count(*) FILTER (hit) / count(*), 3) AS coverage FROM h GROUP BY doc")
def k9b_slot_plan_coverage(spark, sf):
    return validation.validate_slot_plan(*slot_plan(spark, sf))[1]


REPORT = f"""{ISSUES}, x AS (SELECT doc, section || '|' || coalesce(slot::VARCHAR, '') || '|' || issue AS issue_id, severity, gate, section % 3 = 0 AS critic, string_split(units, ' ') AS units FROM issues),
pv AS (SELECT doc, issue_id, 'seen ' || issue_id AS note FROM x WHERE length(issue_id) % 4 = 0), rk AS (SELECT DISTINCT doc, unit, CASE WHEN pos % 2 = 0 THEN 'safety' ELSE 'approval' END AS tag FROM li WHERE pos % 5 < 2),
tg AS (SELECT doc, issue_id, string_agg(DISTINCT tag, ', ' ORDER BY tag) AS risk FROM (SELECT doc, issue_id, unnest(units) AS unit FROM x) JOIN rk USING (doc, unit) GROUP BY ALL),
y AS (SELECT x.*, pv.note, pv.issue_id IS NOT NULL AS resolved, tg.risk FROM x LEFT JOIN pv USING (doc, issue_id) LEFT JOIN tg USING (doc, issue_id)),
z AS (SELECT *, gate IS NULL AND NOT resolved AND risk IS NOT NULL AND (severity IN ('high', 'critical') OR (severity = 'medium' AND NOT critic)) AS raised FROM y),
rep AS (SELECT doc, issue_id, CASE WHEN raised AND severity = 'medium' THEN 'high' ELSE severity END AS severity, CASE WHEN raised THEN 'high_risk_unresolved' ELSE gate END AS gate, resolved, note, CASE WHEN raised THEN risk END AS risk FROM z)"""


def _report(spark, sf):
    scope, slots, mappings, placed, unplaced = slot_plan(spark, sf)
    issues = validation.validate_slot_plan(scope, slots, mappings, placed, unplaced)[0]
    rows = issues.select("doc", F.concat(F.col("section").cast("string"), F.lit("|"), F.coalesce(F.col("slot").cast("string"), F.lit("")), F.lit("|"), "issue").alias("issue_id"), "severity", "gate", (F.col("section") % 3 == 0).alias("critic"), "units")
    rows = stored(rows, "slot-issues")
    previous = rows.select("doc", "issue_id", (F.char_length("issue_id") % 4 == 0).alias("resolved"), F.concat(F.lit("seen "), "issue_id").alias("note"))
    part = F.split_part("unit", F.lit("-"), F.lit(3)).cast("long")
    risks = scope.where(part % 5 < 2).select("doc", "unit", F.when(part % 2 == 0, "safety").otherwise("approval").alias("tag")).distinct()
    return validation.quality_report(rows, risks, previous)


@query(f"WITH {REPORT} SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY resolved, gate IS NULL, list_position(['critical', 'high', 'medium'], severity), issue_id) AS n, issue_id, severity, gate, resolved, note, risk FROM rep")
def k13_quality_report(spark, sf):
    return _report(spark, sf)[0].select("doc", "n", "issue_id", "severity", "gate", "resolved", "note", "risk")


@query(f"WITH {REPORT} SELECT doc, 'all' AS gate, count(*) FILTER (gate IS NOT NULL AND NOT resolved) AS n_open FROM rep GROUP BY doc UNION ALL SELECT doc, gate, count(*) FROM rep WHERE gate IS NOT NULL AND NOT resolved GROUP BY doc, gate")
def k13b_gates(spark, sf):
    return _report(spark, sf)[1]

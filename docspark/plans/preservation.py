"""Queries over obligations, roles, terms and quoted names: sentences put together from line items and page blocks; the SQL reads them again with its own patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import preservation
from . import inputs as i
from .registry import query

ACTORS = ("The Quality Manager", "The Manager", "Process Owners", "A QA Lead", "Only the Head of Quality Control", "Everybody", "Each Manager and the Lab Manager")
DUTIES = ("must", "must not", "should", "may", "will", "can only", "is not permitted to", "needs to", "could", "shouldn''t", "is")
IDS = ("BI-VQD-10095-S", "028-BIS-00493", "ISO 9001", "21 CFR Part 11", "AB-CD", "SOP-QA-7-REV2")
TERMS = ("Standard Operating Procedure (SOP)", "the Head of Quality (HQ)", "a Risk Assessment Report (RAR) and the Change Control Board (CCB)", "Corrective (x)", "Plan of Action (PA)")


def _among(values, number: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({number}) % {len(values)} + 1]"


PROSE = f"""prose AS (SELECT l_orderkey AS doc, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS unit, {_among(ACTORS, 'l_partkey')} || ' ' || {_among(DUTIES, 'l_suppkey + l_linenumber')} || ' keep ' || {_among(IDS, 'l_partkey + l_linenumber')}
  || '. Use ' || {_among(TERMS, 'l_suppkey * 3 + l_partkey')} || ' for lot ' || l_linenumber || '.' AS text FROM lineitem)"""


def prose(spark, sf):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v.replace("''", "'")) for v in values]), (n % len(values) + 1).cast("int"))
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    said = F.concat(pick(ACTORS, p), F.lit(" "), pick(DUTIES, s + n), F.lit(" keep "), pick(IDS, p + n), F.lit(". Use "), pick(TERMS, s * 3 + p), F.lit(" for lot "), n.cast("string"), F.lit("."))
    return i.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.concat_ws("-", "l_orderkey", n, p, s).alias("unit"), said.alias("text"))


@query(f"""WITH {PROSE}, x AS (SELECT unit, regexp_extract(text, 'keep (.*?)\\. Use', 1) AS id FROM prose) SELECT unit, upper(id) AS id FROM x WHERE regexp_matches(id, '[0-9]')""")
def h3b_document_ids(spark, sf):
    return prose(spark, sf).select("unit", F.explode_outer(t.extract(F.col("text"), t.DOCUMENT_IDS)).alias("id")).where("id is not null").select("unit", F.upper("id").alias("id"))


ROLES_SQL = "regexp_extract_all(regexp_replace(text, '^(The|A|Each) | the ', ' ', 'g'), '(Head of Quality Control|Head of Quality|Quality Manager|Lab Manager|Process Owners|QA Lead|Change Control Board|Manager)')"


@query(f"""WITH {PROSE}, x AS (SELECT unit, text, {ROLES_SQL} AS r FROM prose), y AS (SELECT DISTINCT unit, text, unnest(r) AS role FROM x) SELECT unit, role FROM y""")
def h17_roles(spark, sf):
    return preservation.role_rows(prose(spark, sf).select("unit", "text")).distinct()


@query(f"""WITH {PROSE}, s AS (SELECT DISTINCT unit, string_split(text, '. Use')[1] || '.' AS statement FROM prose), m AS (SELECT unit, statement, regexp_extract(statement, ' (must not|must|should|shouldn''t|may|will|can only|is not permitted|needs to|could) ', 1) AS said FROM s),
a AS (SELECT unit, regexp_extract(statement, '(Head of Quality Control|Quality Manager|Process Owners|QA Lead|Lab Manager|Manager)', 1) AS actor, statement, said FROM m)
SELECT unit, 0 AS pos, statement, CASE WHEN said IN ('must not', 'is not permitted') THEN 'prohibition' WHEN said LIKE 'should%' THEN 'recommended' WHEN said IN ('must', 'can only', 'needs to') THEN 'mandatory' WHEN said IN ('may', 'could') THEN 'permitted' ELSE 'future' END AS modality, nullif(actor, '') AS actor FROM a WHERE said <> ''
UNION ALL SELECT DISTINCT unit, 1, 'Use' || string_split(text, '. Use')[2], 'mandatory', CASE WHEN contains(text, 'Change Control Board') THEN 'Change Control Board' WHEN contains(text, 'Head of Quality (HQ)') THEN 'Head of Quality' END FROM prose""")
def h15_obligations(spark, sf):
    return preservation.obligations(prose(spark, sf).distinct(), "unit").distinct()


@query(rf"""WITH {PROSE}, x AS (SELECT DISTINCT unit, unnest(regexp_extract_all(text, '((?:[A-Z][a-z]+ (?:of )?)+)\(([A-Z]+)\)', 1)) AS term, unnest(regexp_extract_all(text, '((?:[A-Z][a-z]+ (?:of )?)+)\(([A-Z]+)\)', 2)) AS abbr FROM prose)
SELECT unit, regexp_replace(trim(term), '^Use ', '') AS term, abbr FROM x""")
def h16b_defined_terms(spark, sf):
    return preservation.term_rows(prose(spark, sf).select("unit", "text")).distinct()


@query(f"""WITH {PROSE}, c AS (SELECT unit, {_among(ACTORS, 'doc')} AS text FROM prose), r AS (SELECT DISTINCT unit, regexp_replace(lower(unnest({ROLES_SQL})), 's$', '') AS role FROM prose), q AS (SELECT DISTINCT unit, regexp_replace(lower(unnest({ROLES_SQL})), 's$', '') AS role FROM c)
SELECT unit, role, 'missing' AS change FROM (SELECT * FROM r EXCEPT SELECT * FROM q) UNION ALL SELECT unit, role, 'added' FROM (SELECT * FROM q EXCEPT SELECT * FROM r)""")
def g3_role_diff(spark, sf):
    units = prose(spark, sf)
    claims = units.select("unit", F.element_at(F.array(*map(F.lit, ACTORS)), (F.col("doc") % len(ACTORS) + 1).cast("int")).alias("text"))
    return preservation.role_diff(units, claims, "unit")


ACTOR_SQL = "regexp_extract(statement, '(Head of Quality Control|Quality Manager|Process Owners|QA Lead|Lab Manager|Manager)', 1)"


@query(rf"""WITH {PROSE}, p AS (SELECT doc, unit, text, regexp_extract(text, 'keep (.*?)\. Use', 1) AS id, regexp_extract(text, 'lot ([0-9]+)', 1) AS lot, string_split(text, '. Use')[1] || '.' AS statement, 'Use' || string_split(text, '. Use')[2] AS use FROM prose),
o AS (SELECT doc, unit, statement, {ACTOR_SQL} AS actor, regexp_extract(statement, ' (must not|must|should|shouldn''t|may|can only|is not permitted|needs to|could) ', 1) AS said FROM p)
SELECT doc, unit, 'value' AS fact, 'reference' AS kind, id AS raw, upper(id) AS normalized FROM p WHERE regexp_matches(id, '[0-9]') UNION ALL SELECT doc, unit, 'value', 'number', lot, lot FROM p
UNION ALL SELECT doc, unit, 'term', abbr, regexp_replace(trim(term), '^Use ', ''), regexp_replace(trim(term), '^Use ', '') FROM (SELECT doc, unit, unnest(regexp_extract_all(text, '((?:[A-Z][a-z]+ (?:of )?)+)\(([A-Z]+)\)', 1)) AS term, unnest(regexp_extract_all(text, '((?:[A-Z][a-z]+ (?:of )?)+)\(([A-Z]+)\)', 2)) AS abbr FROM prose)
UNION ALL SELECT doc, unit, 'role', NULL, role, regexp_replace(lower(role), 's$', '') FROM (SELECT doc, unit, unnest(list_distinct({ROLES_SQL})) AS role FROM prose)
UNION ALL SELECT doc, unit, 'role', NULL, short, CASE short WHEN 'HQ' THEN 'head of quality' ELSE 'change control board' END FROM (SELECT doc, unit, unnest(regexp_extract_all(text, '\((HQ|CCB)\)', 1)) AS short FROM prose)
UNION ALL SELECT doc, unit, 'obligation', CASE WHEN said IN ('must not', 'is not permitted') THEN 'prohibition' WHEN said LIKE 'should%' THEN 'recommended' WHEN said IN ('must', 'can only', 'needs to') THEN 'mandatory' ELSE 'permitted' END, statement, nullif(actor, '') FROM o WHERE said <> ''
UNION ALL SELECT doc, unit, 'obligation', 'mandatory', use, CASE WHEN contains(use, 'Change Control Board') THEN 'Change Control Board' WHEN contains(use, 'Head of Quality (HQ)') THEN 'Head of Quality' END FROM p""")
def k2b_document_facts(spark, sf):
    return preservation.extract_facts(prose(spark, sf), ["doc"], "unit")


# Drafts: every eleventh unit isn't cited; some claims change the days, the duty, the actor or the quoted title.
WHO, DOES, TITLES = ("The Quality Manager", "The Manager", "Process Owners", "A QA Lead"), ("must", "must not", "should", "may", "will"), ("Guide Alpha", "Guide Beta", "Code of Gamma")
DRAFT = f"""{i.ELEMENTS}, u AS (SELECT doc_id * 1000 + seq AS unit_id, seq + 1 AS n FROM elements WHERE kind IN ('paragraph', 'list_item')),
d AS (SELECT unit_id, n, unit_id AS w, unit_id AS m, unit_id AS q, false AS claim FROM u UNION ALL SELECT unit_id, CASE WHEN unit_id % 7 = 0 THEN 400 ELSE n END, unit_id + (unit_id % 13 = 0)::INT, unit_id + 2 * (unit_id % 17 = 0)::INT, unit_id + (unit_id % 19 = 0)::INT, true FROM u WHERE unit_id % 11 <> 0),
t AS (SELECT unit_id, claim, {_among(WHO, 'w')} || ' ' || {_among(DOES, 'm')} || ' do it within ' || n || ' days, see “' || {_among(TITLES, 'q')} || '” there.' AS text FROM d),
x AS (SELECT unit_id, claim, regexp_extract(text, 'within ([0-9]+) days', 1) AS n, regexp_extract(text, ' (must not|must|should|may|will) ', 1) AS duty, regexp_replace(lower(regexp_extract(text, '(Quality Manager|Process Owner|QA Lead|Manager)', 1)), 's$', '') AS who, regexp_extract(text, '“(.*)”', 1) AS title FROM t),
y AS (SELECT a.unit_id, a.n, b.n AS cn, CASE a.duty WHEN 'must not' THEN 'prohibition' WHEN 'should' THEN 'recommended' WHEN 'must' THEN 'mandatory' WHEN 'may' THEN 'permitted' ELSE 'future' END AS m,
  CASE b.duty WHEN 'must not' THEN 'prohibition' WHEN 'should' THEN 'recommended' WHEN 'must' THEN 'mandatory' WHEN 'may' THEN 'permitted' ELSE 'future' END AS cm, a.who, b.who AS cwho, a.title, b.title AS ctitle, b.unit_id IS NULL AS uncited FROM x a LEFT JOIN x b ON b.unit_id = a.unit_id AND b.claim WHERE NOT a.claim)"""


@query(f"""WITH {DRAFT} SELECT unit_id, 'uncited' AS issue, NULL AS kind, NULL AS lost, NULL AS added FROM y WHERE uncited UNION ALL SELECT unit_id, 'changed', 'deadline', '<=' || n || ' day', '<=' || cn || ' day' FROM y WHERE NOT uncited AND n <> cn
UNION ALL SELECT unit_id, 'modality_lost', 'modality', m, NULL FROM y WHERE NOT uncited AND m <> cm UNION ALL SELECT unit_id, 'modality_added', 'modality', NULL, cm FROM y WHERE NOT uncited AND m <> cm
UNION ALL SELECT unit_id, 'role_missing', 'role', who, NULL FROM y WHERE NOT uncited AND who <> cwho UNION ALL SELECT unit_id, 'role_added', 'role', NULL, cwho FROM y WHERE NOT uncited AND who <> cwho
UNION ALL SELECT unit_id, 'quote_lost', 'quote', title, NULL FROM y WHERE NOT uncited AND title <> ctitle""")
def k3_check_preservation(spark, sf):
    u = i.elements(spark, sf).where("kind in ('paragraph', 'list_item')").select((F.col("doc_id") * 1000 + F.col("seq")).alias("unit_id"), (F.col("seq") + 1).alias("n"))
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    k = F.col("unit_id")
    off = lambda m, by=1: k + F.when(k % m == 0, by).otherwise(0)
    say = lambda w, m, n, q: F.concat(pick(WHO, w), F.lit(" "), pick(DOES, m), F.lit(" do it within "), n.cast("string"), F.lit(" days, see “"), pick(TITLES, q), F.lit("” there.")).alias("text")
    claims = u.where("unit_id % 11 <> 0").select("unit_id", say(off(13), off(17, 2), F.when(k % 7 == 0, F.lit(400)).otherwise(F.col("n")), off(19)))
    return preservation.check_preservation(u.select("unit_id", say(k, k, F.col("n"), k)), claims, "unit_id")

"""Queries over assembly: orders as the places of their customer's document, some merged into the next or the one before, some removed; line items refer to them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import assembly
from . import inputs as i
from .registry import query

PLACES = """p0 AS (SELECT o_custkey AS doc, o_orderkey AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ord, o_orderkey % 10 AS k, 1 + (o_orderkey % 3)::INT AS level FROM orders),
places AS (SELECT a.doc, a.place, a.ord, a.level, a.ord::VARCHAR AS old_number, a.k = 3 AS removed, CASE WHEN a.k IN (1, 2, 7, 9) THEN coalesce(b.place, -1) END AS into_ FROM p0 a LEFT JOIN p0 b ON b.doc = a.doc AND b.ord = CASE WHEN a.k = 9 THEN a.ord - 1 ELSE a.ord + 1 END),
f AS (SELECT doc, place, place AS here, 0::BIGINT AS hops, [place] AS seen, false AS cyc FROM places UNION ALL
  SELECT f.doc, f.place, p.into_, hops + 1, list_append(seen, p.into_), list_contains(seen, p.into_) FROM f JOIN places p ON p.doc = f.doc AND p.place = f.here WHERE NOT cyc AND NOT p.removed AND p.into_ IS NOT NULL AND p.into_ <> -1),
l AS (SELECT f.doc, f.place, here, hops, CASE WHEN cyc THEN 'cycle' WHEN p.removed THEN 'removed' WHEN p.into_ = -1 THEN 'unknown' WHEN hops > 0 THEN 'merged' ELSE 'present' END AS outcome FROM f JOIN places p ON p.doc = f.doc AND p.place = f.here
  QUALIFY row_number() OVER (PARTITION BY f.doc, f.place ORDER BY hops DESC) = 1),
e AS (SELECT doc, place, CASE WHEN outcome IN ('merged', 'present') THEN here END AS final, CASE WHEN outcome <> 'cycle' THEN hops END AS hops, outcome FROM l)"""

NUMBERS = """h AS (SELECT places.* FROM places JOIN e USING (doc, place) WHERE outcome = 'present'),
x1 AS (SELECT *, 0 AS z1, sum((level < 2)::INT) OVER (PARTITION BY doc ORDER BY ord) AS z2, sum((level < 3)::INT) OVER (PARTITION BY doc ORDER BY ord) AS z3 FROM h),
c AS (SELECT *, greatest(1, sum((level = 1)::INT) OVER (PARTITION BY doc ORDER BY ord))::BIGINT AS c1, greatest(1, sum((level = 2)::INT) OVER (PARTITION BY doc, z2 ORDER BY ord))::BIGINT AS c2, greatest(1, sum((level = 3)::INT) OVER (PARTITION BY doc, z3 ORDER BY ord))::BIGINT AS c3 FROM x1),
nm AS (SELECT e.*, array_to_string([c1, c2, c3][1:level], '.') AS number FROM e LEFT JOIN c ON c.doc = e.doc AND c.place = e.final),
refs AS (SELECT o_custkey AS doc, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS ref, 1 + l_partkey % 14 AS target_ord FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT refs.doc, ref, p.place AS target, 'see no. 1' || target_ord || ', chapter ' || target_ord || ', or ' || target_ord || '.' || target_ord || ' and ' || target_ord || '.' AS phrase, target_ord FROM refs LEFT JOIN p0 p ON p.doc = refs.doc AND p.ord = target_ord)"""


def places(spark, sf):
    by = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = i.table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("place"), F.row_number().over(by).alias("ord"), (F.col("o_orderkey") % 10).alias("k"), (1 + F.col("o_orderkey") % 3).cast("int").alias("level"))
    other = F.when(F.col("k") == 9, F.col("ord") - 1).otherwise(F.col("ord") + 1)
    near = p.select("doc", F.col("ord").alias("_o"), F.col("place").alias("_p"))
    rows = p.withColumn("_o", other).join(near, ["doc", "_o"], "left")
    return rows.select("doc", "place", "ord", "level", F.col("ord").cast("string").alias("old_number"), (F.col("k") == 3).alias("removed"), F.when(F.col("k").isin(1, 2, 7, 9), F.coalesce("_p", F.lit(-1))).alias("into"))


@query(f"WITH RECURSIVE {PLACES} SELECT doc, place, final, hops, outcome FROM e")
def k14b_follow_places(spark, sf):
    return assembly.follow_places(places(spark, sf), ["doc"])


@query(f"""WITH RECURSIVE {PLACES}, {NUMBERS}, s AS (SELECT r.*, hops, number, CASE WHEN outcome IS NULL THEN 'no such place' ELSE outcome END AS note FROM r LEFT JOIN nm ON nm.doc = r.doc AND nm.place = r.target)
SELECT doc, ref, target, CASE note WHEN 'present' THEN 'resolved' WHEN 'merged' THEN 'merged' ELSE 'unresolved' END AS status, CASE WHEN note NOT IN ('present', 'merged') THEN note END AS note,
  CASE WHEN number IS NOT NULL THEN CASE WHEN target_ord = 1 THEN 'see no. 11, chapter ' || number || ', or 1.1 and 1.' ELSE 'see no. 1' || target_ord || ', chapter ' || number || ', or ' || target_ord || '.' || target_ord || ' and ' || target_ord || '.' END ELSE phrase END AS text,
  CASE WHEN number IS NOT NULL THEN length('see no. 1' || target_ord || ', chapter ') END AS number_at, hops, CASE note WHEN 'present' THEN NULL WHEN 'merged' THEN 'medium' ELSE 'high' END AS severity FROM s""")
def k14_assemble(spark, sf):
    p = places(spark, sf)
    ref = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    refs = i.table(spark, sf, "lineitem").join(i.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc")), "l_orderkey").select("doc", ref.alias("ref"), (1 + F.col("l_partkey") % 14).cast("int").alias("ord"))
    o = F.col("ord").cast("string")
    phrase = F.concat(F.lit("see no. 1"), o, F.lit(", chapter "), o, F.lit(", or "), o, F.lit("."), o, F.lit(" and "), o, F.lit("."))
    refs = refs.join(p.select("doc", "ord", F.col("place").alias("target")), ["doc", "ord"], "left").select("doc", "ref", "target", phrase.alias("phrase"))
    return assembly.assemble(p, refs)[1]


@query(f"""WITH RECURSIVE {PLACES}, {NUMBERS}, m AS (SELECT h.doc, h.place, h.ord AS pos, h.place * 7 % 101 * 1000000 + h.place AS new_pos, CASE h.place % 4 WHEN 0 THEN 'before' WHEN 1 THEN 'after' END AS direction FROM h),
w AS (SELECT *, CASE direction WHEN 'before' THEN lag(place) OVER o WHEN 'after' THEN lead(place) OVER o END AS neighbour, CASE direction WHEN 'before' THEN lag(new_pos) OVER o WHEN 'after' THEN lead(new_pos) OVER o END AS there FROM m WINDOW o AS (PARTITION BY doc ORDER BY pos))
SELECT doc, place, neighbour, direction FROM w WHERE (direction = 'before' AND there > new_pos) OR (direction = 'after' AND there < new_pos)""")
def k14c_relative_issues(spark, sf):
    p = places(spark, sf)
    stays = assembly.follow_places(p, ["doc"]).where("outcome = 'present'").select("doc", "place")
    moves = p.join(stays.withColumn("_in", F.lit(True)), ["doc", "place"], "left")
    direction = F.when(F.col("place") % 4 == 0, "before").when(F.col("place") % 4 == 1, "after")
    new = F.when(F.col("_in"), F.col("place") * 7 % 101 * 1000000 + F.col("place"))
    return assembly.relative_issues(moves.select("doc", "place", F.col("ord").alias("pos"), new.alias("new_pos"), direction.alias("direction")))

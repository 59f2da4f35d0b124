"""Queries over page layout: line items as boxes on pages of four orders each."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import layout
from . import inputs as i
from .registry import query

#: Boxes of 21 to 70 points by 13 to 31 on a page of 612 by 792; n numbers a page's boxes.
BOXES = """boxes AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, l_returnflag AS flag, x AS x0, y AS y0, x + 20 + l_quantity::INT AS x1, y + 10 + 3 * l_linenumber::INT AS y1
  FROM (SELECT *, l_orderkey // 4 AS page, (l_partkey % 12 * 50)::INT AS x, (l_suppkey * 7 % 40 * 19)::INT AS y FROM lineitem))"""


def boxes(spark, sf):
    order = W.partitionBy("page").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    x, y = (F.col("l_partkey") % 12 * 50).cast("int"), (F.col("l_suppkey") * 7 % 40 * 19).cast("int")
    rows = i.table(spark, sf, "lineitem").withColumn("page", F.floor(F.col("l_orderkey") / 4))
    rows = rows.select("page", F.row_number().over(order).alias("n"), F.col("l_returnflag").alias("flag"), x.alias("x0"), y.alias("y0"), (x + 20 + F.col("l_quantity").cast("int")).alias("x1"), (y + 10 + 3 * F.col("l_linenumber").cast("int")).alias("y1"))
    return rows.withColumns({"page_width": F.lit(612.0), "page_height": F.lit(792.0)})


def _gaps(source: str) -> str:
    def widest(a, b, least, name):
        return f"first_value(CASE WHEN g{name} > {least} THEN m{name} END) OVER (PARTITION BY page, path ORDER BY g{name} > {least} DESC NULLS LAST, g{name} DESC NULLS LAST, {a}, n) AS {name}"

    ahead = lambda a, b, name: f"lead({a}) OVER (PARTITION BY page, path ORDER BY {a}, n) - {b} AS g{name}, ({b} + lead({a}) OVER (PARTITION BY page, path ORDER BY {a}, n)) / 2 AS m{name}"
    return f"SELECT *, {widest('x0', 'x1', 18.36, 'x')}, {widest('y0', 'y1', 23.76, 'y')} FROM (SELECT *, {ahead('x0', 'x1', 'x')}, {ahead('y0', 'y1', 'y')} FROM {source})"


@query(f"""WITH RECURSIVE {BOXES}, r AS (SELECT page, n, x0, y0, x1, y1, '' AS path, true AS across FROM boxes UNION ALL
  SELECT page, n, x0, y0, x1, y1, path || CASE WHEN CASE WHEN by_x THEN (x0 + x1) / 2 < x ELSE (y0 + y1) / 2 < y END THEN '0' ELSE '1' END, NOT by_x
  FROM (SELECT *, CASE WHEN across THEN x IS NOT NULL ELSE y IS NULL END AS by_x FROM ({_gaps('r')}) WHERE x IS NOT NULL OR y IS NOT NULL)),
l AS (SELECT page, n, y0, x0, max(path) AS path FROM r GROUP BY ALL)
SELECT page, n, row_number() OVER (PARTITION BY page ORDER BY path, y0, x0, n) AS position FROM l""")
def e23_reading_order(spark, sf):
    return layout.reading_order(boxes(spark, sf), ["page"], "n").select("page", "n", "position")


@query(f"""WITH {BOXES}, c AS ({_gaps("(SELECT *, '' AS path FROM boxes)")}), s AS (SELECT *, (x0 + x1) / 2 AS mid, (x0 + x1) / 2 < x AS l FROM c),
b AS (SELECT *, min(x0) FILTER (l) OVER w AS l0, max(x1) FILTER (l) OVER w AS l1, min(x0) FILTER (NOT l) OVER w AS r0, max(x1) FILTER (NOT l) OVER w AS r1 FROM s WINDOW w AS (PARTITION BY page))
SELECT page, n, CASE WHEN x IS NULL OR mid BETWEEN l0 AND l1 THEN 0 WHEN mid BETWEEN r0 AND r1 THEN 1 END AS "column", CASE WHEN x IS NULL THEN 1 ELSE 2 END AS n_columns FROM b""")
def e24_page_columns(spark, sf):
    return layout.page_columns(boxes(spark, sf), ["page"], "n").select("page", "n", "column", "n_columns")


@query(f"""WITH RECURSIVE {BOXES}, ic AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n) AS k FROM boxes WHERE flag = 'R'),
o AS (SELECT i.page, i.k, t.n AS t, (least(i.y1, t.y1) - greatest(i.y0, t.y0)) / least(i.y1 - i.y0, t.y1 - t.y0) AS score, greatest(0, t.x0 - i.x1) AS far FROM ic i JOIN boxes t ON i.page = t.page AND t.flag <> 'R' AND t.x1 >= i.x0),
c AS (SELECT ic.page, ic.k, coalesce(list(t ORDER BY score DESC, far, t) FILTER (score >= 0.25), []) AS ts FROM ic LEFT JOIN o ON o.page = ic.page AND o.k = ic.k GROUP BY ALL),
v AS (SELECT DISTINCT page, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS pick FROM ic UNION ALL
  SELECT page, k + 1, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, pick FROM (SELECT v.page, v.k, taken, list_filter(c.ts, lambda x: NOT list_contains(taken, x))[1] AS pick FROM v JOIN c ON c.page = v.page AND c.k = v.k + 1))
SELECT ic.page, ic.n AS icon, v.pick AS text FROM ic JOIN v ON v.page = ic.page AND v.k = ic.k""")
def c13_bind_icons(spark, sf):
    b = boxes(spark, sf)
    return layout.bind_icons(b.where("flag = 'R'").withColumnRenamed("n", "icon"), b.where("flag <> 'R'").withColumnRenamed("n", "text"), ["page"], "icon", "text")


CELLS = "cells AS (SELECT l_orderkey // 8 AS grid, l_partkey % 70 AS row, l_suppkey * 5 % 24 AS col, max(CASE WHEN l_linenumber = 7 THEN ' ' ELSE l_returnflag || l_linenumber END) AS text FROM lineitem GROUP BY ALL)"


@query(f"""WITH RECURSIVE {CELLS}, c AS (SELECT grid, col, list(row) AS rows, row_number() OVER (PARTITION BY grid ORDER BY col) AS k FROM cells WHERE text <> ' ' GROUP BY grid, col),
v AS (SELECT grid, 1::BIGINT AS k, 0 AS grp, rows AS taken FROM c WHERE k = 1 UNION ALL
  SELECT v.grid, v.k + 1, CASE WHEN list_has_any(taken, rows) THEN grp + 1 ELSE grp END, CASE WHEN list_has_any(taken, rows) THEN rows ELSE list_concat(taken, rows) END FROM v JOIN c ON c.grid = v.grid AND c.k = v.k + 1)
SELECT cells.grid, cells.row, grp AS col, string_agg(text, ' ' ORDER BY cells.col) AS text FROM cells JOIN c ON c.grid = cells.grid AND c.col = cells.col JOIN v ON v.grid = c.grid AND v.k = c.k WHERE text <> ' ' GROUP BY ALL""")
def e12_collapse_sparse_grid(spark, sf):
    said = F.when(F.col("l_linenumber") == 7, F.lit(" ")).otherwise(F.concat("l_returnflag", F.col("l_linenumber").cast("string")))
    cells = i.table(spark, sf, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 8).alias("grid"), (F.col("l_partkey") % 70).alias("row"), (F.col("l_suppkey") * 5 % 24).alias("col")).agg(F.max(said).alias("text"))
    return layout.collapse_grid(cells, ["grid"])

"""Page layout from boxes: reading order by recursive cuts, columns, icons bound to texts, grids without empty columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .loops import release, stored, until_empty

#: Cuts below each other that a round of ``reading_order`` makes.
CUTS = 4


def _split(blocks: DataFrame, region: list[str], order: str, ratio: float, live: Column | None = None) -> DataFrame:
    """One cut of every region: adds _x and _y, the middles of the widest gaps above ``ratio`` of the page along either axis (of equal gaps the first), null without one.  A gap lies between a box and the
    next one by its start; boxes that aren't ``live`` have none."""
    out = blocks
    for name, start, end, size in (("_x", "x0", "x1", "page_width"), ("_y", "y0", "y1", "page_height")):
        along = W.partitionBy(*region).orderBy(start, order)
        after = F.lead(start).over(along)
        gap, wide = after - F.col(end), after - F.col(end) > F.col(size) * ratio
        option = F.struct(gap.alias("gap"), (-F.row_number().over(along)).alias("first"), ((F.col(end) + after) / 2).alias("at"))
        out = out.withColumn(name, F.when(wide if live is None else wide & live, option))
    whole = W.partitionBy(*region)
    return out.withColumns({name: F.max(name).over(whole)["at"] for name in ("_x", "_y")})


def reading_order(blocks: DataFrame, page: Sequence[str], order: str, ratio: float = 0.03) -> DataFrame:
    """Adds ``position`` (from 1, per page) in reading order, by recursive XY-cuts.

    blocks: the columns of ``page``, ``order`` (a unique number on the page), x0, y0, x1, y1, page_width, page_height.  A region is cut at the middle of its
    widest gap above ``ratio`` of the page, first across (columns), then down, in turn; where the axis that is due has no gap, the other one is tried; a region
    without gap, or of one box, is a leaf, read by (y0, x0).  Gaps are those between boxes that follow each other by their start, so a box inside another may open a gap.  A box goes to the
    side of its middle.  Pages without boxes have no rows; null coordinates make a box's gaps null, and it stays on the far side.

    Each round shuffles the boxes of all open regions of all pages once and makes ``CUTS`` cuts below each other where they lie; it is written once.  Regions that can't be cut leave the
    loop, so rounds are as many as the deepest page has cuts below each other, by ``CUTS``, and late rounds touch few pages.
    """
    page = list(page)
    parts, left = [], blocks.withColumns({"_path": F.lit(""), "_across": F.lit(True)})
    columns = left.columns
    while not parts or not left.isEmpty():
        root = [*page, "_root"] if parts else page
        rows = left.withColumn("_root", F.col("_path")).repartition(*root).withColumn("_open", F.lit(True))
        for _ in range(CUTS):
            # A leaf stays one in the cuts that follow; a page's leaves go through them together.
            cut = _split(rows.withColumn("_region", F.when(F.col("_open"), F.col("_path"))), [*root, "_region"], order, ratio, F.col("_open"))
            by_x = F.when(F.col("_across"), F.col("_x").isNotNull()).otherwise(F.col("_y").isNull() & F.col("_x").isNotNull())
            side = F.when(by_x, (F.col("x0") + F.col("x1")) / 2 < F.col("_x")).otherwise((F.col("y0") + F.col("y1")) / 2 < F.col("_y"))
            cut = cut.withColumns({"_open": F.col("_x").isNotNull() | F.col("_y").isNotNull(), "_by_x": by_x, "_first": F.coalesce(side, F.lit(False))})
            path = F.when(F.col("_open"), F.concat("_path", F.when(F.col("_first"), "0").otherwise("1"))).otherwise(F.col("_path"))
            rows = cut.withColumns({"_path": path, "_across": F.when(F.col("_open"), ~F.col("_by_x")).otherwise(F.col("_across"))}).select(*columns, "_root", "_open")
        rows = stored(rows.drop("_root"), "reading-order")
        parts.append(rows.where("not _open").select(*columns))
        left = rows.where("_open").select(*columns)
    along = W.partitionBy(*page).orderBy("_path", "y0", "x0", order)
    return reduce(DataFrame.unionByName, parts).withColumn("position", F.row_number().over(along)).drop("_path", "_across")


def page_columns(blocks: DataFrame, page: Sequence[str], order: str, ratio: float = 0.03) -> DataFrame:
    """A row per box of its page's columns: ``column`` (from 0; null for a box whose middle is in none) and ``n_columns``.

    Only a first cut across the whole page makes columns: two, each as wide as its boxes; a box belongs to the first whose range holds its middle.  Other pages have one column.
    """
    page = list(page)
    cut = _split(blocks, page, order, ratio)
    whole, middle = W.partitionBy(*page), (F.col("x0") + F.col("x1")) / 2
    left = middle < F.col("_x")
    bound = lambda side, f, c: f(F.when(side, F.col(c))).over(whole)
    inside = lambda side: middle.between(bound(side, F.min, "x0"), bound(side, F.max, "x1"))
    column = F.when(F.col("_x").isNull() | inside(left), 0).when(inside(~left), 1)
    n = F.when(F.col("_x").isNull(), 1).otherwise(2)
    return cut.select(*blocks.columns, column.alias("column"), n.alias("n_columns"))


def bind_icons(icons: DataFrame, texts: DataFrame, page: Sequence[str], icon: str, text: str, largest: float = 90.0, overlap: float = 0.25) -> DataFrame:
    """Each small icon with the text it belongs to, a text for one icon at most: page, icon, text (null for icons that stay alone).

    icons and texts: page, key (``icon``, ``text``: numbers in page order), x0, y0, x1, y1.  Icons of ``largest`` points or less in both directions count.  A text is open to an icon if they share
    ``overlap`` of the lower one's height and the text doesn't end left of the icon; the better text shares more, then is nearer to the right, then comes first.  Icons choose in page order, so the
    first icon that wants a text has it.  Boxes without height, and null coordinates, match nothing.

    Boxes meet by bands of ``largest`` points of the page's height that both cover, each pair in its first common band.  Choices are settled by rounds of mutual bests, all pages at once: a
    text's best is its first open icon, an icon's its best open text; pairs that agree leave with all their other options, and rounds go on until none is left.
    """
    page = list(page)
    band = lambda df, prefix: df.withColumn(f"_{prefix}0", F.floor(F.col("y0") / largest)).withColumn("_band", F.explode(F.sequence(F.col(f"_{prefix}0"), F.floor(F.col("y1") / largest))))
    box = lambda df, key, p: df.where("y1 > y0").select(*page, F.col(key).alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("x0", "y0", "x1", "y1")], f"_{p}0", "_band")
    small = icons.where((F.col("x1") - F.col("x0") <= largest) & (F.col("y1") - F.col("y0") <= largest))
    met = box(band(small.where("y1 > y0"), "i"), icon, "i").join(box(band(texts.where("y1 > y0"), "t"), text, "t"), [*page, "_band"]).where(F.col("_band") == F.greatest("_i0", "_t0"))
    shared = (F.least("i_y1", "t_y1") - F.greatest("i_y0", "t_y0")) / F.least(F.col("i_y1") - F.col("i_y0"), F.col("t_y1") - F.col("t_y0"))
    met = met.withColumn("score", shared).where((F.col("score") >= overlap) & (F.col("t_x1") >= F.col("i_x0")))
    options = stored(met.select(*page, "i", "t", "score", F.greatest(F.lit(0.0), F.col("t_x0") - F.col("i_x1")).alias("far")), "icon-options")

    def step(left: DataFrame) -> tuple[DataFrame, DataFrame]:
        best = left.withColumn("_t", F.row_number().over(W.partitionBy(*page, "i").orderBy(F.desc("score"), "far", "t"))).withColumn("_i", F.min("i").over(W.partitionBy(*page, "t")))
        pairs = stored(best.where("_t = 1 and _i = i").select(*page, "i", "t"), "icon-pairs")
        rest = left.join(pairs.select(*page, "i"), [*page, "i"], "left_anti").join(pairs.select(*page, "t"), [*page, "t"], "left_anti")
        return pairs, rest.select(*left.columns)

    bound = until_empty(options, step, "icons")
    release(options)
    return small.select(*page, icon).join(bound.withColumnsRenamed({"i": icon, "t": text}), [*page, icon], "left").select(*page, icon, text)


def collapse_grid(cells: DataFrame, table: Sequence[str], most_columns: int = 4096) -> DataFrame:
    """Cells (table, row, col from 0, text) of grids without empty columns, and with neighbouring columns merged that never have text in the same row.

    Occupied rows of a column are a bitmap in words of 64 rows, or-ed per column; a fold over a table's occupied columns, left to right, keeps the union of the group at hand and closes it at the first
    column that shares a row with it.  Merged cells take the texts of their row in column order, joined by a blank (there is one, as none collide).  Blank and null texts are empty; the result's columns
    are numbered from 0 again.  A table's columns (not its rows) are folded in one task; ``most_columns`` is how many a table may have (an error beyond).
    """
    table = list(table)
    full = cells.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    if full.groupBy(*table).agg(F.max("col").alias("c")).where(F.col("c") >= most_columns).head(1):
        raise ValueError(f"a table of more than {most_columns} columns")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("row") % 64).cast("int"))
    words = full.groupBy(*table, "col", F.floor(F.col("row") / 64).cast("int").alias("w")).agg(F.bit_or(bit).alias("b"))
    columns = words.groupBy(*table).agg(F.array_sort(F.collect_list(F.struct("col", "w", "b"))).alias("x"))
    # One word of a column at a time: whether a column collides is known after its last word, so columns are first folded into maps.
    maps = columns.select(*table, F.transform(F.array_distinct(F.transform("x", lambda s: s["col"])), lambda c: F.struct(c.alias("col"), F.map_from_entries(F.transform(F.filter("x", lambda s: s["col"] == c), lambda s: F.struct(s["w"], s["b"]))).alias("m"))).alias("c"))
    start = F.struct(F.array().cast("array<struct<col:int,grp:int>>").alias("done"), F.lit(-1).alias("grp"), F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<bigint>")).alias("union"))

    def fold(acc: Column, c: Column) -> Column:
        hit = F.exists(F.map_keys(c["m"]), lambda w: F.coalesce(acc["union"][w], F.lit(0).cast("long")).bitwiseAND(c["m"][w]) != 0) | (acc["grp"] < 0)
        joined = F.map_zip_with(acc["union"], c["m"], lambda _, a, b: F.coalesce(a, F.lit(0).cast("long")).bitwiseOR(F.coalesce(b, F.lit(0).cast("long"))))
        grp = acc["grp"] + F.when(hit, 1).otherwise(0)
        return F.struct(F.concat(acc["done"], F.array(F.struct(c["col"].cast("int").alias("col"), grp.alias("grp")))).alias("done"), grp.alias("grp"), F.when(hit, c["m"]).otherwise(joined).alias("union"))

    groups = maps.select(*table, F.explode(F.aggregate("c", start, fold, lambda acc: acc["done"])).alias("g")).select(*table, "g.col", "g.grp")
    met = full.join(groups, [*table, "col"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda s: F.trim(s["text"]))
    return met.groupBy(*table, "row", "grp").agg(F.array_join(texts, " ").alias("text")).withColumnRenamed("grp", "col")

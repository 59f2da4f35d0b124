"""Typed blocks of raw pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block's opening tag, one inline tag at most, and the text up to the next tag.
BLOCK = r"<(h1|title|li|p)(?:\s[^<>]*)?>((?:<(?:b|i|em|a|strong)(?:\s[^<>]*)?>)?)([^<]*)"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    for entity, plain in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row per block in page order: doc_id, seq (from 1), kind (title, heading, list_item, paragraph), text without extra blanks."""
    cut = [F.regexp_extract_all(html_col, F.lit(BLOCK), F.lit(k)) for k in (1, 3)]
    rows = pages.select(F.col(id_col).alias("doc_id"), F.posexplode(F.arrays_zip(cut[0].alias("tag"), cut[1].alias("raw"))).alias("pos", "b"))
    kind = F.when(F.col("b.tag") == "h1", "heading").when(F.col("b.tag") == "title", "title").when(F.col("b.tag") == "li", "list_item").otherwise("paragraph")
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("seq"), kind.alias("kind"), F.trim(F.regexp_replace(unescape(F.col("b.raw")), r"\s+", " ")).alias("text"))

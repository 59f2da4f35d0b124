"""Folding of Unicode text, the one step that Spark has no function for: Arrow batches through Python's tables."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(text: str, case: bool = True, accents: bool = True) -> str:
    """Compatibility forms (NFKC); without case and without accents, if so wished."""
    text = unicodedata.normalize("NFKC", text)
    if case:
        text = text.casefold()
    if accents and not text.isascii():
        text = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)))
    return text


def unicode_fold(c: Column, case: bool = True, accents: bool = True) -> Column:
    """``folded`` of a column; null stays null."""

    @F.pandas_udf("string")
    def fold(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: folded(x, case, accents), na_action="ignore")

    return fold(c)

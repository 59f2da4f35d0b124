"""Ordered folds inside one row: a state goes along an array, and each item gives something out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], out: str, block: int = 64) -> Column:
    """What ``emit(state, item)`` gives for each item, an array of type ``out``; ``step(state, item)`` is the state with which it is asked, from ``start``.

    Items go in blocks: within one, results are appended to a short array, and whole blocks to a list of blocks, so that the work grows with the number of items and not with its square.
    """
    none = F.array().cast(f"array<{out}>")
    count = F.floor((F.size(items) + block - 1) / block).cast("int")
    blocks = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.slice(items, k * block + 1, block))

    def one(acc: Column, x: Column) -> Column:
        return F.element_at(F.transform(F.array(step(acc["state"], x)), lambda s: F.struct(s.alias("state"), F.array_append(acc["out"], emit(s, x)).alias("out"))), 1)

    def whole(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return F.element_at(F.transform(F.array(inner), lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out"))), 1)

    folded = F.aggregate(blocks, F.struct(start.alias("state"), F.array().cast(f"array<array<{out}>>").alias("out")), whole, lambda acc: acc["out"])
    return F.flatten(folded)

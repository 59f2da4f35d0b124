"""Every query with SQL against DuckDB at the smallest size; the others against plain Python."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from docspark import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "replace") and hasattr(v, "tzinfo") else v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, sf, db, name):
    got = plans.QUERIES[name](spark, sf)
    want = db.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_pack_blocks(spark, sf):
    cost = {}
    for r in plans.inputs.units(spark, sf).selectExpr("doc_id", "seq", "floor(char_length(text) / 4) + 1 AS c").collect():
        cost.setdefault(r.doc_id, []).append((r.seq, r.c))
    want = set()
    for doc, items in cost.items():
        block, used = 1, 0
        for seq, c in sorted(items):
            if used and used + c > 300:
                block, used = block + 1, 0
            used += c
            want.add((doc, seq, block))
    assert {tuple(r) for r in plans.QUERIES["d22_pack_blocks"](spark, sf).collect()} == want


def test_non_overlapping(spark, sf):
    spans = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        spans.setdefault(r.l_orderkey, set()).add((r.l_partkey % 50, -(r.l_partkey % 50 + int(r.l_quantity))))
    want = set()
    for k, items in spans.items():
        last = -1
        for start, minus in sorted(items):
            if start >= last:
                last = -minus
                want.add((k, start, last))
    assert {tuple(r) for r in plans.QUERIES["e22_non_overlapping"](spark, sf).collect()} == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

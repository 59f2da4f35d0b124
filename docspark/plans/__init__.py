"""Registered queries: each operator over the given tables, with its SQL."""

from . import assembly, composites, history, inputs, layout, more, planning, preservation, quality, reconcile, streams, structure, text, translation, validation
from .registry import QUERIES, SQL

__all__ = ["assembly", "composites", "history", "inputs", "layout", "more", "oracle_sql", "planning", "preservation", "quality", "queries", "reconcile", "streams", "structure", "text", "translation", "validation"]


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)

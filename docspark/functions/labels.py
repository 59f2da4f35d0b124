"""Labels, numbers, markers and references in short texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t

MARKER = r"⟦/?[0-9]+⟧"


def heading_number(c: Column) -> Column:
    return F.regexp_extract(c, r"^[0-9]+(?:\.[0-9]+)*", 0)


def caption_label(c: Column) -> Column:
    return F.regexp_extract(c, r"(?i)^(?:figure|table) [0-9]+", 0)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")


def strip_markers(c: Column) -> Column:
    return F.regexp_replace(c, MARKER, "")


def object_markers(c: Column) -> Column:
    """Numbers of markers that are opened and never closed: these stand for an object."""
    return F.array_except(t.extract(c, "⟦([0-9]+)⟧", 1), t.extract(c, "⟦/([0-9]+)⟧", 1))


def cue_hits(words: Column, cues: Sequence[str]) -> Column:
    """How many of the cue words occur."""
    return F.size(F.array_intersect(words, F.array(*map(F.lit, cues))))


def show_ref(phrase: Column, number: Column) -> Column:
    """A reference phrase with its number replaced."""
    return F.concat(F.regexp_replace(phrase, r"[0-9]+(?:\.[0-9]+)*$", ""), number)


def tokenize(c: Column, refs: Sequence[tuple[Column, Column]]) -> Column:
    """Replaces each phrase by its token, in the given order."""
    for phrase, token in refs:
        c = F.replace(c, phrase, token)
    return c

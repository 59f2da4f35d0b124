"""Benchmark decontamination: windows of test items, found in training documents, verified, and cut out or rejected."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices, stored
from .tokens import ALNUM, Words, windows

_HITS = "doc_id long, n_words long, hits binary, items array<string>, row binary"


def _row_key(id_: Column, text: Column) -> Column:
    """What tells rows apart: a hash of id (null is one of its own) and text.  Rows that agree in both have the same hits."""
    name = id_.cast("string")
    return F.unhex(F.sha2(F.concat(F.coalesce(F.concat(F.char_length(name), F.lit(":"), name), F.lit("-")), text), 256))


def item_windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, n, h, words): every window of ``size`` words of each item, or all words of a shorter one; distinct."""

    def run(batches):
        for b in slices(batches, 1):
            found = Words(b.column(1), ALNUM)
            hashed, ids = found.hashes(), b.column(0).to_pylist()
            raw = found.bytes.tobytes()
            out = []
            for n in range(1, size + 1):
                h, at = windows(hashed, found.row, n)
                keep = np.ones(len(at), bool) if n == size else found.per_row[found.row[at]] == n
                for x, i in zip(h[keep].view(np.int64).tolist(), at[keep].tolist(), strict=True):
                    text = b" ".join(raw[found.start[j] : found.end[j]] for j in range(i, i + n)).decode()
                    out.append((ids[found.row[i]], n, x, text))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["item", "n", "h", "words"])

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    return rows.mapInArrow(run, "item string, n int, h long, words string").distinct()


class _Index:
    """Sorted window hashes for numpy look-ups; the words and items of each for verification."""

    def __init__(self, rows):
        by = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
        for item, n, h, words in rows:
            by[n][h][words.encode()].append(item)
        self.by = {n: dict(x) for n, x in by.items()}
        self.sorted = {n: np.sort(np.fromiter(x, np.int64, len(x)).view(np.uint64)) for n, x in self.by.items()}


def _hits(index: _Index, arr: pa.Array):
    """Per row of a string column: the words, which of them are hit (bool array), the items found."""
    found = Words(arr, ALNUM)
    hashed, raw = found.hashes(), None
    mark = np.zeros(len(hashed) + 1, np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    for n, known in index.sorted.items():
        h, at = windows(hashed, found.row, n)
        if not len(h):
            continue
        near = np.minimum(np.searchsorted(known, h), len(known) - 1)
        for x, i in zip(h[sel := known[near] == h].view(np.int64).tolist(), at[sel].tolist(), strict=True):
            raw = raw if raw is not None else found.bytes.tobytes()
            words = b" ".join(raw[found.start[j] : found.end[j]] for j in range(i, i + n))
            if owners := index.by[n][x].get(words):
                mark[i] += 1
                mark[i + n] -= 1
                items[int(found.row[i])].update(owners)
    return found, np.cumsum(mark[:-1]) > 0, items


def _emit(ids, keys, found, hit, items):
    packed = [np.packbits(hit[a:b], bitorder="little").tobytes() if r in items else None for r, (a, b) in enumerate(zip(found.first_of_row, found.first_of_row[1:], strict=False))]
    names = [sorted(items[r]) if r in items else [] for r in range(len(packed))]
    return pa.RecordBatch.from_arrays([ids, pa.array(found.per_row, pa.int64()), pa.array(packed, pa.binary()), pa.array(names, pa.list_(pa.string())), keys], ["doc_id", "n_words", "hits", "items", "row"])


def benchmark_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, broadcast_windows: int = 200_000) -> DataFrame:
    """A row per document: doc_id, n_words, hits (bit i, little-endian, set if word i lies in a benchmark window; null if none),
    items (sorted ids, as strings, of the items with windows in it).

    Words are runs of ASCII letters and digits and anything beyond ASCII, A-Z lower-cased.  Windows are matched by a 64-bit
    hash and then verified word for word.  If the benchmark has ``broadcast_windows`` windows at most (about 500 bytes each in Python) they go to all tasks
    and the documents are scanned in place, without a shuffle; a larger one is cut by item into parts of that size, which
    are scanned one after the other and merged per document.
    A text that is null or has no words gives n_words 0 and no hits; a benchmark without items gives no hits; rows that repeat a doc_id are
    scanned each on its own, those without one too; items that repeat an id are parts of one item.
    """
    return _row_hits(docs, items, id_col, text_col, item_id, item_text, size, broadcast_windows, False).drop("row")


def _row_hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, size: int, broadcast_windows: int, keyed: bool) -> DataFrame:
    """``benchmark_hits`` with ``row``, the key of each row (null unless ``keyed`` or needed to merge parts)."""
    spark = docs.sparkSession
    index = stored(item_windows(items, size, item_id, item_text), "windows")
    parts = max(1, -(-index.count() // broadcast_windows))
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = _row_key(F.col(id_col), text) if keyed or parts > 1 else F.lit(None).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), key.alias("row"))

    def scan(part: int) -> DataFrame:
        mine = index if parts == 1 else index.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast(_Index(mine.select("item", "n", "h", "words").toLocalIterator()))

        def run(batches):
            for b in slices(batches, 1):
                yield _emit(b.column(0), b.column(2), *_hits(shared.value, b.column(1)))

        return rows.mapInArrow(run, _hits_schema(rows))

    if parts == 1:
        return scan(0)
    # Each part's findings are kept as a table before the next part is sent out; rows are told apart by their keys.
    found = [stored(scan(p).where("hits is not null"), "hits") for p in range(parts)]
    merged = found[0]
    for x in found[1:]:
        merged = merged.unionByName(x)

    def merge(pdf):
        bits = np.zeros(int(pdf.n_words.iloc[0]), bool)
        for x in pdf.hits:
            bits |= np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")[: len(bits)].astype(bool)
        out = pdf.iloc[:1].copy()
        out["hits"] = [np.packbits(bits, bitorder="little").tobytes()]
        out["items"] = [sorted({i for x in pdf["items"] for i in x})]
        return out

    merged = merged.groupBy("row").applyInPandas(merge, _hits_schema(rows)).select("row", "hits", "items")
    empty = spark.sparkContext.broadcast(_Index([]))

    def count(batches):
        for b in slices(batches, 1):
            yield _emit(b.column(0), b.column(2), *_hits(empty.value, b.column(1)))

    counted = rows.mapInArrow(count, _hits_schema(rows)).select("doc_id", "n_words", "row")
    return counted.join(merged, "row", "left").select("doc_id", "n_words", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "row")


def _hits_schema(rows: DataFrame) -> str:
    return _HITS.replace("doc_id long", f"doc_id {rows.schema['doc_id'].dataType.simpleString()}")


def hit_spans(hits: bytes, n_words: int) -> list[tuple[int, int]]:
    """Runs of hit words as (first, end)."""
    bits = np.unpackbits(np.frombuffer(hits, np.uint8), bitorder="little")[:n_words].astype(np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], bits, [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def contamination(hits: DataFrame) -> DataFrame:
    """Counts per document of a ``benchmark_hits`` table: n_hit, n_items, items_sha256, contaminated."""

    def run(batches):
        for b in batches:
            hit = [0 if x is None else int(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")[:n].sum()) for x, n in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.int64()), b.column(3)], ["doc_id", "n_words", "n_hit", "items"])

    kind = hits.schema["doc_id"].dataType.simpleString()
    out = hits.select("doc_id", "n_words", "hits", "items").mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<string>")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, most_share: float = 0.5, broadcast_windows: int = 200_000) -> DataFrame:
    """Documents without benchmark passages, their columns as they were.

    Hit spans (from their first word to the start of the next word after them) are cut out of the text; a document of whose words more than
    ``most_share`` are hit goes.  Clean documents, null texts included, stay as they are.  Each row is cut by its own hits, which are joined by a hash
    of id and text: rows without an id or with a repeated one are cut like any other.
    """
    key, mark = fresh(docs, "hit_row"), fresh(docs, "hit_bits")
    found = _row_hits(docs, items, id_col, text_col, item_id, item_text, size, broadcast_windows, True).where("hits is not null")
    marks = stored(found.groupBy(F.col("row").alias(key)).agg(F.first("hits").alias(mark)), "hits")
    joined = docs.withColumn(key, _row_key(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))).join(marks.hint("merge"), key, "left").select(*docs.columns, mark)
    at, width = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for b in batches:
            texts, stay = b.column(at).to_pylist(), []
            for r, bits in enumerate(b.column(width).to_pylist()):
                ok = True
                if bits is not None:
                    w = Words(pa.array([texts[r]]), ALNUM)
                    spans = hit_spans(bits, len(w.start))
                    ok = sum(z - a for a, z in spans) <= most_share * len(w.start)
                    raw, out, last = texts[r].encode(), [], 0
                    for a, z in spans:
                        out.append(raw[last : w.start[a]])
                        last = w.start[z] if z < len(w.start) else w.end[z - 1]
                    texts[r] = b"".join([*out, raw[last:]]).decode()
                stay.append(ok)
            cols = list(b.columns[:width])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:width]).filter(pa.array(stay))

    return joined.mapInArrow(run, docs.schema)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()

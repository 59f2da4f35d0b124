"""Line deduplication over a range-partitioned, sorted stream of line hashes."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import fresh, n_partitions, stored

_BLANK = b" \t\n\x0b\x0c\r"
_EVENT = "kind string, h1 long, h2 long, doc_id long, pos int, n_docs long, last_doc long"
_EVENT_ARROW = pa.schema([("kind", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("n_docs", pa.int64()), ("last_doc", pa.int64())])


def line_key(line: bytes) -> bytes:
    """A line's key: blanks stripped at both ends, A-Z lower-cased (bytes.lower() leaves everything else)."""
    return line.strip(_BLANK).lower()


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row (h1, h2, doc_id, pos) for each line whose key has ``min_chars`` code points or more; 128-bit hashes."""

    def run(batches):
        for b in batches:
            h1, h2, ids, at = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for pos, line in enumerate(text.encode().split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and len(key.decode()) >= min_chars:
                        h = hashlib.blake2b(key, digest_size=16).digest()
                        h1.append(int.from_bytes(h[:8], "little", signed=True))
                        h2.append(int.from_bytes(h[8:], "little", signed=True))
                        ids.append(doc)
                        at.append(pos)
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ids, pa.int64()), pa.array(at, pa.int32())], ["h1", "h2", "doc_id", "pos"])

    return docs.where("doc_id is not null and text is not null").mapInArrow(run, "h1 long, h2 long, doc_id long, pos int")


def _stream(min_docs: int):
    """Reads a sorted partition (hash, doc_id descending, pos); the first document of a run is the one that keeps its lines.

    Emits 'drop' for a line that is surely dropped.  A run at either end of the partition may go on in a neighbour: for it a
    'piece' (its documents here) and 'open' lines are emitted, decided once all pieces of the hash are known.  What is held
    back in memory is at most the lines of min_docs - 1 documents under one key.
    """

    def run(batches):
        cur = first = last = None
        n, opening, held = 0, True, []
        out = []

        def close(at_end: bool):
            if cur is not None and (opening or at_end):
                out.append(("piece", *cur, first, None, n, last))
                out.extend(("open", *cur, d, p, None, None) for d, p in held)

        def flush():
            cols = list(zip(*out, strict=True)) or [()] * 7
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _EVENT_ARROW, strict=True)], schema=_EVENT_ARROW)
            out.clear()
            return b

        for b in batches:
            for a, c, doc, pos in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (a, c) != cur:
                    close(False)
                    opening = cur is None
                    cur, first, last, n, held = (a, c), doc, doc, 1, []
                elif doc != last:
                    n, last = n + 1, doc
                if opening:
                    out.append(("open", a, c, doc, pos, None, None))
                elif doc != first:
                    if n < min_docs:
                        held.append((doc, pos))
                    else:
                        out.extend(("drop", a, c, d, p, None, None) for d, p in held)
                        held = []
                        out.append(("drop", a, c, doc, pos, None, None))
            yield flush()
        close(True)
        yield flush()

    return run


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, pos) of every line to drop: its key is in ``min_docs`` documents or more and doc_id isn't the largest of them."""
    lines = stored(line_hashes(docs, min_chars), "lines")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("pos")]
    dealt = lines.repartitionByRange(n_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    events = stored(dealt.mapInArrow(_stream(min_docs), _EVENT), "line-events")
    # Two pieces a partition at most, so this table is bounded by the number of partitions and can go to all tasks.
    along = W.Window.partitionBy("h1", "h2").orderBy(F.desc("doc_id"), F.desc("last_doc"))
    pieces = events.where("kind = 'piece'").withColumn("again", (F.lag("last_doc").over(along) == F.col("doc_id")).cast("long"))
    runs = pieces.groupBy("h1", "h2").agg((F.sum("n_docs") - F.sum(F.coalesce("again", F.lit(0)))).alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs)
    late = events.where("kind = 'open'").join(F.broadcast(runs), ["h1", "h2"]).where("doc_id <> keeper")
    return events.where("kind = 'drop'").select("doc_id", "pos").unionByName(late.select("doc_id", "pos"))


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Line dedup decisions as (doc_id, keep): a zlib-compressed bitmap, bit i (little-endian) set if line i stays.

    Lines (split at \\n) are the same if equal without blanks at both ends and with A-Z lower-cased; only keys of ``min_chars``
    code points found in ``min_docs`` documents lose lines, in all but the largest id.  Documents that lose none have no row;
    lines past the end of a bitmap stay.  128-bit hashes are range-partitioned by (hash, id, position), so one line that is in a
    third of all documents spreads over many partitions; no text is shuffled.
    A null text has no lines to drop; rows without an id neither lose lines nor count; rows that repeat an id count as one
    document and share its bitmap (the union of what they lose).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    per_doc = dropped_lines(rows, min_chars, min_docs).groupBy("doc_id").agg(F.collect_set("pos").alias("lost"))

    def pack(batches):
        for b in batches:
            maps = []
            for lost in b.column(1).to_pylist():
                bits = np.ones(-(-(max(lost) + 1) // 8) * 8, np.uint8)  # whole bytes, so that padding keeps
                bits[lost] = 0
                maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(maps, pa.binary())], ["doc_id", "keep"])

    return per_doc.mapInArrow(pack, "doc_id long, keep binary")


def kept_lines(text: str, keep: bytes | None) -> list[str]:
    lines = text.split("\n")
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    return [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """Documents with only the lines that stay, all columns else as they are; with ``counts`` also n_lines and n_dropped.

    A null text stays null (it counts as one empty line).  A document that loses all its lines has an empty text.
    """
    key, bitmap = fresh(docs, "line_id"), fresh(docs, "line_keep")
    marks = bitmaps.select(F.col("doc_id").alias(key), F.col("keep").alias(bitmap))
    # A merge join at every size: bitmaps grow with the input, so they aren't broadcast even where they would still fit.
    joined = docs.join(marks.hint("merge"), docs[id_col] == marks[key], "left").drop(key)
    at, keep_at = docs.columns.index(text_col), len(docs.columns)
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema] + ["n_lines long", "n_dropped long"] * counts

    def run(batches):
        for b in batches:
            texts, lines, lost = [], [], []
            for text, keep in zip(b.column(at).to_pylist(), b.column(keep_at).to_pylist(), strict=True):
                n = 1 if text is None else text.count("\n") + 1
                stay = [""] if text is None else kept_lines(text, keep)
                texts.append(None if text is None else "\n".join(stay))
                lines.append(n)
                lost.append(n - len(stay))
            cols = list(b.columns[:keep_at])
            cols[at] = pa.array(texts, pa.string())
            names = list(b.schema.names[:keep_at])
            if counts:
                cols, names = [*cols, pa.array(lines, pa.int64()), pa.array(lost, pa.int64())], [*names, "n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(run, ", ".join(fields))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Documents without repeated lines."""
    return apply_bitmaps(docs, line_keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)

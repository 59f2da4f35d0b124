"""Phrase collocations: Misra-Gries summaries per hash partition find what may be frequent, a second pass counts it exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import bloom_size, lean, n_partitions, release, slices, stored, text_offsets
from .tokens import _PLACE, Words, mix

#: Which bytes belong to words: all but blank, tab and what ends a piece.
_IN_WORD = np.ones(256, bool)
_IN_WORD[[ord(c) for c in " \t.,;:!?\n\x0b\x0c\r"]] = False
_ENDS_PIECE = ~_IN_WORD
_ENDS_PIECE[[32, 9]] = False


class _Grams:
    """The 1- to ``most``-grams of a column of texts, within pieces: hash, first word and size of each."""

    def __init__(self, texts: pa.Array, most: int):
        self.words = w = Words(texts, _IN_WORD)
        raw, _ = text_offsets(texts)
        ends = np.concatenate([[0], np.cumsum(_ENDS_PIECE[raw])])
        # Two words are neighbours if they are of one row and no mark that ends a piece lies between them.
        joined = (w.row[1:] == w.row[:-1]) & (ends[w.start[1:]] == ends[w.end[:-1]])
        at, h = np.arange(len(w.start)), w.hashes()
        parts, run, live = [(mix(h, 1), at, np.ones(len(at), np.int64))], h * _PLACE[0], at
        for k in range(1, most):
            live = live[live + k < len(h)]
            live = live[joined[live + k - 1]] if len(live) else live
            with np.errstate(over="ignore"):
                run = run.copy()
                run[live] += h[live + k] * _PLACE[k]
            parts.append((mix(run[live], k + 1), live, np.full(len(live), k + 1)))
        self.hash, self.first, self.size = (np.concatenate(x) for x in zip(*parts, strict=True))

    def text(self, which: np.ndarray) -> pa.Array:
        """The grams at ``which`` as strings, words joined by one blank."""
        w = self.words
        size = w.end - w.start
        to = np.cumsum(size + 1)
        flat = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(to - size - 1, size) + place] = w.bytes[np.repeat(w.start, size) + place]
        first, last = self.first[which], self.first[which] + self.size[which] - 1
        begin, length = to[first] - size[first] - 1, to[last] - 1 - (to[first] - size[first] - 1)
        off = np.concatenate([[0], np.cumsum(length)])
        data = flat[np.repeat(begin - off[:-1], length) + np.arange(off[-1])]
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their summed weights."""
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(n, first) if len(first) else n


class MisraGries:
    """A mergeable summary of weighted keys: at most ``capacity`` counters, each below its key's weight by ``error`` at most, error <= mass / (capacity + 1).

    A key whose weight is above that always has a counter left.  ``add`` merges another summary (or any keys with weights): counters of equal keys
    are summed; if more than ``capacity`` are left, the (capacity+1)-th largest is taken from all and what isn't positive goes.
    """

    def __init__(self, capacity: int):
        self.capacity, self.error, self.keys, self.counts = capacity, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = _summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if len(self.keys) > self.capacity:
            at = len(self.counts) - self.capacity - 1
            cut = int(np.partition(self.counts, at)[at])
            left = self.counts > cut
            self.error += cut
            self.keys, self.counts = self.keys[left], self.counts[left] - cut

    def at_least(self, weight: int) -> np.ndarray:
        """All keys that may have this weight (which must be above the error bound)."""
        return self.keys[self.counts + self.error >= weight]


#: Bits of a gram's hash in the first pass; grams that share one only cost work.
_KEY_BITS = 48


def _packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys as differences, and weights, in planes of bytes, compressed: about four bytes a gram."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = np.concatenate([steps.view(np.uint8).reshape(-1, 8).T, n.astype("<u8").view(np.uint8).reshape(-1, 8).T])
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=16 * size, codec="zstd", asbytes=True), np.uint8).reshape(16, size)
    steps, n = (np.ascontiguousarray(x.T).view("<u8").ravel() for x in (planes[:8], planes[8:]))
    return np.cumsum(steps.astype(np.uint64), dtype=np.uint64), n.astype(np.int64)


def _by_lang(batches, most: int, of_slice):
    """Runs ``of_slice(lang, grams)`` on the texts (column 1) of each language (column 0) in slices of bounded size."""
    for batch in slices(batches, 1, 1 << 20):
        langs, texts = batch.column(0), batch.column(1)
        for lang in langs.unique().to_pylist():
            same = pa.compute.equal(langs, lang)
            yield from of_slice(lang, _Grams(texts.filter(same), most))


def _keys(lang: str, grams: _Grams) -> np.ndarray:
    """Hashes of grams that tell languages apart, so that one summary serves all languages."""
    salt = Words(pa.array([lang + "\x01"]), np.ones(256, bool)).hashes()[0]
    return mix(grams.hash ^ salt, 6) >> np.uint64(64 - _KEY_BITS)


def summaries(docs: DataFrame, most: int, log2_bins: int, held_grams: int = 1 << 20) -> DataFrame:
    """(bin, mass, size, data): each task's summaries of the hash partitions, which are ranges of the hash.

    Rows without data carry a task's mass of a bin.  A task's summary holds all that it has seen since it last sent it (``held_grams`` distinct grams), so nothing is subtracted yet.
    """
    schema = pa.schema([("bin", pa.int32()), ("mass", pa.int64()), ("size", pa.int32()), ("data", pa.binary())])

    def send(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        bins = (keys >> np.uint64(_KEY_BITS - log2_bins)).astype(np.int32)
        starts = np.flatnonzero(np.diff(bins, prepend=-1))
        ends = [*starts[1:].tolist(), len(bins)]
        rows = [(int(bins[a]), int(n[a:b].sum()), 0, None) for a, b in zip(starts.tolist(), ends, strict=True)]
        rows += [(int(bins[a]), 0, b - a, _packed(keys[a:b], n[a:b])) for a, b in zip(starts.tolist(), ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        whole, parts = none, []

        def of_slice(lang, grams):
            keys = _keys(lang, grams)
            yield _summed(keys, np.ones(len(keys), np.int64))

        for part in _by_lang(batches, most, of_slice):
            parts.append(part)
            if sum(len(h) for h, _ in parts) > held_grams // 2:
                whole = _summed(*(np.concatenate(x) for x in zip(whole, *parts, strict=True)))
                parts.clear()
                if len(whole[0]) > held_grams:
                    yield send(*whole)
                    whole = none
        whole = _summed(*(np.concatenate(x) for x in zip(whole, *parts, strict=True)))
        if len(whole[0]):
            yield send(*whole)

    return docs.mapInArrow(run, "bin int, mass long, size int, data binary")


def _probes(keys: np.ndarray, log2_bits: int, log2_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each key in a Bloom filter whose bits lie by bin."""
    own = np.uint64(log2_bits - log2_bins)
    first = keys >> np.uint64(_KEY_BITS - log2_bits)
    return first.astype(np.int64), ((first >> own << own) | (mix(keys, 9) & ((np.uint64(1) << own) - np.uint64(1)))).astype(np.int64)


def maybe_frequent(sums: DataFrame, log2_bins: int, log2_bits: int, least: int, slack: int = 4) -> np.ndarray:
    """A Bloom filter (bytes) of a superset of all grams of weight ``least`` or more: those that may have it by the merged summary of their bin.

    A bin's mass comes before its grams, so the capacity, ``slack`` x mass / least, exceeds mass / least from the start and what a counter lost stays below ``least`` / slack.
    A gram of a third of all occurrences is one counter, and a row per task of its bin.  Each bin sends its own bytes of the filter, 2^``log2_bits`` bits in all.
    """
    per_bin = 1 << (log2_bits - log2_bins)

    def run(batches):
        cur, mass, summary, wait = None, 0, None, []

        def settle():
            if wait:
                summary.add(*(np.concatenate(x) for x in zip(*wait, strict=True)))
                wait.clear()

        def done():
            if summary is not None:
                settle()
                bits = np.zeros(per_bin, bool)
                for at in _probes(summary.at_least(least), log2_bits, log2_bins):
                    bits[at - cur * per_bin] = True
                if bits.any():
                    yield pa.RecordBatch.from_arrays([pa.array([cur], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["bin", "bits"])

        for batch in batches:
            for bin_, weight, size, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bin_ != cur:
                    yield from done()
                    cur, mass, summary = bin_, 0, None
                mass += weight
                if data is not None:
                    summary = summary or MisraGries(slack * mass // least + slack)
                    wait.append(_unpacked(data, size))
                    if sum(len(x) for x, _ in wait) > max(1 << 16, len(summary.keys)):
                        settle()
        yield from done()

    spark = sums.sparkSession
    parts = max(n_partitions(spark), (1 << log2_bins) // 64)
    with lean(spark):
        got = sums.repartition(parts, "bin").sortWithinPartitions("bin", "size").mapInArrow(run, "bin int, bits binary").toArrow()
    out = np.zeros(1 << (log2_bits - 3), np.uint8)
    for b, data in zip(got["bin"].to_pylist(), got["bits"].to_pylist(), strict=True):
        out[b * per_bin // 8 : (b + 1) * per_bin // 8] = np.frombuffer(data, np.uint8)
    return out


def exact_counts(docs: DataFrame, most: int, bits: np.ndarray, log2_bins: int, least: int) -> DataFrame:
    """(lang, phrase, size, a): the exact counts, at least ``least``, of grams in a Bloom filter; summed by phrase, so a collision of hashes costs work alone."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    log2_bits = len(bits).bit_length() + 2

    def run(batches):
        held: dict[tuple[str, str], int] = {}

        def of_slice(lang, grams):
            keys = _keys(lang, grams)
            hit = np.ones(len(keys), bool)
            for at in _probes(keys, log2_bits, log2_bins):
                hit &= (shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            at = np.flatnonzero(hit)
            _, first, n = np.unique(grams.hash[at], return_index=True, return_counts=True)
            yield [lang] * len(first), grams.text(at[first]).to_pylist(), n.tolist()

        def send():
            langs, phrases, n = [k[0] for k in held], [k[1] for k in held], list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])

        for langs, phrases, n in _by_lang(batches, most, of_slice):
            for key, k in zip(zip(langs, phrases, strict=True), n, strict=True):
                held[key] = held.get(key, 0) + k
            if len(held) > 1 << 17:
                yield send()
        yield send()

    sums = docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return sums.select("lang", "phrase", (F.char_length("phrase") - F.char_length(F.replace("phrase", F.lit(" "))) + 1).alias("size"), "a")


def _cut(phrase: Column, k: Column) -> tuple[Column, Column]:
    left = F.call_function("substring_index", phrase, F.lit(" "), k)
    return left, F.substring(phrase, F.char_length(left) + 2, F.char_length(phrase))


def scored(counts: DataFrame, most: int) -> DataFrame:
    """Each phrase of 2 to ``most`` words with the counts l and r of its lowest-scoring cut (ties to the smallest k) and floor(1000000*a*a/(l*r)).

    Decimals of 38 digits hold the products of counts up to 10^15 exactly.
    """
    left, right = _cut(F.col("phrase"), F.col("k"))
    cuts = counts.where(F.col("size").between(2, most)).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "phrase", "size", "a", "k", left.alias("left"), right.alias("right"))
    of = lambda part, n: counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(n))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    top = (F.lit(1000000).cast("decimal(7,0)") * F.col("a").cast("decimal(15,0)") * F.col("a").cast("decimal(15,0)")).cast("decimal(38,0)")
    cuts = cuts.withColumn("top", top).withColumn("bottom", (wide("l") * wide("r")).cast("decimal(38,0)")).withColumn("score", F.expr("top div bottom"))
    return cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "size", "a", "c.score", "c.l", "c.r")


def uncovered(candidates: DataFrame, most: int, percent: int) -> DataFrame:
    """Candidates without those whose words lie contiguously in a longer candidate that has ``percent`` of their count or more."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(most - 1)), lambda k: F.when(k < F.col("size"), F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice(F.col("_w"), i, k), " "))).otherwise(F.array().cast("array<string>"))))
    longer = candidates.where("size > 2").withColumn("_w", words).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("most_a"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("most_a").alias("most_a"))
    out = candidates.join(longer, ["lang", "phrase"], "left")
    return out.where(F.col("most_a").isNull() | (100 * F.col("most_a") < percent * F.col("a"))).drop("most_a")


def top_by_lang(rows: DataFrame, limit: int) -> DataFrame:
    """Each language's first ``limit`` rows by score, count and phrase, ranked from 1; first per language and hash bucket, so that no language is one task."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(max(8, n_partitions(rows.sparkSession))))
    part = rows.withColumn("_b", bucket).withColumn("_n", F.row_number().over(W.Window.partitionBy("lang", "_b").orderBy(*order))).where(F.col("_n") <= limit).drop("_b", "_n")
    ranked = part.withColumn("rank", F.row_number().over(W.Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= limit)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 3, least: int = 10, percent: int = 50, limit: int = 2000, bin_mass: int = 1 << 21) -> DataFrame:
    """Phrases of 2 to ``most`` words, per language (null: und): lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut at ``.,;:!?`` and line ends into pieces, pieces at blanks and tabs into words; phrases lie in one piece.  A candidate
    has a = ``least`` occurrences or more; see ``scored`` and ``uncovered`` for its score and for which of them go; ``limit`` a language are returned.

    Two passes over the texts.  The first summarises hashes: tasks sum what they see and deal it to hash partitions of about ``bin_mass`` occurrences, and
    the Misra-Gries summary of each has a capacity above mass / least, so every gram of ``least`` occurrences survives, with a bounded number of counters.  The second counts the
    survivors by phrase; a Bloom filter of them (at most 2^28 bits, fuller beyond) keeps most other grams from being spelled out, and the exact counts decide.
    Null and empty texts have no words; languages without candidates no rows; equal rows count each; further columns, whatever their names, are ignored.
    """
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09.,;:!?\x0A-\x0D]+"))
    n = stored(docs.groupBy("lang").agg(F.sum(words).alias("n")), "words")
    mass = most * (n.agg(F.sum("n")).first()[0] or 0)
    log2_bits = bloom_size(mass // least)
    log2_bins = min(log2_bits - 3, max(3, (mass // bin_mass).bit_length()))
    bits = maybe_frequent(summaries(docs, most, log2_bins), log2_bins, log2_bits, least)
    counts = stored(exact_counts(docs, most, bits, log2_bins, least), "counts")
    candidates = stored(scored(counts, most), "candidates")
    release(counts)
    top = top_by_lang(uncovered(candidates, most, percent), limit)
    return top.join(F.broadcast(n) if n.count() <= 10_000 else n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

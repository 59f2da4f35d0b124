"""Near-duplicate components by a size-aware Jaccard self-join of word-shingle sets."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bloom_bits, bloom_size, components, fresh, in_bloom, lean, release, slices, stored, text_offsets
from .tokens import NOT_BLANK, Words, mix, shingle_sets

_N_MINS = 16
_ODD = mix(np.arange(_N_MINS, dtype=np.uint64), 5) | np.uint64(1)
_SETS = "doc_id long, n long, h1 long, h2 long, mins array<long>, shingles binary"
#: Minima and 64-bit words of the bitmap of a set's difference from the centre of its star.
_D_MINS, _D_WORDS = 8, 8


def _ceil(a, b):
    return -(-a // b)


class Rule:
    """Jaccard >= p / q in whole numbers, and the prefix lengths and subset sizes that follow from it."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q

    def overlap(self, a, b):
        """Least intersection of linked sets of sizes a and b."""
        return _ceil(self.p * (a + b), self.p + self.q)

    def probe(self, n):
        """Length of a set's prefix: linked sets have a prefix shingle in common."""
        return n - _ceil(self.p * n, self.q) + 1

    def partners(self, a: int, most: int) -> range:
        return range(_ceil(self.p * a, self.q), min(most, self.q * a // self.p) + 1)

    def subsets(self, a: int, most: int) -> int:
        """How many fixed-size subsets a light set of size a emits if sets up to ``most`` are light."""
        return sum(comb(a, self.overlap(a, b)) for b in self.partners(a, most) if self.overlap(a, b) <= a)


def light_boundary(sizes: dict[int, int], rule: Rule, most: int = 12, list_cost: float = 2.0) -> int:
    """The largest light size, by cost: subsets emitted by light sets against prefix rows and list scans of heavy ones."""

    def cost(x: int) -> float:
        light = sum(n * rule.subsets(a, x) for a, n in sizes.items() if a <= x)
        lists = sum(n * rule.probe(a) for a, n in sizes.items() if a <= most and a >= _ceil(rule.p * (x + 1), rule.q))
        return light + list_cost * lists

    return min(range(most + 1), key=cost)


def _packed(h: np.ndarray, n: np.ndarray) -> pa.Array:
    """Sets of ``n`` hashes each, laid end to end in ``h``, as a binary column."""
    ends = np.concatenate([[0], np.cumsum(n) * 8])
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(h))]).cast(pa.binary())


def _sets(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and set sizes of a column that ``_packed`` made."""
    raw, off = text_offsets(arr)
    n = np.diff(off) // 8
    return np.repeat(np.arange(len(n)), n), np.frombuffer(raw.tobytes(), np.uint64), n


def set_keys(rows: DataFrame) -> DataFrame:
    """(doc_id, n, h1, h2, mins, shingles) per row: the size of its shingle set, a 128-bit hash of the set, its minima under 16 hashes, and the set, as
    sorted 64-bit hashes, so that no later step reads texts again."""

    def run(batches):
        for b in slices(batches, 1, 1 << 20):
            row, h = shingle_sets(Words(b.column(1), NOT_BLANK))
            n = np.bincount(row, minlength=b.num_rows)
            full = np.flatnonzero(n)
            first = np.concatenate([[0], np.cumsum(n)])[full]
            h1, h2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            mins = np.zeros((len(n), _N_MINS), np.uint64)
            if len(full):
                with np.errstate(over="ignore"):
                    h1[full], h2[full] = np.add.reduceat(mix(h, 1), first), np.add.reduceat(mix(h, 2), first)
                    for k in range(_N_MINS):
                        mins[full, k] = np.minimum.reduceat(h * _ODD[k], first)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, mins.size + 1, _N_MINS), pa.int32()), pa.array(mins.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), flat, _packed(h, n)], ["doc_id", "n", "h1", "h2", "mins", "shingles"])

    return rows.mapInArrow(run, _SETS)


def token_order(keys: DataFrame, log2_buckets: int = 18) -> np.ndarray:
    """How often the shingles of each hash bucket occur in the corpus: the frequency part of the global order of shingles.

    Any order is right; this one puts shingles of very frequent passages last.  2**log2_buckets counters, whatever the input.
    """
    size = 1 << log2_buckets

    def run(batches):
        seen = np.zeros(size, np.int64)
        for b in slices(batches, 0, 1 << 20):
            _, h, _ = _sets(b.column(0))
            seen += np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["b", "c"])

    with lean(keys.sparkSession):
        got = keys.select("shingles").mapInArrow(run, "b int, c long").groupBy("b").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["b"].to_numpy()] = got["c"].to_numpy()
    return out


def _signatures(arr: pa.Array, order: np.ndarray, rule: Rule, light: int):
    """(row, token, pos, set size) of each set's list tokens: prefix shingles of heavy sets, subsets of light ones."""
    row, h, n = _sets(arr)
    freq = order[(h & np.uint64(len(order) - 1)).astype(np.int64)]
    at = np.lexsort((h, freq, row))
    row, h = row[at], h[at]
    first = np.concatenate([[0], np.cumsum(n)])
    pos = np.arange(len(h)) - first[row]
    size = n[row]
    heavy = (pos < rule.probe(size)) & (size >= _ceil(rule.p * (light + 1), rule.q))
    out = [(row[heavy], h[heavy], pos[heavy])]
    few, keys = [], []
    for r in np.flatnonzero((n > 0) & (n <= light)):
        a, own = int(n[r]), mix(np.sort(h[first[r] : first[r + 1]]), 3)
        for b in rule.partners(a, light):
            c = rule.overlap(a, b)
            if c <= min(a, b):
                tag = np.uint64(min(a, b) * 10007 + max(a, b))
                with np.errstate(over="ignore"):
                    found = [int(mix(np.array([sum((own[i] for i in pick), tag)], np.uint64), 4)[0]) for pick in combinations(range(a), c)]
                keys += found
                few += [int(r)] * len(found)
    if few:
        out.append((np.array(few), np.array(keys, np.uint64), np.zeros(len(few), np.int64)))
    row, h, pos = (np.concatenate(x) for x in zip(*out, strict=True))
    return row, h, pos, n[row]


def _minima(h: np.ndarray) -> list[int]:
    with np.errstate(over="ignore"):
        return [int(np.min(h * odd).view(np.int64)) for odd in _ODD[:_D_MINS]] if len(h) else []


def _bitmap(h: np.ndarray) -> list[int]:
    """Bits of a set's hashes: two sets differ in at least as many elements as their bitmaps in bits."""
    bits = np.zeros(_D_WORDS * 64, np.uint8)
    bits[(mix(h, 6) % np.uint64(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def _parities(h: np.ndarray) -> bytes:
    """A set's hashes as one or two bits an element, each the parity of the hashes that fall on it: two sets differ in at least as many elements as in bits."""
    size = max(64, 1 << (len(h) - 1).bit_length())
    n = np.bincount((mix(h, 6) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((n & 1).astype(np.uint8)).tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """Bits in which two parities differ; the longer is folded to the length of the other, which keeps parities what they are."""
    short, long = (np.frombuffer(v, np.uint8) for v in sorted((x, y), key=len))
    while len(long) > len(short):
        long = long[: len(long) // 2] ^ long[len(long) // 2 :]
    return int(np.unpackbits(short ^ long).sum())


def _alike(pairs: DataFrame, keys: DataFrame, rule: Rule) -> DataFrame:
    """The candidate pairs (a, b) that sizes and parities of their sets leave room for a link.

    No linked pair is lost: linked sets differ in (q-p) / (p+q) of the sum of their sizes at most.  Sets are shuffled as parities, some fiftieth of their
    bytes, so that whole sets are fetched for few pairs that aren't linked.
    """
    spark = keys.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = stored(ids.select(F.xxhash64("id").alias("k")), "wanted")
    bits = spark.sparkContext.broadcast(bloom_bits(wanted, "k", bloom_size(wanted.count())))

    def read(batches):
        for b in batches:
            hit = pa.array(in_bloom(bits.value, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            found = [np.frombuffer(x, np.uint64) for x in b.column(2).filter(hit).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1).filter(hit), pa.array([len(h) for h in found], pa.int64()), pa.array(map(_parities, found), pa.binary())], ["id", "n", "bits"])

    sketches = keys.select(F.xxhash64("doc_id").alias("k"), "doc_id", "shingles").mapInArrow(read, "id long, n long, bits binary")
    sketches = stored(sketches, "parities")
    p, q = rule.p, rule.q

    def run(batches):
        for b in batches:
            a, z, na, nb, x, y = (c.to_pylist() for c in b.columns)
            may = pa.array([(p + q) * _apart(s, t) <= (q - p) * (m + n) for m, n, s, t in zip(na, nb, x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(may), b.column(1).filter(may)], ["a", "b"])

    side = lambda c: sketches.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}"))
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b")
    out = stored(met.mapInArrow(run, "a long, b long").distinct(), "alike")
    release(wanted, sketches)
    return out


def _overlaps(pairs: DataFrame, keys: DataFrame, rule: Rule, diffs: bool) -> DataFrame:
    """Exact intersections of candidate pairs (a, b): a, b, na, nb, o; with ``diffs`` also what of a's difference from b the join inside a star needs.

    Only sets of documents in pairs leave the scan; a Bloom filter of bounded size, then the join, picks them.
    """
    spark = keys.sparkSession

    def sets(side: str) -> DataFrame:
        wanted = stored(pairs.select(F.xxhash64(side).alias("k")).distinct(), "wanted")
        bits = spark.sparkContext.broadcast(bloom_bits(wanted, "k", bloom_size(wanted.count())))

        def read(batches):
            for b in batches:
                hit = in_bloom(bits.value, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                yield pa.RecordBatch.from_arrays([x.filter(pa.array(hit)) for x in b.columns[1:]], [side, f"s{side}"])

        return keys.select(F.xxhash64("doc_id").alias("k"), "doc_id", "shingles").mapInArrow(read, f"{side} long, s{side} binary").hint("merge")

    joined = pairs.select("a", "b").join(sets("a"), "a").join(sets("b"), "b")
    p, q = rule.p, rule.q

    def run(batches):
        for batch in slices(batches, 2, 1 << 20):
            out = []
            for a, b, sa, sb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                both = y[at] == x if len(y) else np.zeros(len(x), bool)
                o = int(both.sum())
                kept, minima, bitmap, cost, oo, own, most = None, None, None, 0, 0, 0, 0
                if diffs:
                    # Inside the star of b: cost c of a set is q*removed + p*added; sets x, y of the star are linked if and only if
                    # (q-p)*|b| + (p+q)*shared >= c_x + c_y, shared being what their differences from b have in common.
                    added, removed = x[~both], np.setdiff1d(y, x[both], assume_unique=True)
                    cost, base, size = q * len(removed) + p * len(added), (q - p) * len(y), len(added) + len(removed)
                    # Prefixes that meet those of linked sets: outside the centre's reach, there and no nearer than x, anywhere.
                    oo, own = (size - _ceil(c, p + q) + 1 for c in (cost + 1, 2 * cost - base))
                    most = size - _ceil(cost + 1 - base, p + q) + 1 if cost > base else oo
                    diff = np.concatenate([added, removed])
                    kept, minima, bitmap = diff.view(np.int64), _minima(diff), _bitmap(diff)
                out.append((a, b, len(x), len(y), o, kept, minima, bitmap, cost, oo, own, most))
            cols = list(zip(*out, strict=True)) or [()] * 12
            kinds = (pa.int64(),) * 5 + (pa.list_(pa.int64()),) * 3 + (pa.int64(),) + (pa.int32(),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["a", "b", "na", "nb", "o", "diff", "minima", "bitmap", "cost", "oo", "own", "most"])

    schema = "a long, b long, na long, nb long, o long, diff array<long>, minima array<long>, bitmap array<long>, cost long, oo int, own int, most int"
    return stored(joined.select("a", "b", "sa", "sb").mapInArrow(run, schema), "overlaps")


def _linked(rule: Rule):
    return (rule.p + rule.q) * F.col("o") >= rule.p * (F.col("na") + F.col("nb"))


def _star_pairs(reps: DataFrame) -> DataFrame:
    """(a, b, weight): for each set its centre, the most popular set with which it shares at least 4 of 16 minima.

    A centre of a minimum is the set whose minima are shared by the most sets, so a group of near copies gathers around one of its most typical members
    in one row per member, whatever its size.
    """
    keys = reps.select("rep", "n", F.posexplode("mins").alias("k", "v")).select("rep", "n", F.xxhash64("k", "v").alias("key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    keys = stored(keys.join(counts, "key"), "minima")
    weights = keys.groupBy("rep").agg(F.sum("c").alias("weight"))
    best = keys.join(weights, "rep").groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"), "n")).alias("m"))
    best = best.select("key", (-F.col("m.minus")).alias("b"), F.col("m.n").alias("nb"), F.col("m.weight").alias("weight"))
    near = keys.join(best, "key").where((F.col("rep") != F.col("b")) & (5 * F.least("n", "nb") >= 2 * F.greatest("n", "nb")))
    near = near.groupBy(F.col("rep").alias("a"), "b", "weight").agg(F.count("*").alias("same")).where("same >= 4")
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("weight"), "b"))
    out = stored(near.withColumn("rank", rank).where("rank = 1").select("a", "b", "weight"), "star-pairs")
    release(keys)
    return out


def _star_links(rows: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) inside stars, one candidate a row and minimum: of a star's members whose differences share a minimum, all meet the nearest to the centre.

    Groups of linked members far from their star's centre come together here, in rows that grow with the members, not with their pairs.
    """
    keys = rows.select("a", "cost", F.posexplode("minima").alias("k", "v"), "b").select("a", "cost", F.xxhash64("b", "k", "v").alias("key"))
    nearest = keys.groupBy("key").agg(F.min(F.struct("cost", "a")).alias("m"), F.count("*").alias("c")).where("c > 1").select("key", F.col("m.a").alias("z"))
    pairs = keys.join(nearest, "key").where("a <> z").select("a", "z").distinct()
    mine = rows.select("a", "cost", (rule.q - rule.p) * F.col("nb"), "diff").toDF("a", "cost", "base", "diff")
    near = pairs.join(mine, "a").join(mine.select(F.col("a").alias("z"), F.col("cost").alias("cost_z"), F.col("diff").alias("diff_z")), "z")
    shared = F.size(F.array_intersect("diff", "diff_z"))
    return near.where((rule.p + rule.q) * shared >= F.col("cost") + F.col("cost_z") - F.col("base")).select("a", F.col("z").alias("b"))


def _inside_stars(members: DataFrame, comps: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of sets of one star and different components: they must share part of their differences from the centre.  And the table they are read from.

    ``members`` are the rows of stars with a set that isn't linked to the centre.  Differences are ordered by frequency in the star, rare ones first, so that what
    many members share stays out of the prefixes.  Two sets meet on a key of both prefixes only if its places and their bitmaps leave room for a link.
    """
    base, both = (rule.q - rule.p) * F.col("nb"), rule.p + rule.q
    rows = members.withColumn("outside", F.col("cost") > base).withColumn("size", F.size("diff"))
    rows = rows.join(comps.withColumnRenamed("node", "a"), "a", "left").withColumn("comp", F.coalesce("root", "a"))
    bits = [F.col("bitmap")[k].alias(f"w{k}") for k in range(_D_WORDS)]
    rows = rows.select("a", "comp", "outside", "oo", "own", "most", "cost", base.alias("base"), "size", *bits)
    keyed = stored(members.select("a", F.col("b").alias("star"), F.explode("diff").alias("e")).select("a", F.xxhash64("star", "e").alias("key")), "differences")
    place = F.row_number().over(W.partitionBy("a").orderBy("c", "key"))
    ranked = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("c")), "key").withColumn("r", place).where("c > 1").select("a", "key", "r")
    ranked = stored(ranked.join(rows, "a").where("r <= most").drop("most"), "prefixes")
    release(keyed)
    keyed = ranked
    several = keyed.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("key")
    keyed = keyed.join(several, "key", "left_semi")
    words = [f"w{k}" for k in range(_D_WORDS)]
    named = ["a", "comp", "cost", "size", "r", "oo", *words]
    other = lambda df: df.select("key", *[F.col(c).alias(f"{c}_y") for c in named])
    room = both * (F.least("r", "r_y") + F.least(F.col("size") - F.col("r"), F.col("size_y") - F.col("r_y"))) >= F.col("cost") + F.col("cost_y") - F.col("base")
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_y"))) for w in words), F.lit(0))
    alike = both * (F.col("size") + F.col("size_y") - apart) >= 2 * (F.col("cost") + F.col("cost_y") - F.col("base"))
    fits = (F.col("comp") != F.col("comp_y")) & room & alike
    outside, inside = keyed.where("outside"), keyed.where("not outside and r <= oo")
    mixed = outside.join(other(inside), "key").where(fits)
    further = F.struct("cost", "a") < F.struct("cost_y", "a_y")  # the nearer of two, which needs the shorter prefix, looks the other up
    far = outside.where("r <= own").join(other(outside.where("r <= oo")), "key").where(further & fits)
    return mixed.select("a", "a_y").unionByName(far.select("a", "a_y")).select(F.least("a", "a_y").alias("a"), F.greatest("a", "a_y").alias("b")), ranked


def _between_stars(tokens: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs from inverted lists: sets of different stars and components with a list token in common.  And the table they are read from.

    A list is first read by star (aggregated before the shuffle), so the members of one star are never paired with each other.
    """
    several = tokens.groupBy("token").agg(F.min("star").alias("s1"), F.max("star").alias("s2"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    several = several.where("s1 <> s2 and c1 <> c2").select("token")
    tokens = stored(tokens.join(several, "token", "left_semi"), "lists")
    # The first common token of two linked sets leaves them room for all that they need behind it; one such token a pair is enough, so sets, and
    # stars of sets, whose sizes or places don't leave it don't meet on a token at all.
    rest = F.col("n") - F.col("pos") - 1
    stars = tokens.groupBy("token", "star").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(rest).alias("rest"))
    other = stars.select("token", *[F.col(c).alias(f"{c}2") for c in ("star", "low", "high", "rest")])
    sizes = (rule.q * F.col("high") >= rule.p * F.col("low2")) & (rule.q * F.col("high2") >= rule.p * F.col("low"))
    room = (rule.p + rule.q) * (1 + F.least("rest", "rest2")) >= rule.p * (F.col("low") + F.col("low2"))
    meet = stars.join(other, "token").where((F.col("star") < F.col("star2")) & sizes & room).select("token", "star", "star2")
    left = meet.join(tokens, ["token", "star"])
    right = tokens.select("token", F.col("star").alias("star2"), *[F.col(c).alias(f"{c}2") for c in ("rep", "n", "pos", "comp")])
    behind = F.least(F.col("n") - F.col("pos") - 1, F.col("n2") - F.col("pos2") - 1)
    both = left.join(right, ["token", "star2"]).where((F.col("comp") != F.col("comp2")) & ((rule.p + rule.q) * (1 + behind) >= rule.p * (F.col("n") + F.col("n2"))))
    return both.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct(), tokens


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = (3, 4)) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id.

    Documents are linked if the Jaccard similarity of their sets of 5-word shingles (blank-separated words, A-Z lower-cased; a shorter text is one
    shingle) is at least p/q of ``similarity``; component_id is the smallest id that links reach.  Exact (up to collisions of 64-bit hashes):

    1. Rows with equal sets are one class, represented by its smallest id.
    2. Classes gather in stars around a typical set and are compared with it: all members near the centre are one component at the cost of one row each.
    3. Size-aware join for what isn't in one component yet.  Light sets, up to a size chosen by cost, emit all subsets of the size that
       a link needs; heavy sets emit a prefix, and inverted lists of the shingles are scanned, star by star.  Only tokens that occur twice are kept.
       Pairs of one star share part of their differences from its centre, and those are few.
    4. Candidates with room for a link by the parities of their sets are verified on whole sets, and components are made of the links.

    No set of all pairs of a group is made, no list or candidate set is capped, and the driver gets bounded sketches only.
    Without words or text: n_shingles 0, linked with nothing.  Rows that repeat an id are one document to the links (their texts'
    links are joined); rows without an id are in no component (component_id null).
    """
    rule = Rule(*similarity)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = stored(set_keys(rows), "set-keys")
    full = keys.where("n > 0 and doc_id is not null")
    reps = stored(full.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("mins").alias("mins")), "classes")

    pairs = _star_pairs(reps)
    compared = _overlaps(pairs.select("a", "b"), full, rule, True)
    near = compared.join(pairs, ["a", "b"])
    best = near.where(5 * F.col("o") >= 2 * (F.col("na") + F.col("nb") - F.col("o"))).withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("weight"), "b"))).where("rank = 1")
    best = stored(best, "stars")
    loose = best.join(best.where(~_linked(rule)).select("b").distinct(), "b", "left_semi")  # other stars are one component
    links = stored(near.where(_linked(rule)).select("a", "b").unionByName(_star_links(loose, rule)), "links")
    release(compared, pairs)
    comps = components(links)

    sizes = {r.n: r.c for r in reps.where("n <= 12").groupBy("n").agg(F.count("*").alias("c")).collect()}
    light = light_boundary(sizes, rule)
    order = spark.sparkContext.broadcast(token_order(full))

    def tokens_only(batches):
        for b in slices(batches, 0, 1 << 20):
            _, h, _, _ = _signatures(b.column(0), order.value, rule, light)
            token, c = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(c.astype(np.int64))], ["token", "c"])

    twice = full.select("shingles").mapInArrow(tokens_only, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where("c > 1")
    twice = stored(twice.select("token"), "twice")
    bits = spark.sparkContext.broadcast(bloom_bits(twice, "token", bloom_size(twice.count())))
    release(twice)

    def lists(batches):
        for b in slices(batches, 1, 1 << 20):
            row, h, pos, n = _signatures(b.column(1), order.value, rule, light)
            at = in_bloom(bits.value, h)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(ids[row[at]]), pa.array(n[at].astype(np.int32)), pa.array(pos[at].astype(np.int32))], ["token", "rep", "n", "pos"])

    placed = reps.select("rep").join(best.select(F.col("a").alias("rep"), F.col("b").alias("star")), "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    placed = stored(placed.select("rep", F.coalesce("star", "rep").alias("star"), F.coalesce("root", "rep").alias("comp")), "placed")
    tokens = full.select("doc_id", "shingles").mapInArrow(lists, "token long, rep long, n int, pos int").join(placed, "rep")
    tokens = stored(tokens, "tokens")
    between, lists_of_stars = _between_stars(tokens, rule)
    release(tokens, placed)
    inside, prefixes = _inside_stars(loose, comps, rule)
    rest = between.unionByName(inside).distinct()
    side = comps.withColumnRenamed("node", "a").withColumnRenamed("root", "ra"), comps.withColumnRenamed("node", "b").withColumnRenamed("root", "rb")
    rest = rest.join(side[0], "a", "left").join(side[1], "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    rest = stored(rest, "candidates")
    release(lists_of_stars, prefixes)
    more = _overlaps(_alike(rest, full, rule), full, rule, False).where(_linked(rule)).select("a", "b")
    final = components(links.unionByName(more))
    roots = reps.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("n", "h1", "h2", F.coalesce("root", "rep").alias("component"))
    roots = stored(roots, "roots")
    out = keys.join(roots, ["n", "h1", "h2"], "left")
    out = stored(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")), "jaccard")
    release(keys, reps, best, links, comps, rest, final, roots)
    return out


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One document of each component, the one with the smallest id; all columns as they are.  Rows without an id stay."""
    key = fresh(docs, "jaccard_id")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone.hint("merge"), docs[id_col] == gone[key], "left_anti")

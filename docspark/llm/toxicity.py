"""Toxicity: gradient-boosted trees over dense features of the whole text, with isotonic calibration."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_offsets
from .tokens import _LOWER, NOT_BLANK, Words

#: Second-person pronouns of the languages at hand.
SECOND_PERSON = ("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "tus")
#: Digits that stand for letters in disguised words.
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
FEATURES = (
    "lexicon_density", "lexicon_weight", "lexicon_hits", "lexicon_top", "disguised_hits", "second_person", "near_second_person",
    "capitals", "shouted_words", "punctuation", "exclamations", "obfuscated", "log_words", "mean_word",
)

_SQUASH = _LOWER.copy()
for _a, _b in _LEET.items():
    _SQUASH[ord(_a)] = ord(_b)
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = _IS_LETTER[128:] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True
_STAYS = _IS_LETTER | _IS_DIGIT | ~NOT_BLANK  # what squashing leaves: letters, digits (as letters) and blanks


def _column(raw: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes()))


def squashed(arr: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased, digits read as letters and symbols removed, so that disguised words look like plain ones."""
    raw, off = text_offsets(arr)
    stay = _STAYS[raw]
    return _column(_SQUASH[raw[stay]], np.concatenate([[0], np.cumsum(stay)])[off])


def _per_row(values: np.ndarray, first_of_row: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[first_of_row])


class Lexicon:
    """Words with weights, looked up by hash."""

    def __init__(self, words: list[str], weights: list[float]):
        h = Words(pa.array(words, pa.string()), NOT_BLANK).hashes() if words else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.words, self.hash, self.weight = words, h[order], np.asarray(weights, np.float64)[order]

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hash) or not len(h):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.weight[at], 0.0)


_SECOND = Lexicon(list(SECOND_PERSON), [1.0] * len(SECOND_PERSON))


def features(arr: pa.Array, lexicon: Lexicon, near: int = 5) -> np.ndarray:
    """A row of FEATURES per text; all zeros for null or blank texts."""
    raw, off = text_offsets(arr)
    plain, flat = Words(arr, NOT_BLANK), Words(squashed(arr), NOT_BLANK)
    n = np.maximum(np.diff(flat.first_of_row), 1).astype(float)
    n_bytes = np.maximum(np.diff(off), 1).astype(float)
    weight = lexicon.of(flat.hashes())
    hit = (weight > 0).astype(float)
    second = _SECOND.of(flat.hashes()) > 0
    close = np.zeros(len(second), bool)
    for k in range(1, near + 1):
        same = flat.row[k:] == flat.row[:-k]
        close[k:] |= second[:-k] & same
        close[:-k] |= second[k:] & same
    open_hit = Lexicon.of(lexicon, _strip_hashes(arr)) > 0
    upper = (raw >= 65) & (raw <= 90)
    cum = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    letters, digits, uppers = cum(_IS_LETTER[raw]), cum(_IS_DIGIT[raw]), cum(upper)
    in_word = lambda c: c[plain.end] - c[plain.start]
    size = plain.end - plain.start
    inner = cum(~(_IS_LETTER[raw] | (raw == 39) | (raw == 45) | ~NOT_BLANK[raw]))  # digits and symbols
    core = inner[np.maximum(plain.end - 1, plain.start)] - inner[plain.start]
    obfuscated = (in_word(letters) >= 2) & (core > 0) & (in_word(digits) < size / 2)
    shouted = (in_word(uppers) == in_word(letters)) & (in_word(letters) >= 3)
    by_byte = lambda mask: _per_row(mask.astype(float), off)
    hits = _per_row(hit, flat.first_of_row)
    top = np.zeros(len(arr))
    np.maximum.at(top, flat.row, weight)
    out = [
        hits / n, _per_row(weight, flat.first_of_row) / n, hits, top, np.maximum(hits - np.bincount(plain.row, open_hit, len(arr)), 0),
        _per_row(second.astype(float), flat.first_of_row) / n, _per_row((close & (hit > 0)).astype(float), flat.first_of_row),
        by_byte(upper) / n_bytes, _per_row(shouted.astype(float), plain.first_of_row) / n, by_byte(~(_IS_LETTER | _IS_DIGIT | ~NOT_BLANK)[raw]) / n_bytes,
        by_byte(raw == 33) / n_bytes, _per_row(obfuscated.astype(float), plain.first_of_row) / n, np.log1p(np.diff(flat.first_of_row)), _per_row(size.astype(float), plain.first_of_row) / n,
    ]
    return np.stack(out, axis=1).astype(np.float64)


def _strip_hashes(arr: pa.Array) -> np.ndarray:
    """Hashes of the blank-separated words with symbols removed but digits as they are: plain words, not disguised ones."""
    raw, off = text_offsets(arr)
    keep = (_IS_LETTER | _IS_DIGIT | ~NOT_BLANK)[raw]
    # A word of symbols alone goes; keep one mark byte for it so that words stay aligned with the plain ones.
    words = Words(arr, NOT_BLANK)
    none = np.concatenate([[0], np.cumsum(keep)])
    bare = words.start[none[words.end] == none[words.start]]
    keep[bare] = True
    return Words(_column(_LOWER[raw[keep]], np.concatenate([[0], np.cumsum(keep)])[off]), NOT_BLANK).hashes()


class Trees:
    """Gradient-boosted regression trees for the logistic loss: histogram splits, Newton steps."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
        w = np.ones(len(y)) if weight is None else weight
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        p = (w @ y + 1) / (w.sum() + 2)
        self.start, self.trees = math.log(p / (1 - p)), []
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            tree: dict[int, tuple] = {}
            leaf = np.ones(len(y), np.int64)
            self._grow(tree, 1, np.arange(len(y)), binned, w * (y - q), w * q * (1 - q), leaf)
            self.trees.append(tree)
            f += self._values(tree, leaf)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def _grow(self, tree, node, rows, binned, grad, hess, leaf):
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-9, None)
        if node < 1 << self.depth and len(rows) >= 2 * self.least:
            for j, edges in enumerate(self.edges):
                if not len(edges):
                    continue
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, v, len(edges) + 1))[:-1] for v in (grad[rows], hess[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
                gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k))
        if best[1] is None:
            tree[node] = (None, self.rate * g / (h + self.ridge))
            leaf[rows] = node
            return
        j, k = best[1]
        tree[node] = (j, k)
        left = binned[rows, j] <= k
        self._grow(tree, 2 * node, rows[left], binned, grad, hess, leaf)
        self._grow(tree, 2 * node + 1, rows[~left], binned, grad, hess, leaf)

    @staticmethod
    def _values(tree, leaf):
        value = np.zeros(max(tree) + 1)
        for k, (j, v) in tree.items():
            if j is None:
                value[k] = v
        return value[leaf]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, f = self._bin(x), np.full(len(x), self.start)
        for tree in self.trees:
            at = np.ones(len(x), np.int64)
            for node in sorted(tree):
                j, k = tree[node]
                if j is not None:
                    here = at == node
                    at[here] = 2 * node + (binned[here, j] > k)
            f += self._values(tree, at)
        return f


class Isotonic:
    """A non-decreasing map of margins to probabilities, by pooling adjacent violators; linear between pools' centres."""

    def fit(self, margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Isotonic:
        w = np.ones(len(y)) if weight is None else weight
        order = np.argsort(margin, kind="stable")
        pools: list[list[float]] = []
        for m, v, n in zip(margin[order], y[order], w[order], strict=True):
            pools.append([v * n, n, m])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                a, b = pools.pop(), pools[-1]
                b[0], b[1], b[2] = b[0] + a[0], b[1] + a[1], (b[2] * b[1] + a[2] * a[1]) / (a[1] + b[1])
        self.x = np.array([p[2] for p in pools])
        self.p = np.array([(p[0] + 0.5 * 0.02) / (p[1] + 0.02) for p in pools])
        return self

    def of(self, margin: np.ndarray) -> np.ndarray:
        p = np.interp(margin, self.x, self.p)
        # A hair of the margin breaks ties within a pool, so that scores still rank.
        return np.clip(p * 0.998 + 0.002 / (1 + np.exp(-margin)), 0.0, 1.0)


class Model:
    """What scoring needs: the lexicon, the trees and the calibration."""

    def __init__(self, lexicon: Lexicon, trees: Trees | None, calibration: Isotonic | None, prior: float):
        self.lexicon, self.trees, self.calibration, self.prior = lexicon, trees, calibration, prior

    def score(self, arr: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(arr), self.prior)
        return self.calibration.of(self.trees.margin(features(arr, self.lexicon)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, lexicon_size: int = 300, min_docs: int = 4) -> Model:
    """Learn from labelled documents.

    ``max_rows`` bounds the labelled rows that are used: half of it for either label at most, by a hash of the id.  Where that leaves rows of a label out,
    those used stand for them: trees, calibration and prior weigh each by its label's count / rows used, scaled to 1 on average, so that scores
    are shares of toxic rows at every size.  The ids used go to all tasks (bounded by max_rows), so no text is shuffled but theirs.  The lexicon is the ``lexicon_size`` words with the highest
    smoothed log-odds of being in a toxic document among those in ``min_docs`` of them; it is learned on the half of the sample that the trees aren't, so that its
    densities mean the same in training and on new texts.  A fifth of the trees' half calibrates.
    Rows without id or label are left out; an id with both labels counts as toxic; without rows of both labels the score is the
    share of toxic rows (0.5 without any).
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("_tid"), F.col(label_col).cast("int").alias("toxic")).where("_tid is not null and toxic in (0, 1)").groupBy("_tid").agg(F.max("toxic").alias("toxic"))
    known = stored(known, "labels")
    by_hash = F.xxhash64(F.lit(11), "_tid")
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    stands = {k: n / min(n, max_rows // 2) for k, n in counts.items()}
    scale = sum(min(n, max_rows // 2) for n in counts.values()) / max(sum(counts.values()), 1)
    some = [known.where(F.col("toxic") == k).orderBy(by_hash, "_tid").limit(max_rows // 2) for k in (0, 1)]
    sample = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(some[0].unionByName(some[1])), F.col("_id") == F.col("_tid"))
    sample = sample.dropDuplicates(["_id"]).select(F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(10)).cast("int").alias("fold"), "toxic", "text", "_id")
    sample = stored(sample, "labelled")
    sums = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    if not sums.n or not sums.bad or sums.bad == sums.n:
        return Model(Lexicon([], []), None, None, (sums.bad / sums.n) if sums.n else 0.5)
    prior = sums.bad * stands[1] / (sums.bad * stands[1] + (sums.n - sums.bad) * stands[0])

    def words(batches):
        for b in slices(batches, 1, 1 << 20):
            flat = squashed(b.column(1)).to_pylist()
            sets = [list({w for w in t.split() if len(w) < 40}) for t in flat]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.string()))], ["toxic", "words"])

    def lexicon_of(part: DataFrame) -> Lexicon:
        total = part.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
        counted = part.select("toxic", "text").mapInArrow(words, "toxic int, words array<string>").select("toxic", F.explode("words").alias("word"))
        counted = counted.groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).where(F.col("bad") >= min_docs)
        odds = F.log((F.col("bad") + 0.5) / (total.bad + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (total.n - total.bad + 1.0))
        z = odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("n") - F.col("bad") + 0.5))
        best = counted.select("word", odds.alias("odds"), z.alias("z")).where((F.col("z") > 2.5) & (F.col("odds") > 0.7)).orderBy(F.desc("z"), "word").limit(lexicon_size).collect()
        return Lexicon([r.word for r in best], [float(r.odds) for r in best])

    lexicon = lexicon_of(sample.where("fold < 4"))
    shared = spark.sparkContext.broadcast(lexicon)

    def dense(batches):
        for b in slices(batches, 2, 1 << 20):
            x = features(b.column(2), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(x.tolist(), pa.list_(pa.float64()))], ["fold", "toxic", "_id", "x"])

    kind = sample.schema["_id"].dataType.simpleString()
    got = sample.where("fold >= 4").select("fold", "toxic", "text", "_id").mapInArrow(dense, f"fold int, toxic int, _id {kind}, x array<double>").toPandas().sort_values("_id")
    if got.toxic.nunique() < 2:
        return Model(lexicon, None, None, prior)
    x, y, held = np.array(got.x.tolist()), got.toxic.to_numpy(float), (got.fold == 9).to_numpy() | (got.fold == 8).to_numpy()
    weight = np.where(y == 1, stands[1], stands[0]) * scale
    trees = Trees().fit(x[~held], y[~held], weight[~held])
    if held.sum() < 20 or len(np.unique(y[held])) < 2:
        held = np.ones(len(y), bool)
    return Model(lexicon, trees, Isotonic().fit(trees.margin(x[held]), y[held], weight[held]), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, in place: the model goes to all tasks, its size is bounded by the lexicon's and the trees'.

    Null and empty texts get the score of a text without words; rows that repeat an id are scored each on its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches, 1, 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1)), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Documents that score below ``threshold``, all columns as they are; filtered in place, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches, at, 1 << 20):
            texts = b.column(at)
            yield b.filter(pa.array(shared.value.score(texts.fill_null("")) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder`` when divided by 5."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == remainder, F.lit(False))

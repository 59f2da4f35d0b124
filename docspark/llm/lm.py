"""Language-model scoring: a log-bilinear neural model, trained in numpy by noise-contrastive estimation on all training texts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import slices, stored
from .tokens import NOT_BLANK, Words, mix

END = int(mix(np.array([0x0E4D], np.uint64), 99)[0])
END_SIGNED = END - (1 << 64) if END >> 63 else END
_COUNTS = "h long, cls int, c long"


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Tokens:
    """The tokens of a column, row by row with one end each: hashes, suffix classes and rows."""

    def __init__(self, arr: pa.Array, suffixes: int):
        w = Words(arr, NOT_BLANK)
        h = w.hashes()
        last = w.bytes[w.end - 1].astype(np.uint64) if len(h) else np.zeros(0, np.uint64)
        before = np.where(w.end - w.start > 1, w.bytes[np.maximum(w.end - 2, 0)], 0).astype(np.uint64) if len(h) else last
        suffix = (mix(last * np.uint64(256) + before, 3) % np.uint64(suffixes)).astype(np.int32)
        n = len(arr)
        self.per_row = w.per_row + 1
        self.first = np.concatenate([[0], np.cumsum(self.per_row)])
        self.row = np.repeat(np.arange(n), self.per_row)
        at = np.arange(len(h)) + w.row  # each row before has one end more
        self.h = np.full(int(self.first[-1]), END, np.uint64)
        self.h[at] = h
        self.suffix = np.zeros(len(self.h), np.int32)
        self.suffix[at] = suffix
        self.is_end = np.ones(len(self.h), bool)
        self.is_end[at] = False


def count_tokens(docs: DataFrame, suffixes: int) -> DataFrame:
    """(h, cls, c) of every distinct token of all texts: hash, suffix class, count.  Counts are summed in numpy before they reach Spark."""

    def run(batches):
        for b in slices(batches, 0, 8 << 20):
            t = Tokens(b.column(0), suffixes)
            h, at, c = np.unique(t.h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(h)), pa.array(t.suffix[at]), pa.array(c.astype(np.int64))], ["h", "cls", "c"])

    return docs.select("text").mapInArrow(run, _COUNTS).groupBy("h").agg(F.min("cls").alias("cls"), F.sum("c").alias("c"))


class Vocabulary:
    """Word classes: the end, the ``head`` most frequent words each by itself, and a class per suffix for all others.

    ``log_share`` of a class is log10 of what a word's count is divided by inside it; ``common`` holds the counts of the most
    frequent words, so that only the others need a join.
    """

    def __init__(self, top: pd.DataFrame, by_class: pd.DataFrame, n_tokens: int, n_distinct: int, n_ends: int, head: int, suffixes: int):
        self.n_tokens, self.n_distinct, self.head, self.suffixes = n_tokens, n_distinct, head, suffixes
        self.size = 1 + head + suffixes
        h = top.h.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        self.h, self.c = h[order], top.c.to_numpy(np.int64)[order]
        first = h[:head]
        by_hash = np.argsort(first)
        self.head_h, self.head_class = first[by_hash], (by_hash + 1).astype(np.int16)
        count = np.zeros(self.size)
        distinct = np.zeros(self.size)
        count[1 + head + by_class.cls.to_numpy(int)] = by_class.c.to_numpy(float)
        distinct[1 + head + by_class.cls.to_numpy(int)] = by_class.n.to_numpy(float)
        self.log_share = np.log10(count + 0.5 * (distinct + 1))
        self.class_count = count
        self.class_count[1 + np.arange(min(head, len(top)))] = top.c.to_numpy(float)[:head]
        self.class_count[0] = n_ends
        self.base = math.log10(n_tokens + 0.5 * (n_distinct + 1))

    def classes(self, t: Tokens) -> np.ndarray:
        """Class of each token."""
        cls = (1 + self.head + t.suffix).astype(np.int16)
        if len(self.head_h):
            at = np.minimum(np.searchsorted(self.head_h, t.h), len(self.head_h) - 1)
            own = self.head_h[at] == t.h
            cls[own] = self.head_class[at[own]]
        cls[t.is_end] = 0
        return cls

    def counts(self, t: Tokens) -> np.ndarray:
        """Count of each token; -1 where it isn't among the common ones."""
        c = np.full(len(t.h), -1, np.int64)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, t.h), len(self.h) - 1)
            known = self.h[at] == t.h
            c[known] = self.c[at[known]]
        c[t.is_end] = int(self.class_count[0])
        return c


class LogBilinear:
    """Scores of the next class: (sum over context positions of Q[class] C_position) . W[class] + b[class]."""

    def __init__(self, vocab: Vocabulary, context: int, dim: int, seed: int):
        r = np.random.default_rng(seed)
        self.n, self.context, self.dim = vocab.size, context, dim
        p = (vocab.class_count + 0.5) / (vocab.class_count + 0.5).sum()
        self.noise = p
        self.parts = {
            "Q": (r.normal(0, 0.3, (self.n + 1, dim))).astype(np.float32),
            "C": np.repeat((np.eye(dim) / context)[None], context, 0).astype(np.float32),
            "W": (r.normal(0, 0.05, (self.n, dim))).astype(np.float32),
            "b": np.log(p).astype(np.float32),
        }

    def contexts(self, cls: np.ndarray, row: np.ndarray) -> np.ndarray:
        """(context, tokens): the class k + 1 tokens before each one; n where the text hasn't begun."""
        at = np.arange(len(cls)) + (row + 1) * self.context
        padded = np.full(len(cls) + (int(row[-1]) + 1 if len(row) else 0) * self.context, self.n, np.int16)
        padded[at] = cls
        return np.stack([padded[at - k] for k in range(1, self.context + 1)])

    def train(self, streams, batch: int, noise: int, rate: float, seed: int) -> int:
        """One pass of noise-contrastive estimation over (cls, contexts) chunks, with Adagrad; the tokens of a batch share their noise words."""
        r = np.random.default_rng(seed)
        p, log_kp = self.parts, np.log(noise * self.noise).astype(np.float32)
        square = {k: np.full(v.shape, 1e-4, np.float32) for k, v in p.items()}
        cdf, seen = np.cumsum(self.noise), 0
        slot = (np.arange(self.context) * (self.n + 1)).astype(np.int16)[:, None]
        for cls, ctx in streams:
            for i in range(0, len(cls), batch):
                t, x = cls[i : i + batch], ctx[:, i : i + batch]
                m = len(t)
                z = np.minimum(np.searchsorted(cdf, r.random(noise)), self.n - 1)
                hidden = self._hidden(np.matmul(p["Q"], p["C"]), x)
                wt, wz = p["W"][t], p["W"][z]
                good = 1 / (1 + np.exp(np.clip(np.einsum("md,md->m", hidden, wt) + p["b"][t] - log_kp[t], -30, 30)))
                bad = -1 / (1 + np.exp(np.clip((log_kp[z] - p["b"][z]) - hidden @ wz.T, -30, 30)))
                d_hidden = good[:, None] * wt + bad @ wz
                grad_w, grad_b = _scattered(t, good[:, None] * hidden, self.n), np.bincount(t, good, self.n).astype(np.float32)
                np.add.at(grad_w, z, bad.T @ hidden)
                np.add.at(grad_b, z, bad.sum(0))
                # What each position passes down, summed by class, gives both the words' and the positions' gradients.
                down = _scattered((x + slot).ravel(), np.broadcast_to(d_hidden, (self.context, *d_hidden.shape)).reshape(-1, self.dim), self.context * (self.n + 1))
                down = down.reshape(self.context, self.n + 1, self.dim)
                grad = {"Q": np.matmul(down, p["C"].transpose(0, 2, 1)).sum(0), "C": np.matmul(p["Q"].T, down), "W": grad_w, "b": grad_b}
                for k, g in grad.items():
                    g /= m
                    square[k] += g * g
                    p[k] += rate * g / np.sqrt(square[k])
                seen += m
        return seen

    def _hidden(self, moved: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = moved[0][x[0]]
        for k in range(1, self.context):
            out += moved[k][x[k]]
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.parts.values()])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for k, v in self.parts.items():
            self.parts[k] = values[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def log10_probs(self, cls: np.ndarray, ctx: np.ndarray, rows: int = 1024) -> np.ndarray:
        """log10 p(class | context) of each token, normalised over all classes by batched matrix products."""
        p = self.parts
        moved = np.matmul(p["Q"], p["C"])
        # The bias is one more column; scores stay far below float32's range unless this bound says otherwise.
        moved = np.concatenate([moved, np.full((*moved.shape[:2], 1), 1 / self.context, np.float32)], axis=2).astype(np.float32)
        wt = np.ascontiguousarray(np.concatenate([p["W"], p["b"][:, None]], axis=1).T)
        bound = np.sqrt((moved**2).sum(2)).max(1).sum() * np.sqrt((wt**2).sum(0)).max()
        out, s = np.empty(len(cls)), np.empty((rows, self.n), np.float32)
        at = np.arange(rows)
        for i in range(0, len(cls), rows):
            t = cls[i : i + rows]
            m = len(t)
            scores = np.matmul(self._hidden(moved, ctx[:, i : i + rows]), wt, out=s[:m])
            if bound > 80:
                scores -= scores.max(1, keepdims=True)
            picked = scores[at[:m], t]
            np.exp(scores, out=scores)
            out[i : i + m] = picked - np.log(scores.sum(1))
        return out / math.log(10)


def _scattered(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by ``at`` (small integers)."""
    order = np.argsort(at, kind="stable")
    key = at[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    out = np.zeros((n, values.shape[1]), np.float32)
    out[key[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def fit(train: DataFrame, head: int = 255, suffixes: int = 128, common: int = 1 << 17, context: int = 6, dim: int = 16, batch: int = 1024, noise: int = 32, rate: float = 0.05, seed: int = 1) -> tuple[Vocabulary, LogBilinear, DataFrame]:
    """Learn from all texts of ``train`` (a column text without nulls): counts of every token, then the neural model.

    Counts are a distributed aggregate and stay a table; the driver gets the ``common`` most frequent words and the sums of each
    class.  Each task trains on all its texts from one start, and the tasks' parameters are averaged by their tokens, 64 at a
    time; so every training token takes part and what is gathered grows with the input.
    """
    spark = train.sparkSession
    counts = stored(count_tokens(train, suffixes), "counts")
    words = counts.where(F.col("h") != END_SIGNED)
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = counts.where(F.col("h") == END_SIGNED).select("c").first()
    # All words counted at least as often as some step of a fine scale of counts, as many steps as fit into ``common`` words: no sort.
    step = F.floor(8 * F.log2("c"))
    floor, left = math.inf, common
    for r in words.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("s")).collect():
        left -= r.n
        if left < 0:
            break
        floor = r.least
    top = words.where(F.col("c") >= (floor if floor < math.inf else -1)).select("h", "c") if floor < math.inf else words.select("h", "c").limit(0)
    top = top.toArrow().to_pandas().sort_values(["c", "h"], ascending=[False, True], ignore_index=True)
    by_class = words.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("n")).toPandas()
    # Words that are classes of their own don't count in the class of their suffix.
    own = words.join(F.broadcast(spark.createDataFrame(top.head(head), "h long, c long").select("h")), "h").groupBy("cls").agg(F.sum("c").alias("oc"), F.count("*").alias("on")).toPandas()
    by_class = by_class.merge(own, on="cls", how="left").fillna(0)
    by_class["c"] -= by_class.oc
    by_class["n"] -= by_class.on
    vocab = Vocabulary(top, by_class, int(sums.n), int(sums.v), ends.c if ends else 0, head, suffixes)
    model = LogBilinear(vocab, context, dim, seed)
    start = spark.sparkContext.broadcast((vocab, model))

    def run(batches):
        vocab, model = start.value
        part = TaskContext.get().partitionId()

        def chunks():
            for b in slices(batches, 0, 1 << 20):
                t = Tokens(b.column(0), vocab.suffixes)
                cls = vocab.classes(t)
                ctx = model.contexts(cls, t.row)
                order = np.random.default_rng(part).permutation(len(cls))
                yield cls[order], ctx[:, order]

        mine = LogBilinear(vocab, context, dim, seed)
        n = mine.train(chunks(), batch, noise, rate, seed + part)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([float(n)]), pa.array([mine.flat().tolist()], pa.list_(pa.float32()))], ["slot", "n", "p"])

    schema = "slot long, n double, p array<float>"
    models = stored(train.select("text").mapInArrow(run, schema), "models")

    def average(pdf):
        n = pdf.n.to_numpy()
        mean = np.einsum("i,ij->j", n / n.sum(), np.stack(pdf.p.to_numpy()))
        return pd.DataFrame({"slot": [int(pdf.slot.iloc[0]) // 64], "n": [n.sum()], "p": [mean.astype(np.float32)]})

    left = models.count()
    while left > 1:
        models = stored(models.groupBy(F.floor(F.col("slot") / 64)).applyInPandas(average, schema), "models")
        fewer = models.count()
        if fewer == left:  # slots too sparse to meet: bring them together
            models = models.withColumn("slot", F.lit(0).cast("long"))
        left = fewer
    got = models.first()
    if got is not None:
        model.set_flat(np.array(got.p, np.float32))
    return vocab, model, words


def score(docs: DataFrame, vocab: Vocabulary, model: LogBilinear, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_tokens, n_known, base_score, score (log10, whole text, its end included).

    score: each token's log10 p(class | six classes before it) plus log10 p(word | class), a count's share of its suffix class smoothed
    as the base is, so that each class keeps room for one unseen word.  The model and the common counts (bounded) go to all tasks; tokens
    beyond them are joined with the counts by hash, after summing per document.
    Null and empty texts are one end; rows that repeat an id are scored each on its own; untrained (no training texts): every count is 0.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    shared = docs.sparkSession.sparkContext.broadcast((vocab, model))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def whole(batches):
        vocab, model = shared.value
        for b in slices(batches, 2, 2 << 20):
            t = Tokens(b.column(2), vocab.suffixes)
            cls, c = vocab.classes(t), vocab.counts(t)
            n = len(t.per_row)
            seen = np.log10(np.maximum(c, 0) + 0.5)
            lp = model.log10_probs(cls, model.contexts(cls, t.row))
            lp += np.where(cls > vocab.head, seen - vocab.log_share[cls], 0.0)
            at = np.flatnonzero(c < 0)
            order = at[np.lexsort((t.h[at], t.row[at]))]
            row, h = t.row[order], t.h[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(row) else order
            tf = np.diff(np.append(first, len(row))).astype(np.int32)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=n))]).astype(np.int32))
            by_row = lambda v: np.bincount(t.row, v, n)
            cols = [b.column(0), b.column(1), pa.array(t.per_row.astype(np.int64)), pa.array(by_row((c > 0).astype(float)).astype(np.int64)), pa.array(by_row(seen - vocab.base)), pa.array(by_row(lp))]
            cols += [pa.ListArray.from_arrays(ends, pa.array(_signed(h[first]))), pa.ListArray.from_arrays(ends, pa.array(tf))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "n_tokens", "known", "base", "lp", "rare", "tf"])

    scored = rows.select("doc_id", "key", "text").mapInArrow(whole, f"doc_id {kind}, key long, n_tokens long, known long, base double, lp double, rare array<long>, tf array<int>")
    scored = stored(scored, "scored")
    tail = scored.select("key", F.explode(F.arrays_zip("rare", "tf")).alias("r")).select("key", F.col("r.rare").alias("h"), F.col("r.tf").alias("tf"))
    scored = scored.drop("rare", "tf")
    met = tail.join(words.select("h", "c").hint("merge"), "h")
    gain = met.groupBy("key").agg(F.sum(F.col("tf") * (F.log10(F.col("c") + 0.5) - math.log10(0.5))).alias("gain"), F.sum("tf").alias("rare_known"))
    both = scored.join(gain.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left").drop("_key")
    both = both.withColumn("copies", F.count("*").over(W.partitionBy("key")))  # equal rows were summed together
    extra, more = F.coalesce(F.col("gain") / F.col("copies"), F.lit(0.0)), F.coalesce(F.col("rare_known") / F.col("copies"), F.lit(0))
    return both.select("doc_id", "n_tokens", (F.col("known") + more.cast("long")).alias("n_known"), (F.col("base") + extra).alias("base_score"), (F.col("lp") + extra).alias("score"))

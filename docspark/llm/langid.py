"""Language identification: a document is a mixture of languages whose proportions expectation-maximisation estimates from n-gram likelihoods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices
from .tokens import Words, mix

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_EDGE = np.uint64(0x100)
#: How sharply a word tells languages apart: the log-likelihood ratios of its n-grams are averaged (they overlap) and multiplied by this.
_SHARPNESS = 3.0


class _Features:
    """The words (letters and non-ASCII bytes) of a column, and for each distinct one the buckets of its n-grams.

    n-grams are 2, 3 and 4 bytes of a word with its edges marked, and the whole word; ``number`` is each word's distinct word, ``of`` the one a bucket belongs to.
    """

    def __init__(self, texts: pa.Array, log2_buckets: int):
        self.words = words = Words(texts, _LETTER)
        hashes, first, self.number = np.unique(words.hashes(), return_index=True, return_inverse=True)
        start, size = words.start[first], words.end[first] - words.start[first]
        self.bucket = self.of = np.zeros(0, np.int64)
        self.n_words = len(size)
        if not len(size):
            return
        word = np.repeat(np.arange(len(size)), size + 2)
        to = np.cumsum(size + 2)
        code = np.full(int(to[-1]), _EDGE, np.uint64)
        inside = np.ones(len(code), bool)
        inside[to - 1] = inside[to - size - 2] = False
        code[inside] = words.bytes[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        buckets, of = [mix(hashes, 11)], [np.arange(len(size))]
        gram = code
        for k in range(1, 4):
            gram = (gram[:-1] << np.uint64(9)) | code[k:]
            same = np.flatnonzero(word[:-k] == word[k:])
            buckets.append(mix(gram[same], 11 + k))
            of.append(word[same])
        self.bucket, self.of = (np.concatenate(buckets) >> np.uint64(64 - log2_buckets)).astype(np.int64), np.concatenate(of)

    def counts(self, n_buckets: int) -> np.ndarray:
        """How often each bucket occurs in the column."""
        return np.bincount(self.bucket, np.bincount(self.number, minlength=self.n_words)[self.of], n_buckets).astype(np.int64)


class Model:
    """Log-likelihood ratio of each n-gram bucket in each language against all of them; zero where training text never had the bucket."""

    def __init__(self, langs: list[str], counts: np.ndarray, log2_buckets: int, most_mixed: int, strength: float = 200.0):
        self.langs, self.log2_buckets, self.most_mixed = langs, log2_buckets, most_mixed
        total = counts.sum(axis=0)
        share = (total + 0.5) / (total.sum() + 0.5 * len(total))
        n = counts.sum(axis=1, keepdims=True)
        ratio = np.log((counts + strength * share) / (n + strength) / share) if len(langs) else counts
        self.ratio = np.where(total > 0, ratio, 0).T.astype(np.float32)
        self.prior = (n[:, 0] + 1) / (n.sum() + max(1, len(langs)))

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each text's leading language and a score (0 to 1)."""
        f = _Features(texts, self.log2_buckets)
        width = np.maximum(np.bincount(f.of, minlength=f.n_words), 1)
        llh = np.empty((f.n_words, len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            llh[:, k] = np.bincount(f.of, self.ratio[f.bucket, k], f.n_words) / width * _SHARPNESS
        pairs, n = np.unique(f.words.row * max(1, f.n_words) + f.number, return_counts=True)
        row, number = np.divmod(pairs, max(1, f.n_words))
        return mixture(llh[number], row, len(texts), self.prior, self.most_mixed, weight=n)


def _summed(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(row, values[:, k], n) for k in range(values.shape[1])], axis=1)


def _em(like: np.ndarray, row: np.ndarray, weight: np.ndarray, n: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after so many rounds from ``pi`` (zeros stay) and the log-likelihood of each document under them."""
    for _ in range(rounds):
        joint = like * pi[row]
        joint *= (weight / np.einsum("ij->i", joint))[:, None]
        pi = (_summed(joint, row, len(n)) + 1e-6 * (pi > 0)) / np.maximum(n, 1)[:, None]
        pi /= np.maximum(pi.sum(axis=1, keepdims=True), 1e-300)
    return pi, np.bincount(row, weight * np.log(np.einsum("ij,ij->i", like, pi[row])), len(n))


def mixture(llh: np.ndarray, row: np.ndarray, n_docs: int, prior: np.ndarray, most_mixed: int = 8, penalty: float = 1.5, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The leading language of each document and its score, from the log-likelihoods of its words in each language; ``weight`` says how often a row's document has the word.

    Expectation-maximisation finds the proportions of all languages (of the ``most_mixed`` that explain most words in a first round, where there are more);
    then the weakest language goes as long as the likelihood falls by less than the penalty of one language more, ``penalty`` * log(1 + words).  The score is the leading language's proportion,
    times the probability that it and not the runner-up is the one language, if one is left.
    """
    weight = np.ones(len(row)) if weight is None else weight.astype(np.float64)
    n = np.bincount(row, weight, n_docs)
    like = np.exp(llh - llh.max(axis=1, keepdims=True, initial=-np.inf)).astype(np.float64) if len(llh) else np.zeros((0, llh.shape[1]))
    like = np.maximum(like, 1e-30)
    pi, _ = _em(like, row, weight, n, np.tile(prior, (n_docs, 1)), 1)
    which = np.argsort(-pi, axis=1, kind="stable")[:, :most_mixed]
    like = np.take_along_axis(like, which[row], axis=1)
    pi, fit = _em(like, row, weight, n, np.take_along_axis(pi, which, axis=1), 10)
    cost = penalty * np.log1p(n)
    open_ = np.ones(n_docs, bool)
    for _ in range(which.shape[1] - 1):
        docs = np.flatnonzero(open_ & ((pi > 0).sum(axis=1) > 1))
        if not len(docs):
            break
        place = np.full(n_docs, -1)
        place[docs] = np.arange(len(docs))
        mine = place[row] >= 0
        fewer = pi[docs].copy()
        fewer[np.arange(len(docs)), np.where(fewer > 0, fewer, np.inf).argmin(axis=1)] = 0
        fewer, less = _em(like[mine], place[row][mine], weight[mine], n[docs], fewer / np.maximum(fewer.sum(axis=1, keepdims=True), 1e-300), 6)
        better = less + cost[docs] >= fit[docs]
        pi[docs[better]], fit[docs[better]] = fewer[better], less[better]
        open_[docs[~better]] = False
    top = pi.argmax(axis=1)
    single = _summed(np.log(like) * weight[:, None], row, n_docs) + 1e-9 * np.log(np.take_along_axis(np.tile(prior, (n_docs, 1)), which, axis=1))
    own = np.take_along_axis(single, top[:, None], axis=1)[:, 0]
    rest = single.copy()
    rest[np.arange(n_docs), top] = -np.inf
    margin = own - (rest.max(axis=1) if rest.shape[1] > 1 else 0)
    alone = (pi > 0).sum(axis=1) == 1
    sure = np.where(alone, 1 / (1 + np.exp(-np.clip(margin, -50, 50))), 1.0)
    return np.take_along_axis(which, top[:, None], axis=1)[:, 0], np.clip(np.take_along_axis(pi, top[:, None], axis=1)[:, 0] * sure, 0.0, 1.0)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", log2_buckets: int = 16, max_languages: int = 256, most_mixed: int = 8) -> Model:
    """Learn from documents with a language: n-gram counts of all of them, summed in tasks and then by Spark.

    The model has 2^``log2_buckets`` numbers a language and goes to all tasks, so languages are bounded by the documented parameter ``max_languages`` (16 MB
    per 64 languages): those of most documents, ties by name.  Documents without text or language teach nothing.
    """
    docs = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    langs = [r.lang for r in docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).select("lang").collect()]
    number = {lang: k for k, lang in enumerate(langs)}
    n_buckets = 1 << log2_buckets

    def run(batches):
        counts: dict[int, np.ndarray] = {}
        for b in slices(batches, 1, 1 << 20):
            for lang in b.column(0).unique().to_pylist():
                if lang in number:
                    counts.setdefault(number[lang], np.zeros(n_buckets, np.int64))
                    counts[number[lang]] += _Features(b.column(1).filter(pa.compute.equal(b.column(0), lang)), log2_buckets).counts(n_buckets)
        for k, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    got = docs.mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), n_buckets))
    counts[got["lang"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    return Model(langs, counts, log2_buckets, most_mixed)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score to ``docs`` (columns of these names are replaced).

    ``und`` with score 0 for null texts, texts without a letter and models that learned no language; a text whose letters the model never saw gets the
    prior's language.  Texts are read whole, in slices of about 1 MB (a longer one alone); every row is its own, so order and repeats don't matter.
    """
    docs = docs.drop("lang_pred", "score")
    letters = fresh(docs, "_letters")
    rows = docs.withColumn(letters, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        at = names.index(text_col)
        for b in slices(batches, at, 1 << 20):
            known = b.column(len(names)).to_numpy(zero_copy_only=False) & bool(m.langs)
            which, score = m.predict(b.column(at)) if m.langs else (np.zeros(b.num_rows, int), np.zeros(b.num_rows))
            lang = [m.langs[k] if ok else "und" for k, ok in zip(which, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0))], [*names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    return rows.mapInArrow(run, StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()))

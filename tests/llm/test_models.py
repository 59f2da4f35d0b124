"""Toxicity, language model, Jaccard join and the pipeline: held-out accuracy and brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from docspark.llm import jaccard_join, lm, toxicity
from docspark.llm.queries import op4_toxicity, op5_lm_score, op8_jaccard_join

BLANK = r"[^\x20\x09-\x0D]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sets(docs):
    out = []
    for i, t in docs:
        w = re.findall(BLANK, lower(t))
        out.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def brute_components(docs):
    s = sets(docs)
    root = {i: i for i, _ in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(s):
        for j, b in s[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(a), find(i)) for i, a in s}


def check_join(spark, docs):
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in docs], "doc_id long, text string, n long, rep string")
    got = jaccard_join.jaccard_components(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_components([d for d in docs if d[0] is not None])
    assert len(got) == len(docs)
    return df, got


def test_jaccard_near_copies(spark):
    """Many near copies of one text, whose similarities lie on both sides of the threshold, and chains of them."""
    r = random.Random(4)
    vocab = [f"w{k}" for k in range(500)]
    base = [r.choice(vocab) for _ in range(90)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = r.choice(vocab)
        docs.append((i * 3 + 1, " ".join(w)))
    passage = " ".join(r.choice(vocab) for _ in range(60))
    docs += [(1000 + i, passage + " " + " ".join(r.choice(vocab) for _ in range(r.randrange(0, 60)))) for i in range(60)]
    chain = [r.choice(vocab) for _ in range(60)]
    for i in range(25):
        chain[(i * 4) % 60] = r.choice(vocab)
        docs.append((2000 + i, " ".join(chain)))
    r.shuffle(docs)
    check_join(spark, docs)


def test_jaccard_small_sets_and_edges(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice("ABcd") for _ in range(r.randrange(0, 16)))) for i in range(220)]
    docs += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "one two"), (None, "one two"), (None, None)]
    df, _ = check_join(spark, docs)
    found = jaccard_join.jaccard_components(df)
    kept = jaccard_join.keep_one(df, found)
    assert kept.columns == df.columns
    assert {x.doc_id for x in kept.collect() if x.doc_id is not None} == {c for _, c in brute_components([d for d in docs if d[0] is not None]).values()}
    assert kept.where("doc_id is null").count() == 2
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_light_boundary_is_by_cost():
    rule = jaccard_join.Rule(3, 4)
    assert jaccard_join.light_boundary({}, rule) == 0 and jaccard_join.light_boundary({2: 100, 200: 10}, rule) == 2
    assert [rule.overlap(a, a) for a in (1, 4, 8)] == [1, 4, 7] and rule.subsets(8, 8) >= 8


def test_jaccard_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op8_jaccard_join(spark, sf).collect()} == brute_components(docs)


def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in op4_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(got[r.doc_id].score, r.toxic) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in labels)
    good, bad = [s for s, t in held if not t], [s for s, t in held if t]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    assert auc > 0.8 and np.mean([s < 0.5 for s in good]) > 0.9


def test_toxicity_scores_mean_the_same_when_the_sample_is_cut(spark):
    """A word of 3 in 5 toxic and 1 in 10 clean texts, 1 in 10 toxic: texts with it are toxic with p = 0.4, however many clean rows the bound leaves out."""
    r = random.Random(6)
    rows = []
    for i in range(6000):
        bad = i % 10 == 0
        rows.append((i, " ".join(["grr"] * (r.random() < (0.6 if bad else 0.1)) + r.choices(["some", "plain", "words", "of", "text"], k=8)), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for most in (20_000, 1000):
        model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), max_rows=most)
        got = {x.doc_id: x.score for x in toxicity.score(df, model).collect()}
        with_it = [got[i] for i, t, _ in rows if "grr" in t]
        assert abs(np.mean(list(got.values())) - 0.1) < 0.04 and abs(model.prior - 0.1) < 0.01
        assert 0.25 < np.mean(with_it) < 0.55, most
    p = toxicity.Isotonic().fit(np.array([0.0, 1.0]), np.array([1.0, 0]), np.array([1.0, 9.0])).of(np.array([0.5]))
    assert abs(p[0] - 0.1) < 0.02


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "you IDIOT !!", "x"), (3, "fine", "x"), (None, "fine", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.drop_toxic(docs, model, threshold=2.0).collect() == docs.collect()
    assert toxicity.score(docs.limit(0), model).count() == 0
    one = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, one).collect()} == {0.0}
    assert toxicity.fit(docs, labels.limit(0)).prior == 0.5


def test_trees_and_isotonic():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    t = toxicity.Trees().fit(x[:1500], y[:1500])
    assert ((t.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    m = np.array([0, 1, 2, 3.0])
    p = toxicity.Isotonic().fit(m, np.array([0, 1, 0, 1.0])).of(m)
    assert (np.diff(p) >= 0).all() and p[0] < 0.05 and p[3] > 0.95 and abs((p[1] + p[2]) / 2 - 0.5) < 0.01  # a pool of 1 and 2, linear to its neighbours


def tokens(t):
    return [*re.findall(BLANK, lower(t)), "\0end"]


def test_lm_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op5_lm_score(spark, sf).collect()}
    counts = Counter(w for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    model, base = 0.0, 0.0
    for i, t in docs:
        r, w = got[i], tokens(t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        want = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert abs(r.base_score - want) < 1e-6 * abs(want)
        if r.held_out:
            model, base = model + r.score, base + r.base_score
    assert model > base


def test_lm_rare_words_edges_and_normalisation(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (1, "a b a c"), (2, None), (3, ""), (None, "a zzz"), (4, "b" * 70_000)], "doc_id long, text string")
    train = spark.createDataFrame([("a b c a b",), ("a rare word",)], "text string")
    vocab, model, words = lm.fit(train, head=2, suffixes=3, common=2, context=2, dim=4, batch=4, noise=3)
    got = lm.score(docs, vocab, model, words).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == 6 and by[1][0] == by[1][1] and (by[1][0].n_tokens, by[1][0].n_known) == (5, 5)
    assert by[2][0].n_tokens == by[3][0].n_tokens == 1 and by[None][0].n_known == 2
    counts = Counter("a b c a b a rare word".split()) + Counter({"\0": 2})
    want = sum(math.log10((counts[x] + 0.5) / (10 + 0.5 * 7)) for x in ["a", "b", "a", "c", "\0"])
    assert abs(by[1][0].base_score - want) < 1e-9
    cls = np.arange(vocab.size).astype(np.int16)
    p = 10 ** model.log10_probs(cls, np.full((2, vocab.size), model.n, np.int16))
    assert abs(p.sum() - 1) < 1e-4
    vocab, model, words = lm.fit(train.limit(0))
    assert lm.score(docs, vocab, model, words).count() == 6 and lm.score(docs.limit(0), vocab, model, words).count() == 0

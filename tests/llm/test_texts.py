"""Line dedup, exact dedup, decontamination and mixing against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import heapq
import random
import re
from collections import Counter, defaultdict

import pytest

from docspark.llm import decontaminate, exact_dedup, line_dedup, mixing
from docspark.llm.queries import op1_line_dedup, op3_mix_sources, op7_decontaminate

SCHEMA = "doc_id long, text string, lang string, source string, keep string, n int"
L, M = "a line of more than twenty", "Another line of more than twenty é"


def frame(spark, texts, source=lambda i: "s"):
    return spark.createDataFrame([(i, t, "en", source(i), "x", 1) for i, t in texts], SCHEMA)


def test_line_dedup(spark):
    docs = [(1, f"{L}\nshort\n  {L.upper()} \nown line that nobody else has"), (2, f"{L}\r\n{M}"), (3, M), (4, f"{M}\n\n{L}"), (5, None), (6, ""), (None, f"{L}\n{M}"), (7, "short\nshort"), (2, f"{L}\r\n{M}")]
    got = line_dedup.apply_bitmaps(frame(spark, docs), line_dedup.line_keep_bitmaps(frame(spark, docs)), counts=True).collect()
    out = defaultdict(list)
    for r in got:
        out[r.doc_id].append((r.text, r.n_lines, r.n_dropped))
    assert out[1] == [("short\nown line that nobody else has", 4, 2)]
    assert out[2] == [("", 2, 2)] * 2
    assert out[3] == [("", 1, 1)] and out[4] == [(f"{M}\n\n{L}", 3, 0)]
    assert out[5] == [(None, 1, 0)] and out[6] == [("", 1, 0)] and out[None] == [(f"{L}\n{M}", 2, 0)]
    assert line_dedup.dedup_lines(frame(spark, docs)).columns == ["doc_id", "text", "lang", "source", "keep", "n"]
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_hot_line_over_many_partitions(spark):
    r = random.Random(1)
    pool = [f"shared line number {k} of the pool" for k in range(30)]
    docs = [(i, "\n".join([L] * (i % 3) + r.sample(pool, r.randrange(5)) + [f"line only of document {i} here"])) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    holders = defaultdict(set)
    for i, t in docs:
        for x in t.split("\n"):
            holders[x.strip().lower()].add(i)
    for i, t in docs:
        keep = [x for x in t.split("\n") if not (len(x.strip()) >= 20 and len(holders[x.strip().lower()]) >= 3 and i != max(holders[x.strip().lower()]))]
        assert got[i] == "\n".join(keep), i


def test_exact_dedup(spark):
    docs = [(5, "a b"), (3, "ab"), (4, "a  b"), (9, "a\tb"), (1, None), (2, " \n"), (7, "other"), (None, "ab"), (8, "x" * 5000), (6, "x" * 2500 + "\r" + "x" * 2500), (7, "other")]
    got = exact_dedup.exact_dedup(frame(spark, docs), digest=True).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(docs)
    assert {i: by[i].keep_id for i in (3, 4, 5, 9, None)} == dict.fromkeys((3, 4, 5, 9, None), 4) and by[3].group_size == 5
    assert by[1].keep_id == by[2].keep_id == 2 and not by[1].kept and by[2].kept
    assert by[8].keep_id == 6 and by[7].group_size == 2 and by[7].kept
    assert by[7].text_sha256 == hashlib.sha256(b"other").hexdigest() and by[1].text_sha256 == hashlib.sha256(b"").hexdigest()
    small = exact_dedup.exact_dedup(frame(spark, docs), broadcast_rows=0).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in small} == {(r.doc_id, r.keep_id, r.group_size) for r in got}
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(docs, items, size=10):
    found = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            found[tuple(w[k : k + size])].add(str(i))
    lengths = {len(k) for k in found}
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in found:
                    hit |= set(range(k, k + n))
                    names |= found[x]
        yield i, (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())


@pytest.mark.parametrize("limit", [200_000, 3])
def test_decontamination(spark, limit):
    r = random.Random(2)
    text = lambda n: " ".join(r.choice(["der", "Tür", "x9", "of", "the", "end", "was", "it"]) for _ in range(n))
    items = [(10, text(25)), (2, text(10)), (3, "Two words"), (4, None), (5, "!!"), (6, text(12)), (6, text(15))]
    docs = [(1, text(30) + ". " + items[0][1].upper() + " " + text(5)), (2, items[1][1]), (3, "say two-words, again"), (4, None), (5, ""), (6, "--- ..."), (7, text(400)), (8, text(9) + items[5][1] + items[6][1]), (9, "clean")]
    item_frame = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(decontaminate.benchmark_hits(frame(spark, docs), item_frame, broadcast_windows=limit)).collect()
    assert {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256) for x in got} == dict(brute_hits(docs, items))
    cut = {x.doc_id: x.text for x in decontaminate.decontaminate(frame(spark, docs), item_frame).collect()}
    assert 2 not in cut and cut[9] == "clean" and cut[4] is None and cut[3] == "say again"
    assert not any(h for _, (_, h, _, _) in brute_hits([(1, cut[1])], items))
    assert decontaminate.benchmark_hits(frame(spark, docs), item_frame.limit(0)).where("hits is not null").count() == 0
    assert decontaminate.decontaminate(frame(spark, docs), item_frame).columns == frame(spark, docs).columns


@pytest.mark.parametrize("limit", [200_000, 3])
def test_decontamination_of_null_and_repeated_ids(spark, limit):
    """Every row is cut by its own hits, whatever its id, on both sides of broadcast_windows."""
    one, two = " ".join(f"p{k}" for k in range(12)), " ".join(f"q{k}" for k in range(12))
    pad = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    a, b, c = pad("a", 20), pad("b", 20), pad("c", 33)
    docs = [(None, f"{a} {one}"), (None, f"{one} {b}"), (None, a), (1, f"{a} {one}"), (1, f"{two} {b}"), (1, c), (1, pad("d", 32)), (2, f"{c} {two}"), (2, f"{a} {two}"), (2, f"{a} {two}"), (3, None), (None, None)]
    items = spark.createDataFrame([(1, one), (2, two)], "item_id long, text string")
    key = lambda x: str(x)
    want = [(None, f"{a} "), (None, b), (None, a), (1, f"{a} "), (1, b), (1, c), (1, pad("d", 32)), (2, f"{c} "), (2, f"{a} "), (2, f"{a} "), (3, None), (None, None)]
    got = [(x.doc_id, x.text) for x in decontaminate.decontaminate(frame(spark, docs), items, broadcast_windows=limit).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    hits = decontaminate.contamination(decontaminate.benchmark_hits(frame(spark, docs), items, broadcast_windows=limit)).collect()
    assert sorted(((x.doc_id, (x.n_words, x.n_hit, x.n_items, x.items_sha256)) for x in hits), key=key) == sorted(brute_hits(docs, items.collect()), key=key)


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def test_mixing(spark):
    r = random.Random(3)
    docs = [(i, " ".join(["w"] * r.randrange(0, 120))) for i in range(400)] + [(1000, "w " * 30_000), (1001, None), (None, "null id"), (7, "twice"), (7, "twice")]
    source = lambda i: None if i is None or i % 17 == 0 else ["big", "Big", "é", "small"][0 if i % 3 else i % 4]
    df = frame(spark, docs, source)
    got = mixing.mix_sources(df, shard_words=5000).collect()
    assert len(got) == len(docs)
    sizes, taken = Counter(), Counter()
    for x in got:
        sizes[x.source] += x.size
        taken[x.source] += x.taken
        assert 0 <= x.taken <= 2 * x.size
    want = brute_targets(sizes)
    for x in got:
        assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.1 * want[s] + 128, s
    again = mixing.mix_sources(df.repartition(3), shard_words=5000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert mixing.mix_sources(frame(spark, [(1, None), (2, " ")])).collect()[0].taken == 0


def test_mixed_documents_meet_targets(spark):
    """What is read of each source sums to its target, also where a document is a few blocks or far more; null and repeated ids keep their own."""
    r = random.Random(5)
    docs = [(i, " ".join(["w"] * r.choice([40, 700, 3000]))) for i in range(120)] + [(200, "w " * 20_000), (None, "x " * 700), (None, "y " * 650), (7, "z " * 900), (7, "one two"), (7, "two one"), (300, None)]
    source = lambda i: "b" if i is None else "abc"[i % 3]
    df = frame(spark, docs, source)
    took, out = mixing.mix_sources(df).collect(), mixing.mixed_documents(df).collect()
    want = brute_targets(Counter({s: sum(x.size for x in took if x.source == s) for s in "abc"}))
    got = Counter()
    for x in out:
        size = len(x.text.split())
        read = [0] * size
        for first, end, times in x.spans:
            assert 0 <= first < end <= size
            for k in range(first, end):
                assert not read[k]
                read[k] = times
        assert sum(read) == x.taken <= 2 * size and max(read) == x.n_times
        got[x.source] += x.taken
    for s in want:
        assert abs(got[s] - want[s]) <= 0.02 * want[s] + 128, s
    assert sum(got.values()) == sum(x.taken for x in took)
    single = {i for i, n in Counter(i for i, _ in docs).items() if n == 1 and i is not None}
    assert {x.doc_id: x.taken for x in out if x.doc_id in single} == {x.doc_id: x.taken for x in took if x.doc_id in single and x.taken}
    kept = Counter((x.doc_id, x.text) for x in out)
    assert all(n == 1 for n in kept.values()) and {t for i, t in kept if i is None} <= {"x " * 700, "y " * 650} and any(i is None for i, _ in kept)


def brute_seats(votes: dict, seats: int) -> dict:
    """Highest quotients, seat by seat; equal ones by name."""
    won = dict.fromkeys(votes, 0)
    heap = [(-v, k) for k, v in votes.items() if v > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, k = heapq.heappop(heap)
        won[k] += 1
        heapq.heappush(heap, (-votes[k] / (2 * won[k] + 1), k))
    return won


def test_sainte_lague(spark):
    r = random.Random(11)
    groups = {
        "plain": ({"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0}, 7),
        "one large, many small": ({"big": 1000.0} | {f"s{k:02}": 0.51 for k in range(20)}, 1010),
        "a thousand small": ({"big": 1000.0} | {f"s{k:04}": 0.9 for k in range(1000)}, 1500),
        "few seats": ({f"s{k:03}": r.random() for k in range(300)}, 5),
        "ties": ({f"s{k:03}": 1.0 for k in range(100)}, 130),
        "wide": ({f"s{k:03}": 10 ** (8 * r.random()) for k in range(200)}, 100_000),
        "no seats": ({"a": 1.0}, 0),
        "one": ({"a": 3.0}, 12),
        "no claims": ({"a": 0.0}, 3),
    }
    rows = spark.createDataFrame([(g, k, v, n) for g, (votes, n) in groups.items() for k, v in votes.items()], "g string, name string, v double, seats long")
    for at_once in (1 << 17, 10):
        got = defaultdict(dict)
        for x in mixing.sainte_lague(rows, ["g"], "v", "seats", ["name"], rank_at_once=at_once).collect():
            got[x.g][x.name] = x.quota
        for g, (votes, n) in groups.items():
            assert got[g] == brute_seats(votes, n), (g, at_once)


def test_mixing_many_small_sources(spark):
    """A source's blocks follow its target however many small sources stand beside a large one."""
    docs = [(k, "w " * 400) for k in range(300)] + [(1000 + k, "w " * 90) for k in range(60)]
    df = frame(spark, docs, lambda i: "large" if i < 1000 else f"s{i}")
    got = mixing.mix_sources(df, block=8).collect()
    taken = Counter()
    for x in got:
        taken[x.source] += x.taken
    want = brute_targets(Counter({"large": 120_000} | {f"s{1000 + k}": 90 for k in range(60)}))
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 3 * 8, (s, taken[s], want[s])  # the last block of a shard is short


def test_registered_queries(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in op7_decontaminate(spark, sf).collect()}
    assert got == dict(brute_hits(docs, items))
    assert op1_line_dedup(spark, sf).count() == op3_mix_sources(spark, sf).count() == len(docs)


def test_parities_never_exceed_the_difference():
    """Bits apart are at most the elements apart, at every pair of sizes, empty sets included; and sets without much in common are told apart."""
    import numpy as np

    from docspark.llm.jaccard_join import _apart, _parities

    rng = np.random.default_rng(5)
    for n, extra, lost in [(0, 1, 0), (1, 0, 0), (1, 70, 1), (63, 9, 4), (64, 1, 0), (1000, 300, 40), (1030, 0, 500), (5000, 2, 2)]:
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[lost:], rng.integers(0, 2**63, extra, dtype=np.uint64)]))
        assert _apart(_parities(x), _parities(y)) == _apart(_parities(y), _parities(x)) <= len(np.setxor1d(x, y))
        assert _apart(_parities(x), _parities(x)) == 0
    x, y = (np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64)) for _ in range(2))
    assert 7 * _apart(_parities(x), _parities(y)) > len(x) + len(y)

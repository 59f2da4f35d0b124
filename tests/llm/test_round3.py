"""Phrase mining, conversation repair and language identification against brute force, and on nulls, ties, repeats, clashing names and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docspark.llm import langid, phrases, queries, repair, toxicity

DOCS = "doc_id long, text string, lang string"


def brute_collocations(docs, most=3, least=10, percent=50, limit=2000):
    n, f = Counter(), {}
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in cand.items():
            score, k = min((1000000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            inside = any(len(b) > len(g) and any(b[i : i + len(g)] == g for i in range(len(b) - len(g) + 1)) and 100 * x >= percent * a for b, x in cand.items())
            if not inside:
                rows.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(rows)[:limit])}
    return out


def phrase_docs():
    rng = random.Random(5)
    words = "alpha beta Gamma delta épsilon zeta ZETA a b".split()
    docs = [(i, " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(60)), rng.choice(["en", "de", None, "und"])) for i in range(80)]
    docs += [(900, None, "en"), (901, "", "xx"), (902, "a a a a a a a a a a a a a a", "loop"), (902, "a a a a a a a a a a a a a a", "loop"), (903, "日本 語 " * 12, "ja"), (None, "new york city " * 11 + ". new york ! new york", "en")]
    return docs


def test_collocations_against_brute_force(spark):
    docs = phrase_docs()
    df = spark.createDataFrame(docs, DOCS).withColumn("phrase", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("a", F.lit(2)).repartition(5)
    for kw in ({}, {"limit": 7}, {"least": 3, "percent": 80}):
        got = {tuple(r) for r in phrases.collocations(df, bin_mass=500, **kw).collect()}
        assert got == brute_collocations(docs, **kw)
    assert any(r[0] == "loop" for r in brute_collocations(docs))


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None)], DOCS)).count() == 0


def test_a_long_text_of_one_word(spark):
    df = spark.createDataFrame([(1, "ab " * 400_000, "en")], DOCS)
    got = [tuple(r) for r in phrases.collocations(df).collect()]
    assert got == [("en", 1, "ab ab ab", 399_998, 400_000, 399_999, 400_000, 1000000 * 399_998**2 // (400_000 * 399_999))]


def test_misra_gries_keeps_what_is_frequent():
    rng = np.random.default_rng(3)
    for trial in range(20):
        keys = rng.zipf(1.3, 4000).astype(np.uint64) % np.uint64(3000)
        least = 15
        whole = phrases.MisraGries(len(keys) // least + 1)
        for part in np.array_split(keys, 7):
            summary = phrases.MisraGries(len(keys) // least + 1)
            for piece in np.array_split(part, 3):
                summary.add(*phrases._summed(piece, np.ones(len(piece))))
            whole.add(summary.keys, summary.counts)
            assert len(whole.keys) <= whole.capacity
        true = Counter(keys.tolist())
        kept = dict(zip(whole.keys.tolist(), whole.counts.tolist(), strict=True))
        assert {k for k, n in true.items() if n >= least} <= set(kept)
        assert all(true[k] - least < n <= true[k] for k, n in kept.items())


CONV = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def brute_repair(rows):
    """Per state the least (cost, edits, what is left) as whole strings."""
    convs = {r[0]: [] for r in rows}
    for r in damage(rows):
        convs[r[0]].append(r)
    out = set()
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, n, illegal, before = set(), Counter(), 0, None
        states = {"": (0, "", ())}

        def inserted(states):
            for a, b in (("", "u"), ("s", "u"), ("a", "u"), ("u", "a"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                if a in states:
                    c, e, rest = states[a]
                    states[b] = min(states.get(b, (1e9, "", ())), (c + 3, e + "I", (*rest, ("user:" if b == "u" else "assistant:"))))
            return states

        for _, _, role, text in mine:
            bare = text.strip(BLANKS)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            if before is not None:
                illegal += before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
            new = {}
            extra = 3 if fault == "truncated" else 0
            for s, (c, e, rest) in inserted(dict(states)).items():
                moves = [(s, c + 4, "D", rest)]
                if fault not in ("blank", "duplicate"):
                    i = role[:1]
                    if (i == "s" and s == "") or (i == "u" and s != "u") or (i == "a" and s == "u"):
                        moves.append((i, c + extra, "K", (*rest, f"{role}:{text}")))
                    to = "a" if s == "u" else "u"
                    moves.append((to, c + extra + 3, "R", (*rest, f"{'user' if to == 'u' else 'assistant'}:{text}")))
                for to, cost, letter, left in moves:
                    new[to] = min(new.get(to, (1e9, "", ())), (cost, e + letter, left))
            states = new
        end = inserted(dict(states))
        cost, audit, left = min((end[s] for s in ("", "a") if s in end), key=lambda x: x[:2])
        turns = {r[1] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.add((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


def chats():
    rng = random.Random(11)
    roles, texts = ["user", "assistant", "system", "user", "assistant", None, "", "tool"], ["Hi.", "Yes!", "no", " ", "", None, "Well?\n ", "ça va. 😀", "ok. ok"]
    rows = [(conv, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for conv in range(60) for _ in range(rng.randrange(1, 9))]
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"text {t % 700}.") for t in range(3000)]  # one that fills several parts
    rows += [(1001, t, "system", " ") for t in range(400)] + [(1002, t, rng.choice(roles[:3]), rng.choice(["same.", "cut", f"t{t}."])) for t in range(1500)]
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, None, None, None), (1, 2, "user", "twice."), (1, 2, "user", "twice."), (1, 2, "user", "twice.")]
    return rows


def report(spark, rows, schema=CONV):
    d = repair.damaged(spark.createDataFrame(rows, schema).withColumn("h", F.lit("x")).withColumn("n", F.lit(5)).withColumn("part", F.lit(0)).withColumn("edits", F.lit(None).cast("string")))
    return {tuple(r) for r in repair.repair_report(repair.repaired(d, repair.structure_edits(d))).collect()}


def test_repair_against_brute_force(spark):
    rows = chats()
    want = brute_repair(rows)
    assert report(spark, rows) == want
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert report(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repair_of_nothing(spark):
    assert report(spark, []) == set()
    gone = [(c, t, "user", "x.") for c in range(40) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert report(spark, gone) == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone}


def test_repair_of_a_very_long_text(spark):
    rows = [(7, 1, "user", "word " * 300_000 + "."), (7, 2, "assistant", "Yes.")]
    assert report(spark, rows) == brute_repair(rows)


def cheapest(rows):
    """All strings of edits up to a length, tried out: the least (cost, edits)."""
    best = None
    for length in range(len(rows) * 2 + 3):
        for letters in itertools.product("DIKR", repeat=length):
            state, cost, k = "", 0, 0
            for c in letters:
                if c == "I":
                    state, cost = ("a" if state == "u" else "u"), cost + 3
                    continue
                if k == len(rows):
                    break
                kind, gone, cut = rows[k]
                k += 1
                if c == "D":
                    cost += 4
                    continue
                if gone:
                    break
                cost += 3 * cut
                if c == "R":
                    state, cost = ("a" if state == "u" else "u"), cost + 3
                elif kind == 0 and state == "":
                    state = "s"
                elif kind == 1 and state != "u":
                    state = "u"
                elif kind == 2 and state == "u":
                    state = "a"
                else:
                    break
            else:
                if k == len(rows) and state in ("", "a"):
                    best = min(best or (10**9, ""), (cost, "".join(letters)))
    return best


def test_survivors_find_the_least_of_all_edits():
    rng = random.Random(2)
    for _ in range(60):
        rows = [(rng.randrange(4), rng.random() < 0.25, rng.random() < 0.3) for _ in range(rng.randrange(0, 4))]
        live, out = repair.Survivors(), ""
        for r in rows:
            out += live.push(*r)
        state, path = live.finish(repair.END)
        audit = out + path + repair._TAIL[state]
        assert (live.cost[state] + repair.END[state], audit) == cheapest(rows)


def test_survivors_hold_only_what_is_unresolved():
    live, most = repair.Survivors(), 0
    for k in range(5000):
        live.push(1 + k % 2, k % 11 == 0, k % 7 == 0)
        nodes, todo = 0, [live.root]
        while todo:
            nodes += 1
            todo += todo.pop().kids
        most = max(most, nodes)
    assert most < 200


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op13_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count() > 0
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_of_odd_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (4, "日本語"), (4, "日本語"), (5, "the " * 500_000)], "doc_id long, text string").withColumn("lang_pred", F.lit("x")).withColumn("_letters", F.lit(7))
    out = langid.identify(odd, model)
    assert out.columns == ["doc_id", "text", "_letters", "lang_pred", "score"]
    got = {(r.doc_id, r.lang_pred) for r in out.collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and all(p != "und" for k, p in got if k > 3)
    none = langid.fit(docs.where("false"))
    assert {(r.lang_pred, r.score) for r in langid.identify(odd, none).collect()} == {("und", 0.0)}
    assert langid.identify(docs.where("false"), model).count() == 0


def test_two_languages_in_one_text():
    """Words of two languages, and a few that both have: both stay, in their shares; a single stray word doesn't make a second language."""
    rng = np.random.default_rng(1)
    def words(n, k):
        llh = np.zeros((n, 3))
        llh[:, k] = rng.uniform(2, 6, n)
        return llh
    llh = np.concatenate([words(70, 0), words(30, 2), words(100, 1), words(1, 2)])
    row = np.concatenate([np.zeros(100, int), np.ones(101, int)])
    lang, score = langid.mixture(llh, row, 3, np.full(3, 1 / 3))
    assert lang.tolist()[:2] == [0, 1]
    assert 0.6 < score[0] < 0.8 and score[1] > 0.95


@pytest.mark.parametrize("name", ["op11_collocations", "op12_repair_conversations", "op13_language_id"])
def test_queries_are_registered(name):
    assert name in queries.QUERIES


def test_held_out_documents_teach_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = toxicity.held_out(F.col("doc_id"), 0)
    a = langid.fit(docs.where(~held))
    b = langid.fit(docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).where(~held))
    assert a.langs == b.langs and np.array_equal(a.ratio, b.ratio)


def test_grams_stay_in_their_piece():
    g = phrases._Grams(pa.array(["One two, three", None, "four"]), 3)
    assert sorted(g.text(np.arange(len(g.hash))).to_pylist()) == ["four", "one", "one two", "three", "two"]


def test_mix_query_against_brute_force(spark, sf):
    """Seats one by one, blocks in the order of the same seeded hashes: every document's words, whole query."""
    from tests.llm.test_texts import brute_seats, brute_targets

    block, seed = 64, 7
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text", F.xxhash64(F.lit(seed + 1), "doc_id").alias("place")).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    assert len(size) == len(rows)
    total = Counter()
    for r in rows:
        total[r.source] += size[r.doc_id]
    target = brute_targets(total)
    names = sorted(target, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    seats = brute_seats({k: target[s] for k, s in enumerate(names)}, int(sum(target.values()) / block + 0.5))
    want = dict.fromkeys(size, 0)
    for k, s in enumerate(names):
        n = -(-total[s] // block)
        quota = min(seats[k], 2 * n)
        keys = spark.range(n).select(F.col("id"), F.xxhash64(F.lit(seed + 2), F.lit(k).cast("int"), F.lit(0).cast("int"), F.col("id")).alias("h")).orderBy("h", "id").collect()
        times = {r.id: quota // n + (i < quota % n) for i, r in enumerate(keys)}
        at = 0
        for r in sorted((r for r in rows if r.source == s), key=lambda r: (r.place, r.doc_id)):
            for b in range(at // block, (at + size[r.doc_id] - 1) // block + 1 if size[r.doc_id] else 0):
                want[r.doc_id] += times[b] * (min(at + size[r.doc_id], (b + 1) * block) - max(at, b * block))
            at += size[r.doc_id]
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in queries.op3_mix_sources(spark, sf).collect()}
    assert {k: v[3] for k, v in got.items()} == want
    assert all(v[0] == size[k] for k, v in got.items())
    for r in rows:
        assert got[r.doc_id][1] == total[r.source] and abs(got[r.doc_id][2] - target[r.source]) < 1e-6


def test_mixed_documents_keep_columns_of_any_name(spark):
    from docspark.llm import mixing

    docs = spark.createDataFrame([(k, "w " * 50, "a") for k in range(40)], "doc_id long, text string, source string")
    extra = docs
    for name in ("_row", "_copy", "_unit", "_size", "_blocks", "_key", "_spans", "size"):
        extra = extra.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    got = mixing.mixed_documents(extra, block=8)
    plain = {(r.doc_id, r.taken, r.n_times) for r in mixing.mixed_documents(docs, block=8).collect()}
    assert {(r.doc_id, r.taken, r.n_times) for r in got.collect()} == plain
    assert all(r["_copy"] == f"_copy{r.doc_id}" and r["_key"] == f"_key{r.doc_id}" for r in got.collect())

"""WARC, PII and chat linking: exact round trips and brute force."""

import base64
import gzip
import hashlib
import json
import math
import random
import re
import time
from collections import defaultdict
from pathlib import Path

import pytest
import regex

from docspark.llm import chat, pii, warc
from docspark.llm.common import new_path
from docspark.llm.queries import op2_warc, op6_link_tool_calls, op10_pii


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_round_trip(spark):
    html = {1: "<p>é</p>", 2: "same", 3: "same", 4: None, 5: "", 6: "x" * 3_000_000, 7: "same", None: "lost", 8: "a\r\n\r\nb"}
    rows = [(i, f"http://h/{i} x\r\n" if i != 3 else None, t, "extra") for i, t in html.items()] + [(9, "u", "same", "extra"), (9, "u", "same", "extra")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    out = [new_path(spark, "test") for _ in range(2)]
    manifests = [warc.write_warc(p, o, shard_bytes=1000, roll_bytes=500) for p, o in zip((pages, pages.repartition(3)), out, strict=True)]
    assert sorted(map(str, manifests[0].collect())) == sorted(map(str, manifests[1].collect()))
    got = warc.read_warc(manifests[0], out[0]).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, t in html.items():
        data = (t or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(data), b32(data))
    assert by[2].refers_to == by[3].refers_to == by[7].refers_to == 9 and by[2].record_type == "revisit" and by[2].payload is None
    assert by[4].refers_to == 5 and by[5].record_type == "response" and bytes(by[8].payload) == b"a\r\n\r\nb"
    assert sorted(r.record_type for r in got if r.page_id == 9) == ["response", "revisit"]
    for x in manifests[0].collect():
        data = Path(out[0].removeprefix("file://"), x.file).read_bytes()
        assert hashlib.sha256(data).hexdigest() == x.sha256 and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    small = warc.archive_round_trip(pages, min_revisit_bytes=5).where("record_type = 'revisit'").count()
    assert small == 0 and warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_bytes_depend_on_rows_alone(spark):
    rows = [(k, f"http://h/{k}", "hot " * 50 if k % 3 else f"page {k}") for k in range(900)] + [(5, "http://b", "hot " * 50), (5, "http://a", "hot " * 50)]
    pages, found = spark.createDataFrame(rows, "page_id long, url string, html string"), []
    for parts in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = new_path(spark, "test")
        manifest = warc.write_warc(pages.repartition(int(parts)), out, broadcast_rows=int(parts) % 2)
        found.append((sorted(map(str, manifest.collect())), sorted(map(str, warc.read_warc(manifest, out, payloads=False).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and len({x.split("shard='")[1][:7] for x in found[0][0]}) > 3
    assert sum("response" in x for x in found[0][1]) == 301


def test_warc_query(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op2_warc(spark, sf).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in got} == {k: (len(v), b32(v)) for k, v in pages.items()}


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in v) % 10 == 0


def brute_base(t):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


CASES = [
    None, "", "no data", "a@b.c", "é𝒳 a@b.c.d- x@y", "a@b.cd%x@y.z", "x@a.b.c@d.e@f.g", "..@a.b", "1.2.3.4.5.6.7.8", "0.0.0.00000255 256.1.1.1", "999999999999999999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111-5", "41111111111111114111111111111111", "+1 (415) 555-2671", "++1 2", "+1 2 3 4 5 6 7 8 9) x", "call +49.30.123456-78.", "9" * 20_000, "a" * 20_000 + "@" + "b." * 3_000,
    "1 " * 20_000, "4111111111111111 x 1.1.1.1 y q@w.e +123456789", "1.1.1.1@a.b", "5500 0000  0000 0004",
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(CASES)] + [(None, "a@b.c", "x", "y"), (3, "a@b.c", "x", "y")], "doc_id long, text string, base string, terms string")
    found = pii.find_private(docs)
    for r in found.select("doc_id", "text", pii.listed(found["base"]).alias("base"), pii.listed(found["spans"]).alias("spans")).collect():
        assert r.base == r.spans == brute_base(r.text), r.text[:50]


def test_a_long_text_of_matches_takes_time_in_proportion(spark):
    text = "x@y.zz 4111111111111111 x " + "7 x " * 40_000 + "end@y.zz " * 8_000
    begin = time.monotonic()
    got = pii.find_private(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert len(got.base) == 8_002 and [s.value for s in got.base[:2]] == ["x@y.zz", "end@y.zz"] and got.base[-1].kind == "card"
    assert pii.sanitised(spark.createDataFrame([got], "doc_id long, text string, base array<struct<kind:string,start:int,end:int,value:string>>, spans array<struct<kind:string,start:int,end:int,value:string>>")).first().text.startswith("<EMAIL> <CARD> x 7")
    assert time.monotonic() - begin < 60


def brute_spans(docs: list[tuple[int, str]]) -> dict[int, str]:
    """All spans of the query, by reading the documents one by one."""
    words = lambda t: [w.lower() for w in regex.findall(r"\p{L}+", re.sub(PLAIN["email"], " 0 ", t))]
    base, near, held = {}, [], defaultdict(set)
    for i, t in docs:
        base[i] = brute_base(t)
        valid = set(base[i].split(",")) - {""}
        for kind, p in PLAIN.items():
            ms = list(re.finditer(p, t))
            ends = [0, *[m.end() for m in ms]]
            gaps = [words(t[a:b]) for a, b in zip(ends, [*[m.start() for m in ms], len(t)], strict=True)]
            for k, m in enumerate(ms):
                if f"{kind}:{m.start()}:{m.end()}" in valid:
                    value = m[0].lower() if kind == "email" else m[0] if kind == "ip" else re.sub("[^0-9]", "", m[0])
                    near.append((i, f"{kind}:{value}", tuple(sum(gaps[: k + 1], [])[-3:]), tuple(sum(gaps[k + 1 :], [])[:3])))
        for w in set(regex.split(r"[^\p{L}]+", t.lower())):
            if len(w) >= 3:
                held[w].add(i)
    entity, together, contexts = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, e, left, right in near:
        entity[e].add(i)
        for w in {*left, *right}:
            if len(w) >= 3:
                together[e, w].add(i)
                contexts[e, w].add((left, right))
    chosen = set()
    for (e, w), ids in together.items():
        share = len(ids) / len(held[w]) if held[w] else 0
        if len(contexts[e, w]) >= 3 and share >= 0.5 and math.log2(share * len(docs) / len(entity[e])) >= 4:
            chosen.add(w)
    out = {}
    for i, t in docs:
        own, spans = sorted(w for w in chosen if i in held[w]), base[i].split(",") if base[i] else []
        taken = [tuple(map(int, s.split(":")[1:])) for s in spans]
        for m in regex.finditer(rf"(?i)(?<!\p{{L}})(?:{'|'.join(own)})(?!\p{{L}})", t) if own else ():
            if not any(a < m.end() and m.start() < b for a, b in taken):
                spans.append(f"term:{m.start()}:{m.end()}")
        out[i] = ",".join(spans)
    return out


def test_pii_query_against_brute_force(spark, sf, tmp_path):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    r = random.Random(2)
    docs += [(100_000 + k, f"{r.choice('abcdef') * 4} {r.choice('ghijk') * 3}, Zorblatt: z.orb@mail.org and {r.choice('lmnop') * 4}") for k in range(8)] + [(200_000, "Zorblatt, ZORBLATTS and zorblatt")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_spans(docs)
    got = {x.doc_id: x for x in op10_pii(spark, str(tmp_path)).collect()}
    assert {k: x.spans for k, x in got.items()} == want and want[200_000] == "term:0:8,term:24:32"
    for i, t in docs:
        assert got[i].base_sha256 == hashlib.sha256(brute_base(t).encode()).hexdigest() and got[i].n_email == brute_base(t).count("email:")


def test_revealing_terms(spark):
    rows = [(i, f"filler number {'abcdefghij'[i % 10]} word. Ask Zorblatt at zor{'' if i % 2 else ''}@mail.org please {'xyzuvw'[i % 6] * 3} and go") for i in range(12)]
    rows += [(100 + i, f"ask anyone at all, please and go {i}") for i in range(300)] + [(2000, "Nobody but ZORBLATT did this"), (2001, "other@mail.org here")]
    found = pii.find_private(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in found.collect()}
    assert ("term", "ZORBLATT") in spans[2000] and ("term", "Zorblatt") in spans[0] and ("email", "zor@mail.org") in spans[0]
    assert spans[2001] == [("email", "other@mail.org")] and all(not spans[100 + i] for i in range(300))
    joined = pii.find_private(spark.createDataFrame(rows, "doc_id long, text string"), literal_terms=0).collect()
    assert {r.doc_id: r.spans for r in joined} == {r.doc_id: r.spans for r in found.collect()}
    clean = {r.doc_id: r.text for r in pii.sanitised(found).collect()}
    assert clean[2000] == "Nobody but  did this" and "<EMAIL>" in clean[0] and "Zorblatt" not in clean[0] and clean[101] == rows[13][1]


@pytest.fixture
def tools(spark):
    return spark.createDataFrame([("add", [("a", "integer", True), ("b", "number", False), ("note", "string", False)])], "name string, params array<struct<name:string,type:string,required:boolean>>")


def test_tool_calls(spark, tools):
    call = lambda *calls: json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments"), c, strict=True)) for c in calls]})
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "user", "hi {"), (1, 1, "assistant", call(("x", "add", '{"b": 2.5, "a": 1}'), ("y", "add", '{"a": "1", "z": 0}'))), (1, 2, "tool", result("x", "3")), (1, 3, "tool", result("q", "?")),
        (1, 4, "assistant", call(("w", "mul", "{}"), ("v", "add", '{"note": "$x"}'), ("u", "add", '{"a": 1, "note": "$t"}'), ("s", "add", "{bad"))), (1, 5, "assistant", call(("t", "add", '{"a": 2}'))),
        (2, 0, "assistant", call(("x", "add", '{"a": 1}'))), (2, 1, "tool", result("x", "1")), (2, 1, "tool", result("x", "0")), (None, None, None, None),
    ]
    got = chat.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools, block=2).collect()
    by = {(r.conv_id, r.kind, r.call_id): r for r in got}
    assert len(got) == 14
    assert by[1, "call", "x"].problems == "" and json.loads(by[1, "call", "x"].json) == {"arguments": {"a": 1, "b": 2.5}, "id": "x", "name": "add", "refs": [], "result": "3", "role": "assistant"}
    assert by[1, "call", "x"].json.startswith('{"arguments":{"a":1,"b":2.5},"id":')
    assert by[1, "call", "y"].problems == "type:a,unexpected:z,no result" and by[1, "result", "q"].problems == "orphan"
    assert by[1, "call", "w"].problems == "unknown tool,no result" and by[1, "call", "v"].problems == "missing:a,no result"
    assert by[1, "call", "u"].problems == "no result" and by[1, "call", "s"].problems.startswith("bad json")
    assert by[2, "call", "x"].problems == "duplicate id" and json.loads(by[2, "call", "x"].json)["result"] == "0"
    order = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.turn, r.kind, r.idx))
    waits = next(k for k, r in enumerate(order) if r.call_id == "u")
    order.append(order.pop(waits))  # u refers to t, the last one
    assert [r.seq for r in order] == list(range(1, 11))
    assert chat.link_tool_calls(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), tools).count() == 0


def test_tool_calls_in_topological_order(spark, tools):
    """Random references, forwards too: whatever isn't in or behind a cycle comes after what it refers to; no other row moves before an earlier one without need."""
    r, rows, refs, answered = random.Random(4), [], {}, {}
    for conv in range(12):
        n, refs[conv], answered[conv] = 8, {}, set()
        turns = r.sample(range(40), 2 * n)
        for k in range(n):
            refs[conv][k] = set(r.sample(range(n + 1), r.choice([0, 0, 1, 2] if conv % 3 else [1, 2])))
            args = json.dumps({"a": 1} | {f"n{j}": f"${j}" for j in refs[conv][k]})
            rows.append((conv, turns[k], "assistant", json.dumps({"tool_calls": [{"id": str(k), "name": "add", "arguments": args}]})))
            if r.random() < 0.7:
                answered[conv].add(k)
                rows.append((conv, turns[n + k], "tool", json.dumps({"tool_call_id": str(k), "content": "x"})))
    twice = tools.unionByName(tools)  # a tool listed twice changes nothing
    got = chat.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), twice, block=7).collect()
    assert len(got) == len(rows)
    for conv in range(12):
        seq = {(x.kind, int(x.call_id)): x.seq for x in got if x.conv_id == conv}
        turn = {(x.kind, int(x.call_id)): (x.turn, x.kind) for x in got if x.conv_id == conv}
        flagged = {int(x.call_id) for x in got if x.conv_id == conv and "cycle" in x.problems.split(",")}
        assert sorted(seq.values()) == list(range(1, len(seq) + 1))
        deps = {("call", k): {("result", j) if j in answered[conv] else ("call", j) for j in refs[conv][k] if j < 8} for k in range(8)} | {("result", k): {("call", k)} for k in answered[conv]}
        free, more = set(), True
        while more:
            more = {x for x in deps if x not in free and deps[x] <= free}
            free |= more
        on_cycle = {k for kind, k in deps if kind == "call" and ("call", k) not in free and _reaches(deps, ("call", k), ("call", k))}
        assert on_cycle <= flagged <= {k for kind, k in deps if kind == "call" and ("call", k) not in free}, conv
        for x in free:
            assert all(seq[y] < seq[x] for y in deps[x]), (conv, x)
        if not any(turn[y] >= turn[x] for x in deps for y in deps[x]):
            assert sorted(seq, key=seq.get) == sorted(turn, key=turn.get)
        missing = {int(x.call_id) for x in got if x.conv_id == conv and "reference:8" in x.problems}
        assert missing == {k for k in refs[conv] if 8 in refs[conv][k]}


def _reaches(deps, a, b) -> bool:
    seen, todo = set(), list(deps[a])
    while todo:
        x = todo.pop()
        if x == b:
            return True
        if x not in seen:
            seen.add(x)
            todo += deps[x]
    return False


def test_tool_call_query(spark, sf):
    assert op6_link_tool_calls(spark, sf).count() == spark.read.parquet(f"{sf}/conversations.parquet").count()


def test_words_near_an_entity_are_whole_and_reach_past_matches(spark):
    from pyspark.sql import functions as F

    far, long = "- " * 90, "x" * 200
    texts = [f"one Alice: a@x.yy, b@x.yy then {long} {far} two three four", f"zero one two {far}{long} c@x.yy", "Alice 10.0.0.1 10.0.0.2 Bob", "d@x.yy"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", *[pii.matches(k, F.col("text")).alias(k) for k in ("email", "ip")]).collect()
    got = {s.value: (s.left, s.right) for r in rows for s in [*r.email, *r.ip]}
    assert got["a@x.yy"] == ("one alice", f"then {long} two") and got["b@x.yy"] == ("one alice", f"then {long} two")
    assert got["c@x.yy"] == (f"one two {long}", "") and got["d@x.yy"] == ("", "")
    assert got["10.0.0.1"] == got["10.0.0.2"] == ("alice", "bob")


def test_rows_without_an_id_have_no_terms_on_either_path(spark):
    docs = [(k, f"{a} {b} Zorblax: z@x.yy") for k, (a, b) in enumerate([("aa", "bb"), ("cc", "dd"), ("ee", "ff"), ("gg", "hh")])]
    docs += [(100 + k, f"plain text {k}") for k in range(200)] + [(None, "Zorblax again")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = [{(r.doc_id, r.text): [s.kind for s in r.spans] for r in pii.find_private(df, literal_terms=n).collect()} for n in (5000, 0)]
    assert out[0] == out[1] and out[0][(None, "Zorblax again")] == [] and "term" in out[0][docs[0]]

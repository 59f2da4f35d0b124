"""Layout, planning, assembly, glossaries and terms against plain Python, and on nulls, ties, repeats and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from docspark.functions import fold, folds
from docspark.operators import assembly, chunks, duplicates, glossary, layout, planning, plans, terms, translation, validation

BOX = "page string, n long, x0 double, y0 double, x1 double, y1 double"


def page_of(spark, rows):
    return spark.createDataFrame(rows, BOX).withColumns({"page_width": F.lit(600.0), "page_height": F.lit(800.0)})


def order_of(boxes, across=True):
    """(n, x0, y0, x1, y1) in reading order, by recursion."""

    def cut(a, b, size):
        best, at = 0.03 * size, None
        by = sorted(boxes, key=lambda r: (r[a], r[0]))
        for p, q in zip(by, by[1:]):
            if q[a] - p[b] > best:
                best, at = q[a] - p[b], (p[b] + q[a]) / 2
        return at

    gaps = {True: cut(1, 3, 600), False: cut(2, 4, 800)}
    axis = across if gaps[across] is not None else not across
    if len(boxes) < 2 or gaps[axis] is None:
        return [r[0] for r in sorted(boxes, key=lambda r: (r[2], r[1], r[0]))]
    lo, hi = (1, 3) if axis else (2, 4)
    first = [r for r in boxes if (r[lo] + r[hi]) / 2 < gaps[axis]]
    return order_of(first, not axis) + order_of([r for r in boxes if r not in first], not axis)


def pages():
    rng = random.Random(4)
    out = {}
    for p in range(12):
        boxes = []
        for n in range(rng.choice([1, 2, 9, 25])):
            x, y = rng.randrange(0, 10) * 58, rng.randrange(0, 20) * 38
            boxes.append((n, float(x), float(y), float(x + rng.randrange(5, 90)), float(y + rng.randrange(5, 40))))
        out[f"p{p}"] = boxes
    columns = [(k, 10.0 + 200 * (k % 3), 100.0 + 40 * (k // 3), 150.0 + 200 * (k % 3), 130.0 + 40 * (k // 3)) for k in range(9)]
    nested = [(20, 10.0, 300.0, 60.0, 320.0), (21, 90.0, 300.0, 150.0, 320.0), (22, 10.0, 500.0, 550.0, 520.0)]
    out["columns"] = columns + nested
    out["ties"] = [(k, 50.0, 60.0 * k, 80.0, 60.0 * k + 10) for k in range(7)]
    out["same"] = [(k, 5.0, 5.0, 50.0, 50.0) for k in range(3)]
    return out


def test_reading_order_and_columns(spark):
    found = pages()
    df = page_of(spark, [(p, *b) for p, boxes in found.items() for b in boxes]).withColumn("_path_", F.lit("x"))
    got = {}
    for r in layout.reading_order(df, ["page"], "n").orderBy("page", "position").collect():
        got.setdefault(r.page, []).append(r.n)
    assert got == {p: order_of(b) for p, b in found.items()}
    cols = {(r.page, r.n): (r.column, r.n_columns) for r in layout.page_columns(df, ["page"], "n").collect()}
    assert cols["columns", 22][1] == 2 and cols["ties", 0] == (0, 1)
    two = page_of(spark, [("q", 1, 0.0, 0.0, 100.0, 10.0), ("q", 2, 300.0, 0.0, 400.0, 10.0), ("q", 3, 90.0, 20.0, 110.0, 30.0)])
    assert {(r.n, r.column, r.n_columns) for r in layout.page_columns(two, ["page"], "n").collect()} == {(1, 0, 2), (3, 0, 2), (2, 1, 2)}
    assert layout.reading_order(df.where("false"), ["page"], "n").count() == 0


def test_icons_are_bound_one_to_one(spark):
    rng = random.Random(9)
    icons, texts = [], []
    for p in ("a", "b", "c"):
        for n in range(14):
            y = rng.randrange(0, 300)
            icons.append((p, n, float(x := rng.randrange(0, 200)), float(y), float(x + rng.choice([10, 20, 95])), float(y + rng.choice([0, 12, 20]))))
        for n in range(16):
            y = rng.randrange(0, 300)
            texts.append((p, n, float(x := rng.randrange(0, 300)), float(y), float(x + 100), float(y + rng.choice([10, 25, 200]))))
    texts += [("c", 90, 500.0, 10.0, 510.0, 20.0), ("c", 91, 500.0, 10.0, 510.0, 20.0)]
    want = set()
    for p in ("a", "b", "c"):
        free = [t for t in texts if t[0] == p and t[5] > t[3]]
        for i in sorted(r for r in icons if r[0] == p):
            if i[4] - i[2] > 90 or i[5] - i[3] > 90:
                continue
            best = None
            for t in free:
                low = min(i[5] - i[3], t[5] - t[3])
                if low <= 0:
                    continue
                share = (min(i[5], t[5]) - max(i[3], t[3])) / low
                if share >= 0.25 and t[4] >= i[2]:
                    best = min(best or (9, 9, 9, None), (-share, max(0.0, t[2] - i[4]), t[1], t))
            if best:
                free.remove(best[3])
            want.add((p, i[1], best[3][1] if best else None))
    a = spark.createDataFrame(icons, BOX.replace("n long", "icon long"))
    b = spark.createDataFrame(texts, BOX.replace("n long", "text long"))
    assert {tuple(r) for r in layout.bind_icons(a, b, ["page"], "icon", "text").collect()} == want
    assert {r.text for r in layout.bind_icons(a, b.where("false"), ["page"], "icon", "text").collect()} == {None}


def test_sparse_grids(spark):
    cells = [("t", 0, 0, "a"), ("t", 0, 3, "b"), ("t", 70, 1, "c"), ("t", 71, 5, "d"), ("t", 70, 5, " e "), ("t", 2, 4, " "), ("t", 3, 2, None), ("t", 64, 3, "f"), ("u", 0, 9, "z")]
    df = spark.createDataFrame(cells, "grid string, row long, col long, text string")
    got = {tuple(r) for r in layout.collapse_grid(df, ["grid"]).select("grid", "row", "col", "text").collect()}
    # 0 and 1 share no row and merge; 3 has row 0 too; 5 shares no row with 3 and joins it.
    assert got == {("t", 0, 0, "a"), ("t", 70, 0, "c"), ("t", 0, 1, "b"), ("t", 64, 1, "f"), ("t", 71, 1, "d"), ("t", 70, 1, "e"), ("u", 0, 0, "z")}
    with pytest.raises(ValueError):
        layout.collapse_grid(df, ["grid"], most_columns=5)


def test_proposals_of_every_kind(spark):
    sections = [  # section, parent, ord, heading, number, n_units, all_boilerplate
        ("cover", None, 0, "Title", "0", 1, False), ("front", None, 1, "General", None, 1, False), ("toc", None, 2, "Table of Contents", "9", 1, False), ("one", None, 3, "Scope", "1", 5, False), ("kid", "one", 4, "A", "1.1", 2, False),
        ("moves", "kid", 5, "B", None, 3, False), ("deep", "moves", 6, "C", None, 1, False), ("deeper", "deep", 7, "D", None, 3, False), ("back", "deeper", 8, "E", None, 4, False), ("index", "one", 9, " contents", None, 4, False), ("under", "index", 10, "F", None, 4, False),
        ("close", None, 11, "G", "2.", 3, False), ("admin", None, 12, "H", "3", 3, True), ("named", None, 13, "I", "4", 3, True), ("lost", None, 14, "J", "5", 3, False), ("x", "y", 15, "K", None, 1, False), ("y", "x", 16, "L", None, 1, False),
    ]
    scores = [("one", "t1", 0.9, 0.5), ("one", "t2", 0.1, 0.4), ("kid", "t2", 0.0, 0.8), ("kid", "t1", 0.0, 0.45), ("moves", "t2", 0.0, 0.9), ("moves", "t1", 0.0, 0.1), ("deeper", "t2", 0.0, 0.1), ("deeper", "t3", 0.0, 0.3),
              ("back", "t1", 0.0, 0.9), ("under", "t1", 0.0, 1.0), ("close", "t2", 0.5, 0.5), ("close", "t1", 0.5, 0.5), ("admin", "t1", 0.5, 0.5), ("named", "t3", 0.85, 0.0), ("lost", "t1", 0.1, 0.2), ("toc", "t1", 1.0, 1.0)]
    s = spark.createDataFrame([("d", *r) for r in sections], "doc string, section string, parent string, ord long, heading string, number string, n_units long, all_boilerplate boolean")
    c = spark.createDataFrame([("d", *r) for r in scores], "doc string, section string, target string, name double, content double")
    proposed = planning.propose_sections(s, c)
    got = {r.section: (r.kind, r.target, r.reason, r.doubt, r.moved_from) for r in proposed.collect()}
    assert got == {
        "cover": ("omit", None, "cover", None, None), "front": ("omit", None, "front matter", None, None), "toc": ("omit", None, "contents", None, None), "one": ("mapped", "t1", "best match", None, None),
        "kid": ("mapped", "t1", "inherited", "content suggests t2", None), "moves": ("mapped", "t2", "content belongs elsewhere", None, "t1"), "deep": ("mapped", "t2", "inherited", None, None), "deeper": ("mapped", "t2", "inherited", None, None),
        "back": ("mapped", "t1", "content belongs elsewhere", None, "t2"), "index": ("omit", None, "contents", None, None), "under": ("omit", None, "inherited", None, None), "close": ("mapped", "t1", "best match", "close call: t1 vs t2", None),
        "admin": ("omit", None, "administrative", None, None), "named": ("mapped", "t3", "best match", None, None), "lost": ("unresolved", None, "no match", "no confident match", None),
        "x": ("unresolved", None, "parents form a cycle", None, None), "y": ("unresolved", None, "parents form a cycle", None, None),
    }
    units = spark.createDataFrame([("d", sec, f"{sec}-{k}", k) for sec in ("one", "moves", "close") for k in (2, 1)], "doc string, section string, unit string, n long")
    targets = spark.createDataFrame([("t1", True), ("t2", False), ("t3", True), ("t4", True), ("t5", False)], "target string, required boolean")
    plan = {(r.target, r.type, r.status): (r.sections, r.units) for r in planning.build_section_plan(proposed, s, units, targets).where("target is not null").collect()}
    assert plan == {
        ("t1", "split", "needs_review"): (["one", "kid", "back", "close"], ["one-1", "one-2"]), ("t2", "split", "mapped"): (["moves", "deep", "deeper"], ["moves-1", "moves-2"]), ("t3", "one_to_one", "mapped"): (["named"], []),
        ("t4", "unresolved", "source_content_not_found"): ([], []), ("t5", "unresolved", "not_applicable"): ([], []),
    }
    assert planning.propose_sections(s.where("false"), c.where("false")).count() == 0


def test_signals_over_subtrees(spark):
    s = spark.createDataFrame([("d", "a", None, "Training records"), ("d", "b", "a", "Other"), ("d", "e", None, "Empty")], "doc string, section string, parent string, heading string")
    u = spark.createDataFrame([("d", "b", "keep training records", False, {"record": 1.0}), ("d", "a", "signed by", True, {"x": 1.0}), ("d", "b", " ", False, {"x": 1.0})], "doc string, section string, text string, boilerplate boolean, labels map<string,double>")
    t = spark.createDataFrame([("t1", "Training records", "records of training", ["record_table"]), ("t2", "Scope", "scope", ["scope"])], "target string, name string, text string, types array<string>")
    out, scores = planning.section_signals(s, u, t, {"record": {"record_table": 0.8}})
    assert {r.section: (r.n_units, r.all_boilerplate) for r in out.collect()} == {"a": (1, False), "b": (1, False), "e": (0, False)}
    got = {(r.section, r.target): (r.name, r.content) for r in scores.collect()}
    # keep, training, record against record, training: cosine 2 / sqrt(3 * 2).
    assert got == {("a", "t1"): (1.0, 0.804), ("b", "t1"): (0.0, 0.804)}


def test_places_are_followed(spark):
    rows = [("d", k, v, r) for k, v, r in [("a", None, False), ("b", "a", False), ("c", "b", False), ("e", "c", False), ("f", "g", False), ("g", None, True), ("h", "nowhere", False), ("i", "j", False), ("j", "k", False), ("k", "j", False), ("s", "s", False)]]
    rows += [("long", f"{k}", f"{k + 1}", False) for k in range(1000)] + [("long", "1000", None, False)]
    df = spark.createDataFrame(rows, "doc string, place string, into string, removed boolean")
    got = {(r.doc, r.place): (r.final, r.hops, r.outcome) for r in assembly.follow_places(df, ["doc"]).collect()}
    assert [got["d", k] for k in "abcefghijks"] == [("a", 0, "present"), ("a", 1, "merged"), ("a", 2, "merged"), ("a", 3, "merged"), (None, 1, "removed"), (None, 0, "removed"), (None, 0, "unknown"), (None, None, "cycle"), (None, None, "cycle"), (None, None, "cycle"), (None, None, "cycle")]
    assert got["long", "0"] == ("1000", 1000, "merged") and len(got) == len(rows)


def test_references_show_new_numbers(spark):
    rows = [("see 1.2, 2 and 2.", "2", "4.1", "see 1.2, 4.1 and 2.", 9), ("no. 22", "2", "3", "no. 22", None), ("2", "2", "7", "7", 0), ("chapter 2", "2", None, "chapter 2", None), ("", "1", "2", "", None), ("x 2.1", "2.1", "10", "x 10", 2)]
    df = spark.createDataFrame([r[:3] for r in rows], "p string, o string, n string")
    text, at = assembly.show_ref(df.p, df.o, df.n)
    assert [tuple(r) for r in df.select(text, at).collect()] == [(r[3], r[4]) for r in rows]


def test_relative_references(spark):
    df = spark.createDataFrame([("d", "a", 1, 5, None), ("d", "b", 2, 4, "before"), ("d", "c", 3, 9, "after"), ("d", "x", 4, None, "before"), ("d", "e", 5, 2, "before"), ("d", "f", 6, 7, "after")], "doc string, place string, pos long, new_pos long, direction string")
    assert {tuple(r) for r in assembly.relative_issues(df).collect()} == {("d", "b", "a", "before"), ("d", "c", "e", "after"), ("d", "e", "c", "before")}


def test_glossary_of_phrases(spark):
    known = [("standard operating procedure", False), ("operating procedure", False), ("procedure", False), ("QA", True), ("entry", False), ("box", False), ("C++", False), ("process owner of the day", False), ("  ", False), (None, False), ("owner", False), ("owner", True)]
    texts = ["The Standard   Operating\nProcedures and a procedure.", "qa or QA; QAS", "Entries, entrys, ENTRY, boxes boxed", "C++ and C+++ xC++", "the process owner of the days", None, "", "standard operating procedure procedure" * 2]
    u = spark.createDataFrame(list(enumerate(texts)), "k long, text string").withColumn("term", F.lit("x"))
    g = spark.createDataFrame(known, "term string, case_sensitive boolean")
    got = {}
    for most in (100, 1):
        rows = glossary.glossary_match(u, g, ["k"], most_terms=most).orderBy("k", "start").collect()
        got[most] = [(r.k, r.term, r.matched) for r in rows]
    assert got[100] == got[1] == [
        (0, "standard operating procedure", "Standard Operating Procedures"), (0, "procedure", "procedure"), (1, "QA", "QA"), (1, "QA", "QAS"), (2, "entry", "Entries"), (2, "entry", "ENTRY"), (2, "box", "boxes"), (3, "C++", "C++"), (3, "C++", "C++"),
        (4, "process owner of the day", "process owner of the days"), (7, "standard operating procedure", "standard operating procedure"), (7, "operating procedure", "operating procedure"), (7, "procedure", "procedure"),
    ]


def test_terms_in_translations(spark):
    rows = [("des besitzenden systems", "besitzendes system", "de", True), ("die rpas-risikoanalyse", "risikoanalyse", "de", True), ("ein auto", "besitzer", "de", False), ("systemlebenszyklus", "zyklus", "de", True), ("daten-bank hier", "daten bank", "de", True), ("規 格書", "規格", "ja", True), ("規書", "規格", "ja", False), ("x", " ", "de", True), (None, "a", "de", False)]
    df = spark.createDataFrame(rows, "tr string, term string, lang string, want boolean")
    assert [r.x for r in df.select(glossary.term_present(df.tr, df.term, df.lang).alias("x")).collect()] == [r[3] for r in rows]
    rows = [("die arbeitsanweisungen gelten", "arbeitsanweisung", False, True), ("gmp regeln", "gmp", True, True), ("gmps", "gmp", True, False), ("gmps", "gmp", False, True), ("das auto", "wagen", False, False), ("neue wagens", "neue wagen", False, True)]
    df = spark.createDataFrame(rows, "tr string, term string, keep boolean, want boolean")
    assert [r.x for r in df.select(glossary.target_present(df.tr, df.term, F.lit("de"), df.keep).alias("x")).collect()] == [r[3] for r in rows]


def test_folding(spark):
    words = ["Ärger", "STRASSE", "Straße", "ﬁn", "Ǆ", "É", None, "", "ｆｕｌｌ", "é"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.x for r in df.select(fold.unicode_fold(df.w).alias("x")).collect()] == ["arger", "strasse", "strasse", "fin", "dz", "e", None, "", "full", "e"]
    assert fold.folded("Ä", case=False) == "A" and fold.folded("Ä", accents=False) == "ä"


def test_terms_give_way_to_longer_ones(spark):
    texts = [f"The deviation report form number {k} is used." for k in range(4)] + [f"A deviation report, {k}." for k in range(2)] + ["Owning Systems (of it) - owning systems", "owning system here", "An owning system", None, "", "The deviation report form number 1 is used."]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    got = {(r.term, r.n_texts) for r in terms.phrase_counts(df).collect()}
    assert got == {("deviation report", 6), ("deviation report form number", 4), ("owning system", 3)}
    words = spark.createDataFrame([(w,) for w in ("systems", "entries", "RPAS", "gas", "process", "basis", "status", "Bs", "ties")], "w string")
    assert [r.x for r in words.select(terms.singular(words.w).alias("x")).collect()] == ["system", "entry", "RPAS", "gas", "process", "basis", "status", "Bs", "ty"]
    assert {r.term for r in terms.find_terms(terms.phrase_counts(df), spark.createDataFrame([("form number",)], "term string")).collect()} == {"deviation report", "owning system"}


def test_scan_gives_running_states(spark):
    df = spark.createDataFrame([(1, list(range(1, 300))), (2, []), (3, [5])], "k long, x array<long>")
    out = folds.scan(df.x, F.lit(0).cast("long"), lambda s, x: s + x, lambda s, x: s, "bigint", block=7)
    got = {r.k: r.o for r in df.select("k", out.alias("o")).collect()}
    assert got == {1: [n * (n + 1) // 2 for n in range(1, 300)], 2: [], 3: [5]}


def test_torn_paragraphs(spark):
    rows = [("a", ["Open (one", "two [three", "four] five", "six) end", "Next."]), ("b", ["One-", "Two", "three", "Four:", "five"]), ("c", ["[Icon: x]", "Text.", "More.", "  [Table: y]", ")"]), ("d", ["x", "", "y", None, "z"]), ("e", ["Ends.", "») closes", "É upper", "é lower"])]
    df = spark.createDataFrame([(d, k, x) for d, xs in rows for k, x in enumerate(xs)], "doc string, seq long, text string")
    got = {}
    for r in chunks.merge_paragraphs(df, ["doc"], "seq").orderBy("doc", "first").collect():
        got.setdefault(r.doc, []).append(r.text)
    assert got == {"a": ["Open (one two [three four] five six) end", "Next."], "b": ["One- Two three", "Four:", "five"], "c": ["[Icon: x] Text. More.   [Table: y] )"], "d": ["x", "", "y", "", "z"], "e": ["Ends.", "») closes", "É upper é lower"]}


def test_markers_of_translations(spark):
    rows = [
        ("⟦1⟧a⟦2⟧b⟦/2⟧⟦/1⟧⟦3⟧", "⟦1⟧a⟦2⟧b⟦/1⟧⟦/2⟧", "⟦3⟧", "", "crossing", 1), ("⟦1⟧a⟦/1⟧", "⟦/1⟧a⟦1⟧", "", "", "unbalanced", 1), ("⟦1⟧⟦1⟧", "⟦1⟧", "⟦1⟧", "", None, None), ("⟦1⟧a⟦/1⟧", "⟦1⟧", "⟦/1⟧⟦1⟧", "⟦1⟧", None, None),
        (None, "⟦2⟧⟦10⟧⟦2⟧", "", "⟦2⟧⟦2⟧⟦10⟧", None, None), ("", None, "", "", None, None), ("⟦1⟧⟦2⟧⟦3⟧⟦/3⟧⟦/2⟧⟦/1⟧", "⟦1⟧⟦2⟧⟦3⟧⟦/3⟧⟦/2⟧⟦/1⟧", "", "", None, None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "s string, t string")
    assert [("".join(r.missing), "".join(r.extra), r.broken, r.pair) for r in translation.tag_diff(df, "s", "t").collect()] == [r[2:] for r in rows]


def test_matrix_of_many_targets(spark):
    s, t = spark.range(7).withColumnRenamed("id", "s"), spark.range(25).withColumnRenamed("id", "t")
    for block in (1000, 4):
        assert {tuple(r) for r in plans.score_matrix(s, t, F.col("s") * F.col("t"), block).select("s", "t", "score").collect()} == {(a, b, a * b) for a in range(7) for b in range(25)}


def test_near_duplicate_rules_against_brute_force(spark):
    rng = random.Random(8)
    words = "approve record batch label review archive deviation sample store form sign copy".split()
    rows = [(k, " ".join(rng.sample(words, rng.randrange(1, 7))), rng.choice(["a", "b", None]), rng.choice(["s", "t", None]), rng.randrange(5)) for k in range(250)]
    rows += [(900, None, "a", "s", 1), (901, "", "a", "s", 2), (902, "the use of it", "a", "s", 2), (903, "Records, RECORDS!", "a", "q", 4), (904, "record", "a", "r", 0)]
    df = spark.createDataFrame(rows, "id long, text string, category string, source string, severity long").withColumn("k", F.lit(1)).withColumn("w", F.lit("x"))

    def own(text):
        found = {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split()} - set(duplicates.RULE_STOP)
        return frozenset(w[:-1] if len(w) > 3 and w.endswith("s") else w for w in found)

    classes = {}
    for k, text, cat, src, sev in rows:
        c = classes.setdefault((own(text), cat) if own(text) else k, [k, own(text), cat, set(), 0, 0])
        c[3] |= {src} - {None}
        c[4], c[5] = c[4] + 1, max(c[5], sev)
    kept = []
    for k, w, cat, src, n, sev in sorted(classes.values(), key=lambda c: c[0]):
        for rule in kept:
            if w and rule[1] and 100 * len(w & rule[1]) >= 60 * len(w | rule[1]) and (cat == rule[2] or src & rule[3]):
                rule[4] += n
                rule[5] = max(rule[5], sev)
                rule[6] |= src
                break
        else:
            kept.append([k, w, cat, src, n, sev, set(src)])
    got = {(r.id, r.n, tuple(r.sources), r.severity) for r in duplicates.merge_duplicates(df).collect()}
    assert got == {(k, n, tuple(sorted(all_)), sev) for k, _, _, _, n, sev, all_ in kept}
    assert duplicates.merge_duplicates(df.where("false")).count() == 0


def test_slot_plans(spark):
    scope = spark.createDataFrame([("d", "s", "u1", 1), ("d", "s", "u2", 2), ("d", "s", "u3", 3), ("d", "s", "u4", 4), ("d", "t", "u9", 9)], "doc string, section string, unit string, seq long")
    slots = spark.createDataFrame([("d", "s", "a", True, None), ("d", "s", "b", True, "g"), ("d", "s", "c", True, "g"), ("d", "s", "e", True, None), ("d", "s", "f", False, None), ("d", "s", "h", True, None), ("d", "t", "z", True, None), ("d", "n", "y", True, None)], "doc string, section string, slot string, required boolean, grp string")
    mappings = spark.createDataFrame([("d", "s", "a", "mapped", False), ("d", "s", "b", "mapped", True), ("d", "s", "c", "not_applicable", False), ("d", "s", "e", "not_applicable", False), ("d", "s", "f", "source_content_not_found", None), ("d", "n", "y", "not_applicable", False)], "doc string, section string, slot string, status string, review boolean")
    placed = spark.createDataFrame([("d", "s", "a", "u2", 1), ("d", "s", "a", "u1", 2), ("d", "s", "b", "u9", 1), ("d", "s", None, "u3", 1)], "doc string, section string, slot string, unit string, pos long")
    none = spark.createDataFrame([], "doc string, section string, unit string")
    issues, coverage = validation.validate_slot_plan(scope, slots, mappings, placed, none)
    assert {(r.section, r.slot, r.issue, r.severity, tuple(r.units)) for r in issues.collect()} == {
        ("t", None, "no_plan", "high", ()), ("s", None, "unaccounted", "critical", ("u4",)), ("s", None, "outside", "high", ("u9",)), ("s", "a", "order", "high", ()), ("s", "b", "review", "medium", ()),
        ("s", "e", "required", "high", ()), ("s", "f", "gap", "medium", ()), ("s", "h", "no_mapping", "high", ()),
    }
    assert [tuple(r) for r in coverage.collect()] == [("d", 5, 3, 0.6)]


def test_reports_carry_resolutions_and_raise_risks(spark):
    issues = spark.createDataFrame([("d", "1", "medium", None, False, ["u"]), ("d", "2", "medium", None, True, ["u"]), ("d", "3", "low", None, False, ["u"]), ("d", "4", "critical", "g", False, ["x"]), ("d", "4", "low", "g", False, ["x"]), ("d", "5", "high", "g", False, []), ("d", "6", "critical", None, None, ["u", "v"])], "doc string, issue_id string, severity string, gate string, critic boolean, units array<string>")
    risks = spark.createDataFrame([("d", "u", "safety"), ("d", "v", "approval"), ("d", "u", "safety")], "doc string, unit string, tag string")
    previous = spark.createDataFrame([("d", "5", True, "fine"), ("d", "3", False, None)], "doc string, issue_id string, resolved boolean, note string")
    shown, gates = validation.quality_report(issues, risks, previous)
    assert [(r.issue_id, r.severity, r.gate, r.resolved, r.note, r.risk) for r in shown.orderBy("n").collect()] == [
        ("4", "critical", "g", False, None, None), ("6", "critical", "high_risk_unresolved", False, None, "approval, safety"), ("1", "high", "high_risk_unresolved", False, None, "safety"),
        ("2", "medium", None, False, None, None), ("3", "low", None, False, None, None), ("5", "high", "g", True, "fine", None),
    ]
    assert {tuple(r) for r in gates.collect()} == {("d", "g", 1), ("d", "high_risk_unresolved", 2), ("d", "all", 3)}

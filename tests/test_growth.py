"""What queries do as their tables grow: shapes of plans, rows that travel, and odd inputs of the steps that were changed for it."""

import pytest
from pyspark.sql import functions as F

from docspark import plans
from docspark.operators import chunks, duplicates, glossary, layout, loops, planning, preservation, reconcile, terms, validation


def plan(df):
    """The optimized plan, as text."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, joins", [("k9_validate_slot_plan", 3), ("k13_quality_report", 3), ("k13b_gates", 6)])
def test_reports_do_not_pass_the_driver(spark, sf, name, joins):
    df = plans.QUERIES[name](spark, sf)
    assert "Broadcast" not in physical(df) and plan(df).count("Join ") <= joins


def test_slot_plan_with_nulls(spark):
    """A null unit is accounted for by nothing, and a section nobody touched says only that."""
    scope = spark.createDataFrame([(1, 1, None, 1), (1, 1, "a", 2), (1, 1, "b", 3), (1, 2, "a", 1)], "doc int, section int, unit string, seq int")
    slots = spark.createDataFrame([(1, 1, 0, True, None), (1, 2, 0, True, None)], "doc int, section int, slot int, required boolean, grp string")
    mappings = spark.createDataFrame([(1, 1, 0, "mapped", False)], "doc int, section int, slot int, status string, review boolean")
    placed = spark.createDataFrame([(1, 1, 0, None, 1), (1, 1, 0, "b", 2), (1, 1, 0, "a", 3)], "doc int, section int, slot int, unit string, pos int")
    unplaced = spark.createDataFrame([], "doc int, section int, unit string")
    issues, coverage = validation.validate_slot_plan(scope, slots, mappings, placed, unplaced)
    assert {(r.section, r.slot, r.issue, tuple(r.units)) for r in issues.collect()} == {(1, None, "unaccounted", (None,)), (1, None, "outside", (None,)), (1, 0, "order", ()), (2, None, "no_plan", ())}
    assert [tuple(r) for r in coverage.collect()] == [(1, 3, 2, 0.667)]


@pytest.mark.parametrize("name", ["h15_obligations", "h16b_defined_terms", "h17_roles", "g3_role_diff"])
def test_texts_are_read_once(spark, sf, name):
    """Rows meet what was read from their texts; no pattern runs on them."""
    assert "regexp_extract_all" not in plan(plans.QUERIES[name](spark, sf))


def test_facts_of_repeated_and_missing_texts(spark):
    text = "The Lab Manager must approve it."
    units = spark.createDataFrame([(1, "a", text), (1, "b", text), (1, "c", None), (1, "d", ""), (None, "e", text)], "doc int, unit string, text string")
    assert sorted((r.doc, r.unit, r.fact, r.kind, r.normalized) for r in preservation.extract_facts(units, ["doc"], "unit").where("doc is not null").collect()) == sorted(
        (1, u, *f) for u in "ab" for f in [("obligation", "mandatory", "Lab Manager"), ("role", None, "lab manager")]
    )
    assert preservation.extract_facts(units, ["doc"], "unit").where("doc is null").count() == 2
    assert [r.unit for r in preservation.obligations(units, "unit").orderBy("unit").collect()] == ["a", "b", "e"]


def test_tfidf_shuffles_texts_once(spark):
    units = spark.createDataFrame([(1, 1, "red box"), (1, 2, "red box"), (1, 3, "? !"), (1, 4, None), (1, 5, "red"), (2, 1, "red")], "doc int, seq int, text string")
    got = chunks.tfidf_adjacent(units, "doc", "seq")
    assert physical(got).count("Exchange") == 1 and "Join" not in physical(got)
    assert sorted((r.doc, r.seq, round(r.cosine, 6)) for r in got.collect()) == [(1, 1, 1.0), (1, 2, 0.0), (1, 3, 0.0), (1, 4, 0.0)]


def test_phrases_are_shuffled_once(spark, sf):
    """Texts once, phrases once, summed up before; no table of all phrases is written or joined."""
    got = terms._per_phrase(plans.inputs.units(spark, sf), 4, "text")
    assert physical(got).count("Exchange hash") == 2 and "Join" not in physical(got)


def test_parts_of_phrases_that_end_in_a_plural(spark):
    """A part that ends in a plural counts only in texts that have it by another way; years are no words."""
    data = ["red TANKS box. red tanks box"] * 2 + [f"red TANKS box. red tanks box {k}" for k in range(3)] + ["red pumps unit", "red pumps unit, red pump", "red pumps unit/0", None, "", "1990s", "old 1990s"]
    df = spark.createDataFrame([(x,) for x in data], "text string")
    got = {r.term: (r.size, r.n_texts, r._n0) for r in terms._per_phrase(df, 3, "text").collect()}
    assert got == {"red tank": (2, 4, 0), "red tanks": (2, 4, 0), "tanks box": (2, 4, 0), "red tanks box": (3, 4, 4), "red pump": (2, 3, 0), "pumps unit": (2, 3, 0), "red pumps unit": (3, 3, 0)}
    assert {r.term for r in terms.phrase_counts(df).collect()} == {"red tank", "red tanks box", "red pump", "red pumps unit"}


def test_linked_pairs_are_made_once(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "y"), (3, None), (4, "z")], "a int, v string")
    b = spark.createDataFrame([(k, v) for k in range(7) for v in "xy"] + [(9, "y"), (None, "y"), (8, None)], "b int, v string")
    for block in (2, 2000):
        got = reconcile.linked_pairs(a, b, "a", "b", "v", block)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(((k, x) for k in (1, 2) for x in [*range(7), 9, None]), key=str)
    assert not physical(plans.reconcile.rc.linked_pairs(a, b, "a", "b", "v")).split("Join")[0].count("Aggregate")


def test_label_scores_sum_nothing_per_pair(spark):
    p = spark.createDataFrame([(1, "R", 0.5), (1, "A", 0.25), (1, None, 0.25), (2, "Q", 1.0), (3, "A", None), (None, "R", 1.0)], "s int, label string, share double")
    t = spark.createDataFrame([("t", ["0", "2"]), ("u", ["1"]), ("v", [])], "target string, types array<string>")
    match = {"R": {"0": 1.0, "1": 0.4}, "A": {"2": 0.8}}
    want = {(1, "t", 0.7), (1, "u", 0.2), (3, "t", None), (None, "t", 1.0), (None, "u", 0.4)}
    got = planning.label_scores(p, t, ["s"], "target", match)
    assert {(r.s, r.target, r.label_score and round(r.label_score, 6)) for r in got.collect()} == want
    assert "Aggregate" not in physical(got).split("Join")[0]


def test_levels_read_their_sections_once(spark, sf, monkeypatch):
    """What a level of the tree reads is a table, not the query that made it."""
    seen = []

    def step_of(start, step, label):
        seen.append(plan(step(start)[1]))
        return loops.until_empty(start, step, label)

    monkeypatch.setattr(planning, "until_empty", step_of)
    assert plans.QUERIES["k5_build_section_plan"](spark, sf).count() > 0
    assert len(seen) == 2 and not any(x in p for p in seen for x in ("l_orderkey", "o_custkey"))


def test_similar_pairs_meet_without_their_sets(spark, monkeypatch):
    """All pairs, found by numbers: no set goes through the join that makes candidates, and copies of a frequent word are none."""
    import random

    draw, words = random.Random(7), [f"w{k}" for k in range(40)]
    sets = {k: draw.sample(words, draw.choice((1, 2, 3, 5, 8, 20))) for k in range(120)}
    sets |= {1000 + k: [w for w in sets[k] if draw.random() < 0.8] + ["all"] for k in range(120)} | {2000: []}
    df = spark.createDataFrame(list(sets.items()), "id long, w array<string>")
    seen = {}

    def stored(table, label):
        seen[label] = table
        return loops.stored(table, label)

    monkeypatch.setattr(duplicates, "stored", stored)
    for percent in (30, 60):
        want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len({*sets[a]} & {*sets[b]}) >= percent * len({*sets[a]} | {*sets[b]})}
        assert {tuple(r) for r in duplicates.similar_pairs(df, "id", "w", percent).collect()} == want
        made = plan(seen["similar"]).split("Aggregate")[-1]
        assert "Join" in made and "bit_count" in made and "array_intersect" not in made


def test_glossary_sends_no_text(spark):
    """However large the glossary, only uses are shuffled; terms that begin with the same word are told apart where they meet, and parts of a glossary find what the whole finds."""
    known = spark.createDataFrame([("red box", False), ("red fox", False), ("red", True), ("ΟΔΟΣ'Α", False), ("red box of tin", False), ("tin", False)], "term string, case_sensitive boolean")
    texts = ["Red  Foxes, red boxes of tin; red Box of Tin", "red", "RED", "οδοσ'α", "tin", "", None]
    units = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    want = [(0, "red fox", 1, 3), (0, "red box", 6, 3), (0, "tin", 12, 1), (0, "red box of tin", 15, 7), (1, "red", 1, 1), (3, "ΟΔΟΣ'Α", 1, 3), (4, "tin", 1, 1)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (100, 5):
            got = glossary.glossary_match(units, known, ["k"], most_terms=most)
            assert "SortMergeJoin" not in physical(got) and physical(got).count("Exchange hash") == 1
            assert [(r.k, r.term, r.start, r.n) for r in got.orderBy("k", "start").collect()] == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reading_order_writes_once_in_four_cuts(spark, monkeypatch):
    """Nine cuts below each other take three rounds, each written once; pages of one box and boxes without coordinates keep their place."""
    seen = []

    def stored(table, label):
        seen.append(physical(table))
        return loops.stored(table, label)

    monkeypatch.setattr(layout, "stored", stored)
    boxes = [(1, 10 - k, 60.0 * k, 60.0 * k, 60.0 * k + 20, 60.0 * k + 20) for k in range(10)] + [(2, 1, 5.0, 5.0, 9.0, 9.0), (3, 2, 300.0, 300.0, 310.0, 310.0), (3, 1, None, None, None, None)]
    df = spark.createDataFrame(boxes, "page int, n int, x0 double, y0 double, x1 double, y1 double").withColumns({"page_width": F.lit(612.0), "page_height": F.lit(792.0)})
    got = {(r.page, r.n): r.position for r in layout.reading_order(df, ["page"], "n").collect()}
    assert got == {(1, 10 - k): k + 1 for k in range(10)} | {(2, 1): 1, (3, 1): 1, (3, 2): 2}
    assert len(seen) == 3 and [p.count("Exchange hash") for p in seen] == [1, 1, 1], [[x.strip()[:90] for x in p.split(chr(10)) if "Exchange" in x] for p in seen]


def test_sets_are_ordered_in_their_rows(spark, monkeypatch):
    """No word travels to be ordered, the table of how frequent words are is copied into no row, and whole sets travel as strings."""
    seen = {}

    def stored(table, label):
        seen[label] = table
        return loops.stored(table, label)

    monkeypatch.setattr(duplicates, "stored", stored)
    rules = spark.createDataFrame([(1, "Red boxes, the red box", "c", "s", 1), (2, "red box", "c", "t", 2), (3, None, "c", None, 3), (4, "The of", None, "s", 0), (5, "box red glass", "d", "t", 1)], "id long, text string, category string, source string, severity long")
    got = {r.id: (r.n, r.sources, r.severity) for r in duplicates.merge_duplicates(rules).collect()}
    assert got == {1: (2, ["s", "t"], 2), 3: (1, [], 3), 4: (1, ["s"], 0), 5: (1, ["t"], 1)}
    made = plan(seen["rarest-first"])
    assert "Join" not in made and "AS _levels" not in made and "Exchange" not in physical(seen["rarest-first"]).split("Subquery")[0]
    assert "string" in dict(seen["rule-classes"].dtypes)["_w"]


def test_rule_words_in_one_pass(spark):
    said = "the The thes sss ssss abss A_b Ünders documents documentss Boxes, box; 3s 333s is-this bass"
    df = spark.createDataFrame([(said,), ("",), (None,)], "text string").select(duplicates.rule_words(F.col("text")).alias("w"))
    assert [r.w for r in df.collect()] == [["the", "sss", "abs", "b", "nder", "documents", "boxe", "box", "3s", "333", "bas"], [], None]


def test_large_glossary_reads_texts_once(spark, monkeypatch):
    """Twenty times ``most_terms`` spellings take one reading of the texts; more take several, which find the same."""
    seen = []

    def stored(table, label):
        seen.append(label)
        return loops.stored(table, label)

    monkeypatch.setattr(glossary, "stored", stored)
    known = spark.createDataFrame([("red box", False), ("red", True), ("#12", False), ("box of tin", False), ("C++", True), ("a b c d e f g h i j", False), ("glass", False), ("tool", False)], "term string, case_sensitive boolean")
    texts = ["Red boxes, red boxes of tin; red Box", "a #12, a#12 and #123", "C++ c++ C++x", "A  b c d e f g h i js", "", None]
    units = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    want = [(0, "red box", 1, 3), (0, "red box", 6, 3), (0, "red box", 15, 3), (1, "#12", 3, 2), (2, "C++", 1, 3), (3, "a b c d e f g h i j", 1, 19)]
    for most, reads in ((100, 0), (2, 1), (1, 2)):
        seen.clear()
        got = glossary.glossary_match(units, known, ["k"], most_terms=most)
        assert [(r.k, r.term, r.start, r.n) for r in got.orderBy("k", "start").collect()] == want
        assert seen == ["spellings"] + ["uses"] * reads


def test_known_terms_do_not_pass_the_driver(spark):
    """Terms that hold known ones are found by sorting, whatever the sizes."""
    counts = spark.createDataFrame([("red box", 2, 5), ("red boxes of tin", 4, 3), ("tin foil", 2, 4), ("old tins", 2, 3), ("tinned box", 2, 3), ("blue foxe", 2, 3)], "term string, size int, n_texts long")
    known = spark.createDataFrame([("tin",), ("Red Box",), ("fox",), ("",), (None,)], "term string")
    got = terms.find_terms(counts, known)
    assert "Broadcast" not in physical(got)
    assert sorted(r.term for r in got.collect()) == ["blue foxe", "tinned box"]


def test_facts_meet_their_units_once(spark, sf, monkeypatch):
    """Units travel once, without texts, to meet what their document knows; no table is read or pattern run in the step that gives facts."""
    seen = {}

    def stored(table, label):
        seen[label] = physical(table)
        return loops.stored(table, label)

    monkeypatch.setattr(preservation, "stored", stored)
    got = plans.QUERIES["k2b_document_facts"](spark, sf)
    assert plan(got).count("Join ") == 1 and "lineitem" not in physical(got) and "regexp" not in plan(got)
    assert seen["met-texts"].count("Exchange hash") == 2


@pytest.mark.parametrize("name, joins", [("k9_validate_slot_plan", 2), ("k13b_gates", 2)])
def test_sections_meet_their_slots_as_lists(spark, sf, name, joins):
    assert plan(plans.QUERIES[name](spark, sf)).count("Join ") == joins


def test_slots_with_groups_and_several_mappings(spark):
    """Slots without a group don't hide a group's gap; each mapping of a slot is judged; places count per slot."""
    scope = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "c", 1)], "doc int, section int, unit string, seq int")
    slots = spark.createDataFrame([(1, 1, 0, True, None), (1, 1, 1, True, "g"), (1, 1, 2, True, "g"), (1, 1, 3, True, None), (1, 2, 0, True, "h"), (1, 2, 1, True, "h")], "doc int, section int, slot int, required boolean, grp string")
    mapped = [(1, 1, 0, "mapped", True), (1, 1, 0, "needs_review", None), (1, 1, 1, "mapped", None), (1, 1, 2, "mapped", False), (1, 2, 0, "source_content_not_found", False), (1, 2, 1, None, None), (1, None, 0, "mapped", False)]
    mappings = spark.createDataFrame(mapped, "doc int, section int, slot int, status string, review boolean")
    placed = spark.createDataFrame([(1, 1, 0, "b", 1), (1, 1, 0, "a", 2), (1, 1, None, "b", 3), (1, 1, 3, "a", 1), (1, 1, 3, "b", 2)], "doc int, section int, slot int, unit string, pos int")
    unplaced = spark.createDataFrame([(1, 2, "c")], "doc int, section int, unit string")
    issues, _ = validation.validate_slot_plan(scope, slots, mappings, placed, unplaced)
    want = [(1, 0, "order"), (1, 0, "order"), (1, 0, "review"), (1, 0, "review"), (1, 1, "required"), (1, 2, "required"), (1, 3, "no_mapping"), (2, -1, "unplaced"), (2, 0, "gap")]
    assert sorted((r.section, -1 if r.slot is None else r.slot, r.issue) for r in issues.collect()) == want

"""Protected values and obligations: equal meaning in other words is no change, every seeded fault is one."""

from pyspark.sql import functions as F

from docspark.functions import facts, text
from docspark.operators import chunks, composites, history, matching, plans, preservation, quality, structure

SAME = [
    ("Review it annually.", "Review it every 12 months."), ("Reply within five business days.", "Reply within 5 working days."), ("Take 1,000 mg.", "Take 1000 mg."), ("Signed on 3 May 2024.", "Signed on 2024-05-03."),
    ("Use at least 2.50 kg.", "Use no less than 2.5 kg."), ("Twice a week.", "2 times per week."), ("Read SOP-QA-001.", "Read SOP-QA-001 first."), ("Keep 10 % there.", "Keep 10 percent there."), ("See section 4.2.", "See above."),
]
FAULTS = [
    ("Reply within 5 days.", "Reply within 6 days.", "changed"), ("Reply within 5 days.", "Reply soon.", "missing"), ("Reply soon.", "Reply within 5 days.", "added"), ("At least 5 mg.", "At most 5 mg.", "changed"),
    ("Every 3 months.", "Every 2 months.", "changed"), ("Signed on 3 May 2024.", "Signed on 4 May 2024.", "changed"), ("Use 5 mg.", "Use 5 kg.", "changed"), ("Mail a@b.org.", "Mail c@b.org.", "changed"),
]


def test_rewrites(spark):
    rows = [(i, a, b) for i, (a, b, *_) in enumerate(SAME + FAULTS)]
    units = spark.createDataFrame([(i, a) for i, a, _ in rows], "unit_id long, text string")
    claims = spark.createDataFrame([(i, b) for i, _, b in rows], "unit_id long, text string")
    got = {}
    for r in preservation.check_preservation(units, claims, "unit_id").collect():
        got.setdefault(r.unit_id, set()).add(r.issue)
    assert got == {len(SAME) + k: {f[2]} for k, f in enumerate(FAULTS)}


def test_modalities_and_imperatives(spark):
    rows = [("You must not open it.", "prohibition", False), ("It should be clean.", "recommended", False), ("It can only be used once.", "mandatory", False), ("It may be used if required.", "permitted", False), ("It will be sent and must be kept.", "mandatory,future", False), ("Approve the record.", "mandatory", True), ("Change Owner approves it.", "", False), ("Do not open it.", "prohibition", False), ("He can't, and they shall not.", "prohibition", False), ("It is not permitted to run; it is advisable to wait.", "prohibition,recommended", False), ("Data can also be found there, in May 2024.", "", False), ("Review of the record.", "", False), ("", "", False)]
    df = spark.createDataFrame([(a,) for a, *_ in rows], "s string")
    got = df.select(facts.modalities(df.s).alias("m"), facts.is_imperative(df.s).alias("i")).collect()
    assert [(",".join(r.m), r.i) for r in got] == [(m, i) for _, m, i in rows]


def test_hamming_match_of_many(spark):
    rng = __import__("random").Random(5)
    hashes, library = [rng.getrandbits(16) for _ in range(300)], [(f"m{rng.randrange(50)}", rng.getrandbits(16)) for _ in range(80)]
    rows = spark.createDataFrame([*enumerate(hashes), (900, None)], "k long, h long")
    want = {k: min((m for m, x in library if (h ^ x).bit_count() <= 3), default=None) for k, h in enumerate(hashes)} | {900: None}
    for lib in (library, []):
        got = matching.hamming_match(rows, spark.createDataFrame(lib, "m string, h long"), "k", "m", 3, 16)
        assert {r.k: r.meaning for r in got.collect()} == (want if lib else dict.fromkeys(want))


def test_text_forms(spark):
    df = spark.createDataFrame([("1.2 Title — x {{ref:a}}", "systems"), ("(a)  item\n two", "entries"), ("Ends. Next one; Third! no", "process")], "a string, b string")
    got = df.select(text.clean_text(df.a).alias("c"), text.stem(df.b).alias("s"), text.sentences(df.a).alias("n"), text.syllables(df.b).alias("y")).collect()
    assert [r.c.strip() for r in got] == ["Title - x", "item\n two", "Ends. Next one; Third! no"]
    assert [r.s for r in got] == ["system", "entry", "process"] and got[2].n == ["Ends.", "Next one;", "Third! no"]
    assert [r.y for r in got] == [2, 2, 2]


def test_versions_and_budgets(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, version long, v string")
    new = history.next_versions(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, n long"), ["k"], ["n"], old)
    assert {(r.k, r.n): r.version for r in new.collect()} == {("a", 1): 3, ("a", 2): 4, ("b", 1): 1}
    assert [tuple(r) for r in history.latest_version(old, ["k"]).select("k", "version", "v").collect()] == [("a", 2, "y")]
    rows = spark.createDataFrame([("d", 1, 5), ("d", 2, 6), ("d", 3, 1)], "d string, seq long, c long")
    assert [r.seq for r in quality.budget_prefix(rows, ["d"], ["seq"], rows.c, 10).collect()] == [1]
    merged = structure.merge_continuations(spark.createDataFrame([("d", 1, "one"), ("d", 2, "Two"), ("d", 3, "more")], "d string, seq long, text string"), __import__("pyspark").sql.functions.col("text").rlike("^[A-Z]"), ["d"], ["seq"])
    assert {(r.part, r.text) for r in merged.collect()} == {(1, "one"), (2, "Two more")}


def test_nested_boxes_and_numbers_without_whole_groups(spark, capsys):
    rng = __import__("random").Random(3)
    rows = [(p, k, float(x), float(y), float(x + rng.choice([0, 3, 40])), float(y + rng.choice([0, 2, 60]))) for p in ("a", None) for k in range(300) for x, y in [(rng.randrange(-30, 120), rng.randrange(90))]]
    rows += [("a", 1000 + k, *rows[k][2:]) for k in range(50)]
    boxes = spark.createDataFrame(rows, "page string, box long, x0 double, y0 double, x1 double, y1 double")

    def held(b):
        return b[0] is not None and any(o[0] == b[0] and o[1] != b[1] and o[2] <= b[2] and o[3] <= b[3] and o[4] >= b[4] and o[5] >= b[5] and (o[2:] != b[2:] or o[1] < b[1]) for o in rows)

    free = matching.nested_boxes(boxes, ["page"], "box")
    assert sorted(map(str, map(tuple, free.collect()))) == sorted(str(b) for b in rows if not held(b))
    free.explain()
    keys = capsys.readouterr().out
    assert "_cx" in keys and "_cy" in keys and "Anti" in keys
    seq = [(g, i) for g in ("g", None) for i in [None, *rng.sample(range(5000), 200)]]
    df = spark.createDataFrame(seq, "g string, i long")
    got = chunks.numbered(df, ["g"], [F.floor(F.col("i") / 100)], ["i"], "n").collect()
    for g in ("g", None):
        want = sorted((r.i for r in got if r.g == g), key=lambda i: (i is not None, i))
        assert [r.i for r in sorted((r for r in got if r.g == g), key=lambda r: r.n)] == want and {r.n for r in got if r.g == g} == set(range(1, 202))
    rules = composites.build_rules(spark.createDataFrame([("c", f"t{k}", 200 - k, 1) for k in range(100)], "category string, text string, id long, severity long"), block=8)
    assert {r.text: r.rule_id for r in rules.collect()} == {f"t{k}": f"R-{100 - k:05d}" for k in range(100)}


def test_invariant_every_unit_is_placed_or_unaccounted(spark):
    units = spark.range(20).toDF("unit")
    placed = spark.range(0, 20, 3).toDF("unit")
    assert plans.unaccounted(units, "unit", placed).count() + placed.count() == 20


def test_plan_of_values_stays_small(spark):
    """The optimized plan names what is left of the text once a step, also under an inner explode, which adds a filter on the array."""
    df = spark.createDataFrame([("a", "Send it within 3 days")], "id string, text string")
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    outer, inner = size(facts.value_rows(df)), size(facts.with_values(df).select("id", F.explode("values")))
    assert outer < 200_000 and inner < 4 * outer


VALUES = [
    ("Look every 12 months, fortnightly, twice per year and once a week; semi-annual.", "frequency 1/2 week|frequency 2/1 year|frequency 1/1 year|frequency 2/1 year|frequency 1/1 week"),
    ("Keep it for 2-3 years, at least five business days, and no later than 4 hrs.", "duration 2 year|duration 3 year|duration >=5 business_day|deadline <=4 hour"),
    ("Signed March 2024, on 3 May 2024, May 4th, 2024, 2024-05-06 and 7.5.2024; may 2025.", "date 2024-05-03|date 2024-05-04|date 2024-05-06|date 2024-05-07|date 2024-03"),
    ("See ISO 9001, 21 CFR Part 11, 028-BIS-00493, BI-VQD-10095-S and step 3, 4 and 5.", "reference ISO 9001|reference 21 CFR PART 11|reference 028-BIS-00493|reference BI-VQD-10095-S"),
    ("At 9:05 use between 2 and 8 °C, 5 - 7 mg, >= 1,000.50 kg, max 3 L and two thousand units.", "number 09:05|number 2 °c|number 8 °c|number 5 mg|number 7 mg|number >=1000.5 kg|number <=3 L|number 2000"),
    ("Take one sample, one of them, no one, one hundred more, and less than 10 to 20 percent.", "percentage <10%|percentage <20%|number 100|number 1"),
    ("", ""), (None, ""), ("3. 1.2 item with no value", "number 1.2"),
]


def test_values_of_every_rule(spark):
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(VALUES)], "k long, text string")
    got = {r.k: "|".join(f"{v.kind} {v.normalized}" for v in r["values"]) for r in facts.with_values(df).collect()}
    assert got == {k: want for k, (_, want) in enumerate(VALUES)}


def test_roles_terms_and_quotes(spark):
    rows = [
        ("The Quality Manager and the Manager inform QA.", ["Quality Manager", "Manager", "QA"], []), ("The QA Manager signs.", ["QA Manager"], []), ("Head of Quality Control or a Lab Lead, each Reviewer.", ["Head of Quality Control", "Lab Lead", "Reviewer"], []),
        ("Use Plan of Action (PA) and the Head of Quality (HQ).", ["Head of Quality"], ["Plan of Action", "Head of Quality"]), ("Corrective (CAPA) a (b)", [], []), (None, [], []), ("Owner Manual Smith", [], []),
    ]
    df = spark.createDataFrame([(k, x) for k, (x, *_) in enumerate(rows)], "k long, s string")
    got = df.select("k", facts.roles(df.s, F.array(F.lit("QA"))).alias("r"), facts.defined_terms(df.s).alias("t")).orderBy("k").collect()
    assert [(r.r, [x.term for x in r.t]) for r in got] == [(a, b) for _, a, b in rows]
    quotes = spark.createDataFrame([("See “Code of Conduct”, \"Guide Alpha\" and \"one\" or RPAS”s",)], "s string")
    assert quotes.select(facts.quoted_names(quotes.s).alias("q")).first().q == ["Code of Conduct", "Guide Alpha"]


def test_facts_of_a_document(spark):
    df = spark.createDataFrame([("d", 1, "The Quality Assurance (QA) must approve it within 5 days."), ("d", 2, "QA signs. It will be sent."), ("d", 3, " "), ("d", 4, None)], "doc string, unit long, text string")
    got = {(r.unit, r.fact, r.kind, r.normalized) for r in preservation.extract_facts(df, ["doc"], "unit").collect()}
    assert got == {(1, "value", "deadline", "<=5 day"), (1, "term", "QA", "Quality Assurance"), (1, "role", None, "quality assurance"), (1, "obligation", "mandatory", "Quality Assurance"), (2, "role", None, "quality assurance")}

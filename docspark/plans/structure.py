"""Queries over the structure of documents: lists, sections, numbers, boxes, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import facts
from ..functions import text as t
from ..operators import chunks, matching, quality, structure
from . import inputs as i
from .registry import query
from .text import U

E = f"WITH {i.ELEMENTS}"
KINDS = ("title", "heading", "list_item", "paragraph")


@query(f"{E} SELECT doc_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS) + " FROM elements GROUP BY doc_id")
def d1_extraction_stats(spark, sf):
    return i.elements(spark, sf).groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])


@query(rf"""{E}, p AS (SELECT page_id AS doc_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages), n AS (SELECT host, count(*) AS n FROM p GROUP BY 1)
SELECT p.host, lower(text) AS form, count(DISTINCT p.doc_id) AS pages FROM elements e JOIN p ON e.doc_id = p.doc_id JOIN n ON p.host = n.host WHERE kind = 'list_item' GROUP BY p.host, lower(text), n.n HAVING count(DISTINCT p.doc_id) >= greatest(2, n.n // 2)""")
def d2_running_texts(spark, sf):
    p = i.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    n = p.groupBy("host").agg(F.count("*").alias("n"))
    rows = i.elements(spark, sf).where("kind = 'list_item'").join(p, "doc_id").join(n, "host")
    return structure.running_texts(rows, "doc_id", F.lower("text"), None, ["host", "n"], F.greatest(F.lit(2), F.floor(F.col("n") / 2))).drop("n")


@query(rf"""{U}, f AS (SELECT doc_id, lower(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[0-9]', '#', 'g')) AS form FROM units) SELECT form, count(DISTINCT doc_id) AS pages FROM f GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3""")
def d3_repeating_lines(spark, sf):
    rows = i.units(spark, sf).select("doc_id", "text")
    return structure.running_texts(rows, "doc_id", F.regexp_replace(t.norm_lower(F.col("text")), "[0-9]", "#"), None, [], F.lit(3))


SECTIONS = f"{E}, s AS (SELECT *, sum((kind = 'heading')::BIGINT) OVER (PARTITION BY doc_id ORDER BY seq)::BIGINT AS section_no FROM elements)"


def sections(spark, sf):
    return structure.section_of(i.elements(spark, sf), F.col("kind") == "heading", ["doc_id"], ["seq"])


@query(f"""{SECTIONS} SELECT doc_id, seq, 'SRC-S' || lpad(section_no::VARCHAR, greatest(2, length(section_no::VARCHAR))::INT, '0') || '-U' || lpad(row_number() OVER (PARTITION BY doc_id, section_no ORDER BY seq)::VARCHAR, 3, '0') AS unit_id,
row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS seq_no FROM s""")
def e3_unit_ids(spark, sf):
    return structure.unit_ids(sections(spark, sf), ["doc_id"], "section_no", ["seq"]).select("doc_id", "seq", "unit_id", "seq_no")


@query(f"{U} SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id, lower(text) ORDER BY seq) AS occurrence FROM units")
def e4_dup_occurrence(spark, sf):
    return structure.duplicate_occurrence(i.units(spark, sf), ["doc_id"], F.lower("text"), ["seq"]).select("doc_id", "seq", "occurrence")


@query(f"""{E}, f AS (SELECT *, kind = 'list_item' AS x, kind = 'list_item' AND NOT coalesce(lag(kind = 'list_item') OVER (PARTITION BY doc_id ORDER BY seq), false) AS b FROM elements),
n AS (SELECT *, CASE WHEN x THEN sum(b::BIGINT) OVER (PARTITION BY doc_id ORDER BY seq) END AS island FROM f) SELECT doc_id, island::BIGINT AS island, count(*) AS n_items, min(seq) AS first_seq FROM n WHERE x GROUP BY 1, 2""")
def e6_list_islands(spark, sf):
    rows = structure.islands(i.elements(spark, sf), F.col("kind") == "list_item", ["doc_id"], ["seq"]).where("island is not null")
    return rows.groupBy("doc_id", "island").agg(F.count("*").alias("n_items"), F.min("seq").alias("first_seq"))


@query(rf"""{U}, m AS (SELECT doc_id, seq, text, sum((NOT regexp_matches(text, '^[\p{{Ll}}),;]') OR first)::BIGINT) OVER (PARTITION BY doc_id ORDER BY seq)::BIGINT AS part FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1 AS first FROM units))
SELECT doc_id, part, count(*) AS n_parts, sha256(string_agg(text, ' ' ORDER BY seq)) AS digest FROM m GROUP BY 1, 2""")
def e7_merge_continuations(spark, sf):
    rows = structure.merge_continuations(i.units(spark, sf).select("doc_id", "seq", "text"), ~F.col("text").rlike(r"^[\p{Ll}),;]"), ["doc_id"], ["seq"])
    return rows.select("doc_id", "part", "n_parts", F.sha2("text", 256).alias("digest"))


HEADINGS = f"{U}, h AS (SELECT doc_id, seq, (length(text) % 4 + 1)::INT AS level FROM units WHERE length(text) % 3 <> 0)"


def headings(spark, sf):
    n = F.char_length("text")
    return i.units(spark, sf).where(n % 3 != 0).select("doc_id", "seq", (n % 4 + 1).cast("int").alias("level"))


@query(f"{HEADINGS} SELECT doc_id, seq, level, (SELECT max(p.seq) FROM h p WHERE p.doc_id = h.doc_id AND p.seq < h.seq AND p.level < h.level) AS parent FROM h")
def e5_section_parent(spark, sf):
    return chunks.section_parent(headings(spark, sf), ["doc_id"], "seq", "level", 4)


@query(f"""{HEADINGS}, {', '.join(f'x{j} AS (SELECT *, sum((level < {j})::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS z{j} FROM {"h" if j == 1 else f"x{j - 1}"})' for j in range(1, 5))},
c AS (SELECT *, {', '.join(f'greatest(1, sum((level = {j})::INT) OVER (PARTITION BY doc_id, z{j} ORDER BY seq))::BIGINT AS c{j}' for j in range(1, 5))} FROM x4)
SELECT doc_id, seq, level, array_to_string([c1, c2, c3, c4][1:level], '.') AS number FROM c""")
def e17_hierarchical_numbers(spark, sf):
    return chunks.hierarchical_numbers(headings(spark, sf), ["doc_id"], "seq", "level", 4)


@query(f"""{E}, r AS (SELECT *, sum((kind <> 'list_item')::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM elements), f AS (SELECT doc_id, run, first(CASE WHEN kind <> 'list_item' AND length(text) > 20 THEN text END ORDER BY seq) AS lead FROM r GROUP BY 1, 2)
SELECT r.doc_id, r.seq, f.lead AS inherited FROM r JOIN f USING (doc_id, run) WHERE kind = 'list_item'""")
def e15_intro_inheritance(spark, sf):
    item = F.col("kind") == "list_item"
    rows = structure.intro_inheritance(i.elements(spark, sf), item, F.char_length("text") > 20, "text", ["doc_id"], ["seq"])
    return rows.where(item).select("doc_id", "seq", "inherited")


@query(f"""{E} SELECT doc_id, seq, coalesce(b, a) AS target, CASE WHEN b IS NOT NULL THEN 'before' WHEN a IS NOT NULL THEN 'after' END AS side FROM (SELECT *,
(SELECT max(o.seq) FROM elements o WHERE o.doc_id = e.doc_id AND o.seq < e.seq AND o.kind = 'paragraph' AND length(o.text) > 40) AS b, (SELECT min(o.seq) FROM elements o WHERE o.doc_id = e.doc_id AND o.seq > e.seq AND o.kind = 'paragraph' AND length(o.text) > 40) AS a FROM elements e WHERE kind = 'list_item')""")
def c18_nearest_unit_link(spark, sf):
    rows = matching.nearest_link(i.elements(spark, sf), F.col("kind") == "list_item", (F.col("kind") == "paragraph") & (F.char_length("text") > 40), "seq", ["doc_id"], ["seq"])
    return rows.select("doc_id", "seq", "target", "side")


BOXES = "b AS (SELECT l_suppkey AS page, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS box, (l_partkey % 97)::DOUBLE AS x0, (l_orderkey % 89)::DOUBLE AS y0, (l_partkey % 97 + l_quantity)::DOUBLE AS x1, (l_orderkey % 89 + l_discount * 300)::DOUBLE AS y1 FROM lineitem)"


def boxes(spark, sf):
    li = i.table(spark, sf, "lineitem")
    x, y = (F.col("l_partkey") % 97).cast("double"), (F.col("l_orderkey") % 89).cast("double")
    return li.select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("box"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity")).alias("x1"), (y + F.col("l_discount") * 300).alias("y1"))


@query(f"WITH {BOXES}, p AS (SELECT s_suppkey AS page, k AS point, (k * 13 % 140)::DOUBLE AS x, (k * 29 % 120)::DOUBLE AS y FROM supplier, range(1, 21) r(k)) SELECT p.page, point, count(*) AS n_boxes, min(box) AS first_box FROM p JOIN b ON p.page = b.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL")
def c10_point_in_cell(spark, sf):
    p = i.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(20).cast("long"))).alias("point"))
    p = p.withColumn("x", (F.col("point") * 13 % 140).cast("double")).withColumn("y", (F.col("point") * 29 % 120).cast("double"))
    return matching.point_in_box(p, boxes(spark, sf), ["page"], 25.0).groupBy("page", "point").agg(F.count("*").alias("n_boxes"), F.min("box").alias("first_box"))


@query(f"WITH {BOXES} SELECT page, box FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.page = b.page AND o.box <> b.box AND o.x0 <= b.x0 AND o.y0 <= b.y0 AND o.x1 >= b.x1 AND o.y1 >= b.y1 AND (NOT (o.x0 = b.x0 AND o.y0 = b.y0 AND o.x1 = b.x1 AND o.y1 = b.y1) OR o.box < b.box))")
def c11_nested_box_filter(spark, sf):
    return matching.nested_boxes(boxes(spark, sf), ["page"], "box").select("page", "box")


@query(f"{U}, c AS (SELECT doc_id, seq, (length(text) // 4 + 1)::BIGINT AS cost, sum(length(text) // 4 + 1) OVER (PARTITION BY doc_id ORDER BY seq)::BIGINT AS used FROM units) SELECT doc_id, seq, used FROM c WHERE used <= 200")
def f5_budget_prefix(spark, sf):
    return quality.budget_prefix(i.units(spark, sf), ["doc_id"], ["seq"], t.estimate_tokens(F.col("text")), 200).select("doc_id", "seq", "used")


@query(f"{U}, n AS (SELECT source, lang, count(*) AS n FROM units GROUP BY ALL), s AS (SELECT source, lang, n / sum(n) OVER (PARTITION BY source) AS share FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY share DESC, lang) AS k FROM s) SELECT source, lang, share, k AS place FROM r WHERE k <= 3 AND share >= 0.05")
def f3_top_labels(spark, sf):
    n = i.units(spark, sf).groupBy("source", "lang").agg(F.count("*").alias("n"))
    s = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("source"))).drop("n")
    return s.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy(F.desc("share"), "lang")).cast("long")).where("place <= 3 and share >= 0.05")


@query(f"""{SECTIONS}, b AS (SELECT doc_id, section_no, bool_or(kind = 'heading' AND regexp_matches(text, '(?i)history|approval|the')) AS hit FROM s GROUP BY ALL) SELECT s.doc_id, s.seq, s.section_no = 0 OR b.hit AS boilerplate FROM s JOIN b USING (doc_id, section_no)""")
def b4_flag_boilerplate(spark, sf):
    rows = sections(spark, sf)
    hit = F.max((F.col("kind") == "heading") & F.col("text").rlike("(?i)history|approval|the")).over(W.partitionBy("doc_id", "section_no"))
    return rows.select("doc_id", "seq", ((F.col("section_no") == 0) | hit).alias("boilerplate"))


@query(f"{SECTIONS} SELECT doc_id, section_no, count(*) AS n, count(*) FILTER (kind = 'list_item') AS n_items, sum(length(text))::BIGINT AS n_chars, first(text ORDER BY seq) AS heading FROM s WHERE section_no > 0 GROUP BY ALL")
def d24_section_summary(spark, sf):
    rows = sections(spark, sf).where("section_no > 0")
    return rows.groupBy("doc_id", "section_no").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "list_item").alias("n_items"), F.sum(F.char_length("text")).alias("n_chars"), F.min_by("text", "seq").alias("heading"))


@query(f"{SECTIONS}, g AS (SELECT doc_id, max(section_no) AS n_sections, count(*) FILTER (section_no > 0 AND kind <> 'heading') AS n_body FROM s GROUP BY 1) SELECT *, CASE WHEN n_sections = 0 THEN 'fail' WHEN n_body < 3 THEN 'warn' ELSE 'pass' END AS status FROM g")
def d29_structure_check(spark, sf):
    g = sections(spark, sf).groupBy("doc_id").agg(F.max("section_no").alias("n_sections"), F.count_if((F.col("section_no") > 0) & (F.col("kind") != "heading")).alias("n_body"))
    return g.withColumn("status", F.when(F.col("n_sections") == 0, "fail").when(F.col("n_body") < 3, "warn").otherwise("pass"))


TF = rf"""{U}, w AS (SELECT doc_id, seq, w, count(*) AS tf FROM (SELECT doc_id, seq, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS w FROM units) GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n FROM units GROUP BY 1),
d AS (SELECT doc_id, w, count(*) AS df FROM w GROUP BY ALL), x AS (SELECT doc_id, seq, w, tf * (ln((1 + n) / (1 + df)) + 1) AS v FROM w JOIN d USING (doc_id, w) JOIN n USING (doc_id)),
k AS (SELECT doc_id, seq, sqrt(sum(v * v)) AS norm FROM x GROUP BY ALL), l AS (SELECT doc_id, seq, lead(seq) OVER (PARTITION BY doc_id ORDER BY seq) AS nxt FROM units),
p AS (SELECT a.doc_id, a.seq, sum(a.v * b.v) AS dot FROM x a JOIN l ON a.doc_id = l.doc_id AND a.seq = l.seq JOIN x b ON b.doc_id = a.doc_id AND b.seq = l.nxt AND a.w = b.w GROUP BY ALL)"""


@query(f"{TF} SELECT l.doc_id, l.seq, round(coalesce(dot / (ka.norm * kb.norm), 0), 6) AS cosine FROM l LEFT JOIN p USING (doc_id, seq) LEFT JOIN k ka ON ka.doc_id = l.doc_id AND ka.seq = l.seq LEFT JOIN k kb ON kb.doc_id = l.doc_id AND kb.seq = l.nxt WHERE l.nxt IS NOT NULL")
def d13_tfidf_adjacent(spark, sf):
    return chunks.tfidf_adjacent(i.units(spark, sf), "doc_id", "seq").withColumn("cosine", F.round("cosine", 6))


ROWS = f"{U.replace('WITH ', 'WITH RECURSIVE ', 1)}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM units)"


@query(f"""{ROWS}, v AS (SELECT doc_id, k, seq, 1 AS block, length(text) // 4 + 1 AS used FROM r WHERE k = 1 UNION ALL
  SELECT r.doc_id, r.k, r.seq, CASE WHEN used + length(text) // 4 + 1 > 300 THEN block + 1 ELSE block END, CASE WHEN used + length(text) // 4 + 1 > 300 THEN 0 ELSE used END + length(text) // 4 + 1 FROM v JOIN r ON r.doc_id = v.doc_id AND r.k = v.k + 1)
SELECT doc_id, seq, block FROM v""")
def d22_pack_blocks(spark, sf):
    rows = i.units(spark, sf).select("doc_id", "seq", t.estimate_tokens(F.col("text")).alias("cost"))
    return chunks.pack_blocks(rows, ["doc_id"], "seq", "cost", 300)


@query("""WITH RECURSIVE x AS (SELECT DISTINCT l_orderkey AS text_id, (l_partkey % 50)::INT AS s, (l_partkey % 50 + l_quantity)::INT AS e FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY s, e DESC) AS k FROM x),
v AS (SELECT text_id, k, s, e, e AS last, true AS taken FROM r WHERE k = 1 UNION ALL SELECT r.text_id, r.k, r.s, r.e, CASE WHEN r.s >= last THEN r.e ELSE last END, r.s >= last FROM v JOIN r ON r.text_id = v.text_id AND r.k = v.k + 1)
SELECT text_id, s AS "start", e AS "end" FROM v WHERE taken""")
def e22_non_overlapping(spark, sf):
    li = i.table(spark, sf, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("text_id"), (F.col("l_partkey") % 50).cast("int").alias("start"), (F.col("l_partkey") % 50 + F.col("l_quantity")).cast("int").alias("end"))
    return chunks.non_overlapping(rows, ["text_id"])


# Facts over sentences made of orders and line items.
DATES = "SELECT o_orderkey AS unit_id, 'date' AS kind, strftime(o_orderdate, '%Y-%m-%d') AS normalized FROM orders"


@query(DATES)
def h4_dates(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "d MMMM yyyy")).when(k == 1, F.date_format(d, "MMM d, yyyy")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd.MM.yyyy"))
    rows = i.table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), F.concat(F.lit("It was signed on "), text, F.lit(" by all")).alias("text"))
    return facts.value_rows(rows).select("unit_id", "v.kind", "v.normalized")


Q = "l_quantity::BIGINT"


@query(f"""SELECT l_orderkey AS unit_id, 'deadline' AS kind, '<=' || {Q} || ' business_day' AS normalized FROM lineitem WHERE l_linenumber = 1
UNION ALL SELECT l_orderkey, 'duration', '>=' || {Q} || ' month' FROM lineitem WHERE l_linenumber = 2
UNION ALL SELECT l_orderkey, 'frequency', CASE {Q} WHEN 3 THEN '1/1 quarter' WHEN 12 THEN '1/1 year' ELSE '1/' || {Q} || ' month' END FROM lineitem WHERE l_linenumber = 3
UNION ALL SELECT l_orderkey, 'percentage', {Q} || '%' FROM lineitem WHERE l_linenumber = 4 UNION ALL SELECT l_orderkey, 'number', '<=' || {Q} || ' mg' FROM lineitem WHERE l_linenumber = 5
UNION ALL SELECT l_orderkey, 'frequency', '2/1 week' FROM lineitem WHERE l_linenumber = 6 UNION ALL SELECT l_orderkey, 'reference', 'SOP-QA-' || {Q} FROM lineitem WHERE l_linenumber = 7""")
def k2_extract_facts(spark, sf):
    q, n = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber")
    say = lambda a, b: F.concat(F.lit(a), q, F.lit(b))
    text = F.when(n == 1, say("Send it within ", " working days.")).when(n == 2, say("Keep it at least ", " months here")).when(n == 3, say("Look every ", " months at it")).when(n == 4, say("Take ", " % of it")).when(n == 5, say("Use up to ", " mg only")).when(n == 6, F.lit("Twice a week, see step 4.2")).otherwise(say("See SOP-QA-", " there"))
    rows = i.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id"), text.alias("text"))
    return facts.value_rows(rows, repeated=True).select("unit_id", "v.kind", "v.normalized")


@query("SELECT l_orderkey AS unit_id, l_linenumber AS n, l_quantity::INT AS value FROM lineitem")
def h10_words_to_number(spark, sf):
    q = F.col("l_quantity").cast("int")
    ones, tens = F.array(*map(F.lit, facts.ONES)), F.array(*map(F.lit, facts.TENS))
    word = F.when(q < 20, F.element_at(ones, q + 1)).when(q % 10 == 0, F.element_at(tens, (q / 10).cast("int") - 1)).otherwise(F.concat(F.element_at(tens, (q / 10).cast("int") - 1), F.lit("-"), F.element_at(ones, q % 10 + 1)))
    return i.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("n"), facts.word_value(word).alias("value"))


@query("""SELECT p_partkey AS unit_id, ['prohibition', 'recommended', 'mandatory', 'permitted', 'future', ''][p_partkey % 6 + 1] AS modality FROM part""")
def h13_modalities(spark, sf):
    said = F.array(*map(F.lit, ("must not be used", "should be kept", "shall be cleaned if needed", "can be opened", "will be sent", "can be found here, as required")))
    rows = i.table(spark, sf, "part").select(F.col("p_partkey").alias("unit_id"), F.concat(F.lit("The "), F.col("p_name"), F.lit(" "), F.element_at(said, (F.col("p_partkey") % 6 + 1).cast("int"))).alias("text"))
    return rows.select("unit_id", F.array_join(facts.modalities(F.col("text")), ",").alias("modality"))


# Lines as torn paragraphs: some open a bracket that a later one closes, some end with a hyphen or begin with a mark.
TORN = """t AS (SELECT doc_id, seq, k, CASE WHEN seq % 13 = 0 THEN '[Icon: x] ' ELSE '' END || CASE seq % 7 WHEN 0 THEN '(see ' WHEN 2 THEN 'there) ' ELSE '' END || trim(CASE WHEN seq % 3 = 0 THEN lower(text) ELSE text END) || CASE WHEN seq % 11 = 0 THEN '-' ELSE '' END AS p FROM r),
q AS (SELECT *, length(p) - length(translate(p, '([{', '')) - length(p) + length(translate(p, ')]}', '')) AS br, starts_with(ltrim(p), '[Icon:') AS mark FROM t)"""


@query(rf"""{ROWS}, {TORN}, v AS (SELECT doc_id, k, seq, p, 1 AS grp, br AS open, mark, p AS last FROM q WHERE k = 1 UNION ALL
  SELECT doc_id, k, seq, p, CASE WHEN joins THEN grp ELSE grp + 1 END, CASE WHEN joins THEN open ELSE 0 END + br, CASE WHEN joins THEN smark ELSE mark END, p FROM (SELECT q.*, v.grp, v.open, v.mark AS smark,
    v.last <> '' AND q.p <> '' AND (q.mark OR v.mark OR v.open > 0 OR right(v.last, 1) = '-' OR (right(v.last, 1) NOT IN ('.', '!', '?', ':') AND regexp_matches(q.p, '^[\p{{Ll}})\]}}»]'))) AS joins FROM v JOIN q ON q.doc_id = v.doc_id AND q.k = v.k + 1))
SELECT doc_id, min(seq) AS first, count(*) AS n, md5(string_agg(p, ' ' ORDER BY seq)) AS digest FROM v GROUP BY doc_id, grp""")
def e8_merge_paragraphs(spark, sf):
    seq = F.col("seq")
    p = F.concat(F.when(seq % 13 == 0, "[Icon: x] ").otherwise(""), F.when(seq % 7 == 0, "(see ").when(seq % 7 == 2, "there) ").otherwise(""), F.trim(F.when(seq % 3 == 0, F.lower("text")).otherwise(F.col("text"))), F.when(seq % 11 == 0, "-").otherwise(""))
    rows = i.units(spark, sf).select("doc_id", "seq", p.alias("text"))
    return chunks.merge_paragraphs(rows, ["doc_id"], "seq").select("doc_id", "first", "n", F.md5("text").alias("digest"))

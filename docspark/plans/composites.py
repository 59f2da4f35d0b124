"""Queries of composite operators and the rest of the checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import facts
from ..functions import text as t
from ..operators import composites as k
from ..operators import structure
from . import inputs as i
from .registry import query
from .text import U

E = f"WITH {i.ELEMENTS}"
S = f"WITH {i.SEGMENTS}"
PLACEHOLDER = r"\[TBD\]|\bTBC\b|\bXXX\b|###|\*\*\*|%%%|&&&"


@query(rf"""{S} SELECT job_id, segment_id, CASE WHEN regexp_matches(source_text, '{PLACEHOLDER}') THEN 'medium' ELSE 'high' END AS severity FROM segments WHERE regexp_matches(coalesce(target_text, ''), '{PLACEHOLDER}')""")
def b13_placeholder_check(spark, sf):
    return k.placeholder_issues(i.segments(spark, sf), PLACEHOLDER).select("job_id", "segment_id", "severity")


@query(f"{E}, s AS (SELECT *, sum((kind = 'heading')::BIGINT) OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM elements) SELECT doc_id, seq, text FROM s WHERE n > 0 AND text <> '' AND kind <> 'title' AND NOT regexp_matches(text, '^[0-9]+$')")
def b5_protected_units(spark, sf):
    rows = structure.section_of(i.elements(spark, sf), F.col("kind") == "heading", ["doc_id"], ["seq"])
    return k.protected_units(rows).select("doc_id", "seq", "text")


@query("""WITH r AS (SELECT p_partkey AS rule_id, CASE p_partkey % 4 WHEN 0 THEN 'max_words' WHEN 1 THEN 'forbidden' WHEN 2 THEN 'color' ELSE 'other' END AS kind, CASE WHEN p_size % 5 = 0 THEN 'abc' ELSE p_size::VARCHAR END AS value, p_name AS cited FROM part)
SELECT rule_id, CASE WHEN kind = 'other' THEN 'unknown kind' WHEN kind = 'max_words' AND try_cast(value AS INT) IS NULL THEN 'not a number' WHEN kind = 'max_words' AND try_cast(value AS INT) < 5 THEN 'out of range'
WHEN kind IN ('forbidden', 'color') AND NOT contains(cited, value) THEN 'not grounded' END AS problem FROM r WHERE problem IS NOT NULL""")
def b16_params_check(spark, sf):
    n = F.col("p_partkey") % 4
    kind = F.when(n == 0, "max_words").when(n == 1, "forbidden").when(n == 2, "color").otherwise("other")
    rules = i.table(spark, sf, "part").select(F.col("p_partkey").alias("rule_id"), kind.alias("kind"), F.when(F.col("p_size") % 5 == 0, "abc").otherwise(F.col("p_size").cast("string")).alias("value"), F.col("p_name").alias("cited"))
    return k.params_problems(rules).select("rule_id", "problem")


CELLS = "c AS (SELECT l_orderkey AS tab, l_linenumber AS r, min(substr(md5((l_partkey % 5)::VARCHAR), 1, 6)) AS hex, min(l_partkey % 4) AS g FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {CELLS}, x AS (SELECT *, CASE WHEN g < 2 THEN 'B4B4B4' ELSE upper(hex) END AS fill FROM c), y AS (SELECT *, substr(fill, 1, 2) = substr(fill, 3, 2) AND substr(fill, 3, 2) = substr(fill, 5, 2) AND substr(fill, 1, 2) >= 'A0' AS grey FROM x)
SELECT tab, r, CASE WHEN grey OR r = 1 OR (bool_and(grey) OVER (PARTITION BY tab)) THEN NULL ELSE fill END AS fill FROM y""")
def b17_uniform_grey_drop(spark, sf):
    li = i.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("tab"), F.col("l_linenumber").alias("r")).agg(F.min(F.substring(F.md5((F.col("l_partkey") % 5).cast("string")), 1, 6)).alias("hex"), F.min(F.col("l_partkey") % 4).alias("g"))
    cells = li.withColumn("fill", F.when(F.col("g") < 2, "B4B4B4").otherwise(F.upper("hex")))
    return k.kept_fills(cells, ["tab"], "fill", F.col("r") == 1).select("tab", "r", "fill")


@query("""WITH u AS (SELECT l_suppkey AS section, l_partkey % 3 AS lab, l_quantity AS w FROM lineitem WHERE l_returnflag <> 'R'), n AS (SELECT section, count(*) AS n FROM u GROUP BY 1)
SELECT section, 'L' || lab AS label, round(sum(w) / any_value(n), 3) AS weight FROM u JOIN n USING (section) GROUP BY 1, 2""")
def d11_label_profile(spark, sf):
    li = i.table(spark, sf, "lineitem").where("l_returnflag <> 'R'")
    units = li.select(F.col("l_suppkey").alias("section"), F.create_map(F.concat(F.lit("L"), (F.col("l_partkey") % 3).cast("string")), F.col("l_quantity")).alias("labels"))
    return k.label_profile(units, "section", "labels").withColumn("weight", F.round("weight", 3))


@query("SELECT l_orderkey AS tab, avg((l_returnflag IN ('R', 'A'))::INT) AS share, count(*) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY 1")
def d28_raci_share(spark, sf):
    return k.raci_share(i.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tab"), F.col("l_linenumber").alias("col"), F.col("l_returnflag").alias("text")), ["tab"])


@query("""WITH a AS (SELECT n_nationkey AS template, count(s_suppkey) AS n_anchors, count(*) FILTER (s_acctbal < 0) AS n_blocking, count(*) FILTER (s_acctbal BETWEEN 0 AND 1000) AS n_warn FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
SELECT *, CASE WHEN n_anchors = 0 OR n_blocking > 0 THEN 'blocked' WHEN n_warn > 0 THEN 'warning' ELSE 'ready' END AS status FROM a""")
def d31_readiness(spark, sf):
    anchors = i.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("template"), F.when(F.col("s_acctbal") < 0, "blocking").when(F.col("s_acctbal") <= 1000, "warning").otherwise("ok").alias("state"))
    return k.readiness(i.table(spark, sf, "nation").select(F.col("n_nationkey").alias("template")), anchors, "template")


@query(f"""{E}, f AS (SELECT *, kind = 'list_item' AS x, kind = 'list_item' AND NOT coalesce(lag(kind = 'list_item') OVER (PARTITION BY doc_id ORDER BY seq), false) AS b FROM elements), n AS (SELECT *, sum(b::BIGINT) OVER (PARTITION BY doc_id ORDER BY seq)::BIGINT AS island FROM f)
SELECT doc_id, island, regexp_matches(first(text ORDER BY seq), '^[0-9a-z]') AS ordered, max(length(text) - length(replace(text, ' ', ''))) AS depth FROM n WHERE x GROUP BY 1, 2""")
def d32_list_type(spark, sf):
    rows = structure.islands(i.elements(spark, sf), F.col("kind") == "list_item", ["doc_id"], ["seq"]).where("island is not null")
    depth = F.max(F.char_length("text") - F.char_length(F.replace("text", F.lit(" "), F.lit(""))))
    return rows.groupBy("doc_id", "island").agg(F.min_by("text", "seq").rlike("^[0-9a-z]").alias("ordered"), depth.alias("depth"))


@query(f"""WITH {i.RECORDS}, l AS (SELECT document_uid, max(version) AS v, count(*) FILTER (status = 'P') AS open FROM records GROUP BY 1)
SELECT c_custkey AS document_uid, array_to_string(list_filter([CASE WHEN v IS NULL THEN 'no output' END, CASE WHEN v % 3 = 0 THEN 'outdated output' END, CASE WHEN open > 0 THEN 'open gate' END], lambda x: x IS NOT NULL), '; ') AS blockers FROM customer LEFT JOIN l ON c_custkey = document_uid""")
def d34_approval_blockers(spark, sf):
    l = i.records(spark, sf).groupBy("document_uid").agg(F.max("version").alias("v"), F.count_if(F.col("status") == "P").alias("open"))  # noqa: E741
    jobs = i.table(spark, sf, "customer").select(F.col("c_custkey").alias("document_uid")).join(l, "document_uid", "left")
    return k.blockers(jobs, {"no output": F.col("v").isNull(), "outdated output": F.col("v") % 3 == 0, "open gate": F.col("open") > 0}).select("document_uid", "blockers")


@query(rf"""{E}, n AS (SELECT *, lead(kind) OVER w AS nk, lead(seq) OVER w AS ns, lag(kind) OVER w AS pk, lag(seq) OVER w AS ps FROM elements WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) SELECT doc_id, seq AS caption, CASE WHEN pk = 'heading' THEN ps WHEN nk = 'heading' THEN ns END AS owner FROM n WHERE kind = 'paragraph' AND (pk = 'heading' OR nk = 'heading')""")
def e14_attach_captions(spark, sf):
    return k.attach(i.elements(spark, sf), F.col("kind") == "paragraph", F.col("kind") == "heading", ["doc_id"], "seq").select("doc_id", F.col("seq").alias("caption"), "owner")


ROWS = "x AS (SELECT l_orderkey AS tab, l_linenumber AS r, string_agg(CASE WHEN l_quantity > 15 THEN l_returnflag ELSE '' END, '' ORDER BY l_partkey, l_suppkey) AS first, min(l_partkey)::VARCHAR AS body FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {ROWS}, p AS (SELECT *, sum((first <> '' OR n = 1)::BIGINT) OVER (PARTITION BY tab ORDER BY r)::BIGINT AS part FROM (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY r) AS n FROM x))
SELECT tab, part, min(r) AS r, count(*) AS n_rows, string_agg(body, ' ' ORDER BY r) AS body FROM p GROUP BY 1, 2""")
def e11_continuation_rows(spark, sf):
    li = i.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tab"), F.col("l_linenumber").alias("r"), F.when(F.col("l_quantity") > 15, F.col("l_returnflag")).otherwise("").alias("f"), "l_partkey")
    rows = li.groupBy("tab", "r").agg(F.max("f").alias("first"), F.min("l_partkey").cast("string").alias("body"))
    return k.continuation_rows(rows, ["tab"], "r", "first", "body")


@query(f"""{E}, h AS (SELECT *, sum((kind = 'heading')::BIGINT) OVER (PARTITION BY doc_id ORDER BY seq)::BIGINT AS section_no FROM elements)
SELECT doc_id, section_no, sha256(string_agg(CASE WHEN kind = 'list_item' THEN '- ' || text ELSE text END, chr(10) ORDER BY seq)) AS digest, count(*) AS n_units,
CASE WHEN bool_and(kind IN ('list_item', 'heading')) THEN 'list' WHEN bool_or(kind = 'list_item') THEN 'mixed' ELSE 'text' END AS chunk_type FROM h WHERE kind <> 'title' GROUP BY 1, 2""")
def e9_hier_chunks(spark, sf):
    rows = structure.section_of(i.elements(spark, sf), F.col("kind") == "heading", ["doc_id"], ["seq"]).where("kind <> 'title'")
    return k.section_chunks(rows, ["doc_id", "section_no"], "seq").select("doc_id", "section_no", F.sha2("content", 256).alias("digest"), "n_units", "chunk_type")


@query(rf"""{U}, x AS (SELECT doc_id, seq, text, regexp_extract_all(text, '\(([\p{{Lu}}][\p{{L}}]*)\)', 1) AS a FROM units) SELECT doc_id, seq, unnest(a) AS abbr FROM x""")
def h16_abbreviations(spark, sf):
    return i.units(spark, sf).select("doc_id", "seq", F.explode(t.extract(F.col("text"), r"\(([\p{Lu}][\p{L}]*)\)", 1)).alias("abbr"))


@query(r"""WITH p AS (SELECT p_partkey AS unit_id, 'See ' || ['section 4.2', 'step 7', 'Figure 3', 'Appendix 1', 'the text'][(p_partkey % 5 + 1)::INT] || ' and item ' || p_size AS text FROM part)
SELECT unit_id, unnest(regexp_extract_all(text, '(?i)\b(?:section|step|figure|appendix|item)\s+[0-9]+(?:\.[0-9]+)*')) AS phrase FROM p""")
def h19_xref_phrases(spark, sf):
    said = F.array(*map(F.lit, ("section 4.2", "step 7", "Figure 3", "Appendix 1", "the text")))
    rows = i.table(spark, sf, "part").select(F.col("p_partkey").alias("unit_id"), F.concat(F.lit("See "), F.element_at(said, (F.col("p_partkey") % 5 + 1).cast("int")), F.lit(" and item "), F.col("p_size").cast("string")).alias("text"))
    return rows.select("unit_id", F.explode(k.xref_phrases(F.col("text"))).alias("phrase"))


@query(rf"""{U}, g AS (SELECT doc_id, seq, regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM units) SELECT doc_id, sum(greatest(len(w) - 1, 0))::BIGINT AS n2, sum(greatest(len(w) - 2, 0))::BIGINT AS n3, sum(greatest(len(w) - 3, 0))::BIGINT AS n4 FROM g GROUP BY 1""")
def h53_phrase_grams(spark, sf):
    n = F.size(t.words(F.col("text")))
    rows = i.units(spark, sf).select("doc_id", *[F.greatest(n - j, F.lit(0)).alias(f"n{j + 1}") for j in (1, 2, 3)])
    return rows.groupBy("doc_id").agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in (2, 3, 4)])


@query(f"{S} SELECT job_id, segment_id, trim(source_text) = trim(coalesce(target_text, '')) AS same, length(source_text) - length(replace(source_text, chr(10), '')) AS breaks, length(coalesce(target_text, '')) - length(replace(coalesce(target_text, ''), chr(10), '')) AS target_breaks FROM segments")
def h42_line_breaks(spark, sf):
    g = F.coalesce("target_text", F.lit(""))
    count = lambda c: F.char_length(c) - F.char_length(F.translate(c, "\n", ""))
    return i.segments(spark, sf).select("job_id", "segment_id", (F.trim("source_text") == F.trim(g)).alias("same"), count(F.col("source_text")).alias("breaks"), count(g).alias("target_breaks"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.' || json_keys(props)[1]) AS VARCHAR) AS first_value, len(json_keys(props)) AS n_keys FROM events""")
def h57_json_detail(spark, sf):
    return k.json_detail(i.table(spark, sf, "events"), "event_id", "props")


@query("""SELECT r_name || '/' || n_name AS heading, CASE WHEN regexp_matches(lower(n_name), 'united|kingdom') THEN 'scope' WHEN regexp_matches(lower(n_name), 'ia$') THEN 'definition' WHEN regexp_matches(lower(r_name), 'asia') THEN 'reference' ELSE 'paragraph' END AS content_type,
upper(regexp_replace(n_name, '[^A-Za-z]+', '_', 'g')) AS section_key FROM nation JOIN region ON n_regionkey = r_regionkey""")
def h59_content_type(spark, sf):
    n = i.table(spark, sf, "nation").join(i.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kind = k.first_match([(F.lower("n_name").rlike("united|kingdom"), "scope"), (F.lower("n_name").rlike("ia$"), "definition"), (F.lower("r_name").rlike("asia"), "reference")], "paragraph")
    return n.select(F.concat_ws("/", "r_name", "n_name").alias("heading"), kind.alias("content_type"), F.upper(F.regexp_replace("n_name", "[^A-Za-z]+", "_")).alias("section_key"))


@query(f"""{S}, x AS (SELECT job_id, count(*) AS n, count(target_text) AS done, count(*) FILTER (trim(coalesce(target_text, '')) = '') AS empty FROM segments GROUP BY 1)
SELECT job_id, 'coverage' AS check_name, CASE WHEN done = n THEN 'pass' WHEN 2 * done >= n THEN 'warn' ELSE 'fail' END AS verdict FROM x UNION ALL SELECT job_id, 'empty', CASE WHEN empty = 0 THEN 'pass' ELSE 'warn' END FROM x""")
def k20_inspect(spark, sf):
    x = i.segments(spark, sf).groupBy("job_id").agg(F.count("*").alias("n"), F.count("target_text").alias("done"), F.count_if(F.trim(F.coalesce("target_text", F.lit(""))) == "").alias("empty"))
    checks = {"coverage": F.when(F.col("done") == F.col("n"), "pass").when(2 * F.col("done") >= F.col("n"), "warn").otherwise("fail"), "empty": F.when(F.col("empty") == 0, "pass").otherwise("warn")}
    return k.verdicts(x, "job_id", checks)


@query("""WITH r AS (SELECT p_partkey AS id, lower(p_name) AS text, p_brand AS category, p_size AS severity FROM part), g AS (SELECT category, text, min(id) AS first_id, max(severity) AS severity, count(*) AS n FROM r WHERE severity > 3 GROUP BY 1, 2)
SELECT category, text, severity, n, 'R-' || lpad(row_number() OVER (ORDER BY first_id)::VARCHAR, 5, '0') AS rule_id FROM g""")
def k22_build_rules(spark, sf):
    rows = i.table(spark, sf, "part").where("p_size > 3").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("text"), F.col("p_brand").alias("category"), F.col("p_size").alias("severity"))
    return k.build_rules(rows)


@query(f"""{E}, s AS (SELECT *, sum((kind = 'heading')::BIGINT) OVER (PARTITION BY doc_id ORDER BY seq)::BIGINT AS section_no FROM elements)
SELECT doc_id, 'SRC-S' || lpad(section_no::VARCHAR, 2, '0') AS section_id, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY seq) AS n, kind AS unit_type,
substr(sha256(doc_id::VARCHAR || '|' || lower(text)), 1, 16) AS content_hash, row_number() OVER (PARTITION BY doc_id, section_no, lower(text) ORDER BY seq) AS occurrence FROM s WHERE text <> ''""")
def k1_build_units(spark, sf):
    rows = structure.section_of(i.elements(spark, sf), F.col("kind") == "heading", ["doc_id"], ["seq"]).where("text <> ''")
    named = structure.duplicate_occurrence(structure.unit_ids(rows, ["doc_id"], "section_no", ["seq"]), ["doc_id", "section_no"], F.lower("text"), ["seq"])
    n = F.regexp_extract("unit_id", "-U([0-9]+)$", 1).cast("long")
    return named.select("doc_id", "section_id", n.alias("n"), F.col("kind").alias("unit_type"), t.content_hash(F.col("doc_id").cast("string"), F.col("text")).alias("content_hash"), "occurrence")


@query(rf"""{S}, k AS (SELECT job_id, segment_id, source_text, row_number() OVER (PARTITION BY job_id ORDER BY segment_id) AS n FROM segments) SELECT job_id, 'SEG-' || lpad(n::VARCHAR, 4, '0') AS id, n, length(source_text) AS n_chars, CASE WHEN regexp_matches(source_text, '\n') THEN 'block' ELSE 'line' END AS kind FROM k""")
def k16_build_segments(spark, sf):
    n = F.row_number().over(W.partitionBy("job_id").orderBy("segment_id"))
    rows = i.segments(spark, sf).withColumn("n", n.cast("long"))
    return rows.select("job_id", F.concat(F.lit("SEG-"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("id"), "n", F.char_length("source_text").alias("n_chars"), F.when(F.col("source_text").rlike("\n"), "block").otherwise("line").alias("kind"))


@query("""SELECT p_partkey AS unit_id, ['Approve the record', 'Review of the record', 'the record', 'Check it', 'Owner checks'][(p_partkey % 5 + 1)::INT] AS sentence, p_partkey % 5 IN (0, 3) AS imperative FROM part""")
def h14_imperative(spark, sf):
    said = F.array(*map(F.lit, ("Approve the record", "Review of the record", "the record", "Check it", "Owner checks")))
    rows = i.table(spark, sf, "part").select(F.col("p_partkey").alias("unit_id"), F.element_at(said, (F.col("p_partkey") % 5 + 1).cast("int")).alias("sentence"))
    return rows.withColumn("imperative", facts.is_imperative(F.col("sentence")))

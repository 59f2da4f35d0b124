"""The given tables read as the engine's inputs: units, elements, jobs, records, issues, segments.  Each has the same in SQL, as a CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import structure
from ..sources import pages as html


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of documents: doc_id, lang, source, seq (from 1), text."""
    return structure.text_lines(table(spark, sf_dir, "documents")).where(F.col("text").rlike(r"\S"))


UNITS = r"""units AS (SELECT doc_id, lang, source, seq, text FROM
  (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS seq FROM documents)
  WHERE regexp_matches(text, '\S'))"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the pages: doc_id, seq, kind, text."""
    return html.html_blocks(table(spark, sf_dir, "pages"))


ELEMENTS = r"""elements AS (SELECT doc_id, seq, CASE tag WHEN 'h1' THEN 'heading' WHEN 'title' THEN 'title' WHEN 'li' THEN 'list_item' ELSE 'paragraph' END AS kind,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(raw, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text
  FROM (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<(h1|title|li|p)(?:\s[^<>]*)?>((?:<(?:b|i|em|a|strong)(?:\s[^<>]*)?>)?)([^<]*)', 1)) AS tag,
          unnest(regexp_extract_all(html, '<(h1|title|li|p)(?:\s[^<>]*)?>((?:<(?:b|i|em|a|strong)(?:\s[^<>]*)?>)?)([^<]*)', 3)) AS raw,
          generate_subscripts(regexp_extract_all(html, '<(h1|title|li|p)(?:\s[^<>]*)?>((?:<(?:b|i|em|a|strong)(?:\s[^<>]*)?>)?)([^<]*)', 1), 1)::BIGINT AS seq FROM pages))"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as job events: event_id, job_id, happened_at, event, to_status, progress."""
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    progress = F.least(F.lit(100), F.greatest(F.lit(0), F.floor("value").cast("int")))
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("ts").alias("happened_at"), F.col("event_type").alias("event"), status[F.col("event_type")].alias("to_status"), progress.alias("progress"))


STATUS = {"signup": "PENDING", "view": "RUNNING", "click": "RUNNING", "purchase": "COMPLETED", "error": "FAILED"}
JOBS = """jobs AS (SELECT event_id, user_id AS job_id, ts AS happened_at, event_type AS event,
    CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' END AS to_status,
    least(100, greatest(0, floor(value)))::INTEGER AS progress FROM events)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of one record per customer: document_uid, version, record_id, status, created_at, price."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_uid"), F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price"))
    from ..operators import history

    return history.next_versions(o, ["document_uid"], ["created_at", "record_id"])


RECORDS = """records AS (SELECT o_custkey AS document_uid, o_orderkey AS record_id, o_orderstatus AS status, o_orderdate AS created_at, o_totalprice AS price,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders)"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as issues: issue_id, job_id, section_id, severity, gate, resolved, at."""
    q = F.col("l_quantity")
    severity = F.when(q <= 10, "info").when(q <= 20, "low").when(q <= 30, "medium").when(q <= 40, "high").otherwise("critical")
    gate = F.when(F.col("l_returnflag") == "R", "coverage").when(F.col("l_returnflag") == "A", "numerical_change")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"), F.date_format("l_shipdate", "yyyyMMdd")).alias("issue_id"), F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("section_id"),
        severity.alias("severity"), gate.alias("gate"), (F.col("l_linestatus") == "F").alias("resolved"), F.col("l_shipdate").alias("at"),
    )


ISSUES = """issues AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::BIGINT || '-' || strftime(l_shipdate, '%Y%m%d') AS issue_id, l_orderkey AS job_id, l_suppkey AS section_id,
    CASE WHEN l_quantity <= 10 THEN 'info' WHEN l_quantity <= 20 THEN 'low' WHEN l_quantity <= 30 THEN 'medium' WHEN l_quantity <= 40 THEN 'high' ELSE 'critical' END AS severity,
    CASE l_returnflag WHEN 'R' THEN 'coverage' WHEN 'A' THEN 'numerical_change' END AS gate, l_linestatus = 'F' AS resolved, l_shipdate AS at FROM lineitem)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns and the answers after them as source and target: job_id, segment_id, source_text, target_text (null if unanswered)."""
    c = table(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("segment_id"), F.col("text").alias("source_text"))
    reply = c.where("role = 'assistant'").select(F.col("conv_id").alias("job_id"), (F.col("turn") - 1).alias("segment_id"), F.col("text").alias("target_text"))
    return user.join(reply, ["job_id", "segment_id"], "left")


SEGMENTS = """segments AS (SELECT u.conv_id AS job_id, u.turn AS segment_id, u.text AS source_text, a.text AS target_text FROM conversations u
    LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""

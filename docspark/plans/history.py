"""Queries over versions, jobs and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history
from . import inputs as i
from .registry import query


@query(f"WITH {i.RECORDS} SELECT * FROM records QUALIFY version = max(version) OVER (PARTITION BY document_uid)")
def e1_latest_version(spark, sf):
    return history.latest_version(i.records(spark, sf), ["document_uid"])


@query(f"""WITH {i.RECORDS}, old AS (SELECT * FROM records WHERE year(created_at) < 1996), new AS (SELECT * FROM records WHERE year(created_at) >= 1996),
m AS (SELECT document_uid, max(version) AS last FROM old GROUP BY 1)
SELECT document_uid, record_id, (coalesce(last, 0) + row_number() OVER (PARTITION BY document_uid ORDER BY created_at, record_id))::BIGINT AS version FROM new LEFT JOIN m USING (document_uid)""")
def e2_next_version(spark, sf):
    r = i.records(spark, sf)
    new = r.where(F.year("created_at") >= 1996).drop("version")
    return history.next_versions(new, ["document_uid"], ["created_at", "record_id"], r.where(F.year("created_at") < 1996)).select("document_uid", "record_id", "version")


@query(f"WITH {i.RECORDS} SELECT record_id, document_uid, status, created_at FROM records WHERE status = 'O' ORDER BY created_at DESC, record_id DESC LIMIT 50 OFFSET 20")
def b9_list_records(spark, sf):
    return history.list_records(i.records(spark, sf), [F.desc("created_at"), F.desc("record_id")], 50, 20, status="O").select("record_id", "document_uid", "status", "created_at")


@query("""SELECT p_partkey AS record_id, count(DISTINCT l_orderkey) AS n_jobs, string_agg(DISTINCT l_orderkey::VARCHAR, ' ' ORDER BY l_orderkey::VARCHAR) AS jobs
FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1""")
def c9_in_use_guard(spark, sf):
    jobs = i.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("record_id"), F.col("l_orderkey").cast("string").alias("job_id"))
    return history.in_use(i.table(spark, sf, "part").select(F.col("p_partkey").alias("record_id")), jobs, "record_id", "job_id")


@query("SELECT c_custkey AS record_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def c9_deletable(spark, sf):
    jobs = i.table(spark, sf, "orders").select(F.col("o_custkey").alias("record_id"))
    return history.deletable(i.table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id")), jobs, "record_id")


HISTORY = f"""{i.JOBS}, h AS (SELECT *, lag(to_status) OVER (PARTITION BY job_id ORDER BY happened_at, event_id) AS from_status FROM jobs)"""


@query(f"WITH {HISTORY} SELECT event_id, job_id, happened_at, from_status, to_status FROM h WHERE to_status IS DISTINCT FROM from_status")
def e21_status_history(spark, sf):
    return history.status_history(i.jobs(spark, sf)).select("event_id", "job_id", "happened_at", "from_status", "to_status")


@query(f"WITH {i.JOBS} SELECT job_id, to_status AS status, happened_at FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY happened_at DESC, event_id DESC) = 1")
def e21_current_status(spark, sf):
    return history.current_status(i.jobs(spark, sf))


@query(f"""WITH {i.JOBS}, now AS (SELECT job_id, to_status AS status FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY happened_at DESC, event_id DESC) = 1)
SELECT event_id, j.job_id, j.to_status AS expected FROM jobs j JOIN now ON j.job_id = now.job_id AND j.to_status = now.status WHERE event = 'error'""")
def b15_transition_if(spark, sf):
    jobs = i.jobs(spark, sf)
    changes = jobs.where("event = 'error'").select("event_id", "job_id", F.col("to_status").alias("expected"))
    return history.transition_if(changes, history.current_status(jobs), "job_id")


@query(f"""WITH {i.JOBS} SELECT job_id, count(*) AS total, count(*) FILTER (to_status = 'COMPLETED') AS completed, count(*) FILTER (to_status = 'FAILED') AS failed, floor(avg(progress))::BIGINT AS progress,
CASE WHEN count(*) FILTER (to_status IN ('COMPLETED', 'FAILED')) < count(*) THEN 'RUNNING' WHEN bool_and(to_status = 'FAILED') THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM jobs GROUP BY job_id""")
def d5_batch_progress(spark, sf):
    return history.batch_progress(i.jobs(spark, sf).withColumnRenamed("to_status", "status"))


@query("""SELECT event_type AS task, count(*) AS calls, sum(floor(value)::BIGINT)::BIGINT AS tokens, sum(strlen(props))::BIGINT AS latency, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1""")
def d17_call_rollup(spark, sf):
    e = i.table(spark, sf, "events").select(F.col("event_type").alias("task"), F.floor("value").alias("tok"), F.octet_length("props").cast("long").alias("lat"), F.col("event_type").alias("status"))
    return history.call_rollup(e, "task", "tok", "lat")


@query(f"""WITH {i.RECORDS}, l AS (SELECT document_uid, version, CASE status WHEN 'F' THEN 'approved' ELSE 'in_review' END AS s FROM records QUALIFY version = max(version) OVER (PARTITION BY document_uid))
SELECT c_custkey AS document_uid, (CASE WHEN l.version IS NULL THEN 1 WHEN s = 'approved' THEN l.version + 1 ELSE l.version END)::BIGINT AS version FROM customer LEFT JOIN l ON c_custkey = document_uid""")
def b19_edit_version(spark, sf):
    latest = history.latest_version(i.records(spark, sf), ["document_uid"]).withColumn("status", F.when(F.col("status") == "F", "approved").otherwise("in_review"))
    return history.edit_version(latest, i.table(spark, sf, "customer").select(F.col("c_custkey").alias("document_uid")), "document_uid")


@query(f"""WITH {i.SEGMENTS}, s AS (SELECT job_id, max(segment_id) AS last FROM segments WHERE target_text IS NOT NULL GROUP BY 1)
SELECT g.job_id, g.segment_id, g.segment_id = s.last AS is_latest FROM segments g LEFT JOIN s ON g.job_id = s.job_id""")
def c26_merge_latest(spark, sf):
    g = i.segments(spark, sf)
    latest = history.latest_version(g.where("target_text is not null").select("job_id", "segment_id"), ["job_id"], "segment_id").withColumnRenamed("segment_id", "last")
    return g.join(latest, "job_id", "left").select("job_id", "segment_id", (F.col("segment_id") == F.col("last")).alias("is_latest"))

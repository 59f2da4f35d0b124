"""Batch twins of the streaming operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as ev
from . import inputs as i
from .registry import query

J = f"WITH {i.JOBS}"


@query(f"{J} SELECT job_id, count(*) AS n, floor(avg(progress))::BIGINT AS progress, arg_max(to_status, (happened_at, event_id)) AS status FROM jobs GROUP BY 1")
def i1_progress(spark, sf):
    return ev.progress(i.jobs(spark, sf))


@query(f"{J} SELECT time_bucket(INTERVAL 1 hour, happened_at) AS started_at, event, count(*) AS n, sum(progress)::BIGINT AS progress FROM jobs GROUP BY 1, 2")
def i2_events_per_window(spark, sf):
    return ev.per_window(i.jobs(spark, sf))


@query(f"""{J}, w AS (SELECT job_id, unnest(range(0, 4)) AS k, happened_at FROM jobs WHERE event = 'error'), s AS (SELECT job_id, time_bucket(INTERVAL 6 hours, happened_at) - k * INTERVAL 6 hours AS started_at FROM w)
SELECT started_at, job_id, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 3""")
def i3_attempts_sliding(spark, sf):
    return ev.attempts(i.jobs(spark, sf), "error", 3, "24 hours", "6 hours")


@query(f"""{J}, r AS (SELECT *, sum((event = 'purchase')::INT) OVER (PARTITION BY job_id ORDER BY happened_at, event_id) AS run FROM jobs WHERE event IN ('error', 'purchase')),
n AS (SELECT *, row_number() OVER (PARTITION BY job_id, run ORDER BY happened_at, event_id) AS k FROM r WHERE event = 'error') SELECT job_id, event_id, happened_at AS locked_at FROM n WHERE k % 3 = 0""")
def i4_lockouts(spark, sf):
    return ev.lockouts(i.jobs(spark, sf), "error", "purchase", 3)


@query(f"{J} SELECT job_id, event, event_id, happened_at FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id, event ORDER BY event_id) = 1")
def i5_first_uploads(spark, sf):
    return ev.first_uploads(i.jobs(spark, sf).select("job_id", "event", "event_id", "happened_at"), ["job_id", "event"])


@query(f"""{J}, h AS (SELECT *, lag(to_status) OVER (PARTITION BY job_id ORDER BY happened_at, event_id) AS from_status FROM jobs)
SELECT event_id, job_id, from_status, to_status FROM h WHERE from_status IS NOT NULL AND from_status <> to_status AND from_status || '>' || to_status NOT IN ({', '.join(f"'{a}>{b}'" for a, b in ev.LEGAL)})""")
def i6_illegal_transitions(spark, sf):
    return ev.illegal_transitions(i.jobs(spark, sf)).select("event_id", "job_id", "from_status", "to_status")


@query(f"""{J}, g AS (SELECT *, coalesce(happened_at - lag(happened_at) OVER (PARTITION BY job_id ORDER BY happened_at, event_id) > INTERVAL 6 hours, true) AS fresh FROM jobs),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY job_id ORDER BY happened_at, event_id) AS k FROM g), a AS (SELECT job_id, k, min(happened_at) AS started_at, count(*) AS n, arg_max(to_status, (happened_at, event_id)) AS status FROM s GROUP BY 1, 2)
SELECT started_at, job_id, n, status FROM a WHERE status NOT IN ('COMPLETED', 'FAILED')""")
def i7_idle_sessions(spark, sf):
    return ev.idle_sessions(i.jobs(spark, sf))


@query(f"""{J}, m AS (SELECT *, max(happened_at) OVER (PARTITION BY job_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM jobs) SELECT event_id, job_id FROM m WHERE happened_at < seen - INTERVAL 10 minutes""")
def i8_late_events(spark, sf):
    return ev.late_events(i.jobs(spark, sf), "10 minutes").select("event_id", "job_id")


@query(f"{J} SELECT event, count(DISTINCT job_id) AS jobs, count(*) AS n FROM jobs GROUP BY 1")
def a2_scan_events(spark, sf):
    return i.jobs(spark, sf).groupBy("event").agg(F.count_distinct("job_id").alias("jobs"), F.count("*").alias("n"))

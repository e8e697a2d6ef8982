"""Streaming jobs run over everything that has landed, checked against their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import new_folder
from ..sources.versions import VersionStore
from ..streaming import jobs
from .queries_state import HEALTH_SQL, stored_jobs
from .registry import query


def event_stream(v):
    schema = v.table("events").schema
    return v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(
        v.sf_dir
    )


@query("stream_rate_windows", "X2 W12", """
SELECT CAST(user_id AS VARCHAR) AS domain, date_trunc('minute', ts) AS minute,
  count(*) AS requests, greatest(count(*) - 1, 0) AS over_limit FROM events
WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE
  <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 5 MINUTE FROM events)
GROUP BY ALL""")
def _(v):
    requests = event_stream(v).select(F.col("user_id").cast("string").alias("domain"), "ts")
    return jobs.run_to_table(jobs.stream_rate(requests, 1), "rate")


@query("stream_unchanged_rate", "X5 A10", """
WITH days AS (SELECT *, unnest(range(0, 7)) AS back FROM events),
w AS (SELECT date_trunc('day', ts) - to_days(CAST(back AS INTEGER)) AS window_start, event_type
  FROM days)
SELECT window_start, count(*) AS runs, count(*) FILTER (event_type = 'view') AS same FROM w
WHERE window_start + INTERVAL 7 DAYS
  <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)
GROUP BY window_start""")
def _(v):
    runs = event_stream(v).select(
        F.col("ts").alias("finished_at"),
        F.when(F.col("event_type") == "view", "not_modified").otherwise("").alias("notes"),
    )
    return jobs.run_to_table(jobs.stream_unchanged_rate(runs), "unchanged")


@query("stream_audit_counts", "X6", """
SELECT event_type AS action, date_trunc('hour', ts) AS hour, count(*) AS rows FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR
  <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)
GROUP BY ALL""")
def _(v):
    audit = event_stream(v).select(
        F.col("event_type").alias("action"), F.col("ts").alias("created_at")
    )
    return jobs.run_to_table(jobs.stream_audit_counts(audit), "audit")


@query("stream_health", "X3 M20", HEALTH_SQL + """
SELECT company_id, CAST(f.n AS INTEGER) AS consecutive_failures, f.is_active,
  CASE WHEN f.n = 0 THEN 'healthy' WHEN f.n <= 2 THEN 'degraded' WHEN f.n <= 4 THEN 'failing'
    ELSE 'paused' END AS scrape_health
FROM final f""")
def _(v):
    runs = event_stream(v).select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("company_id"),
        F.col("ts").alias("finished_at"), (F.col("event_type") != "error").alias("success"),
        F.lit(True).alias("trusted"), F.lit(1).alias("jobs_seen"),
        F.lit("error").alias("failure_reason"),
    )
    folder = new_folder(v.spark, "health")
    started = jobs.stream_health(runs, v.company(), f"{folder}/state", f"{folder}/progress")
    started.awaitTermination()
    state = VersionStore(v.spark, f"{folder}/state").read("companies")
    ran = v.run().select("company_id")
    return state.join(ran, "company_id", "left_semi").select(
        "company_id", "consecutive_failures", "is_active", "scrape_health"
    )


def landed(v, title, day: str, picked):
    """Feed documents of one posting each, landed on ``day``."""
    k = F.col("job_id")
    return v.job().filter(picked).select(
        "company_id", F.lit("lever").alias("source_type"), F.to_json(F.array(F.struct(
            F.concat(F.lit("J"), k.cast("string")).alias("id"), title.alias("text"),
            F.struct(k.cast("string").alias("location")).alias("categories"),
            F.col("source_url").alias("hostedUrl")))).alias("body"),
        F.lit(day).cast("timestamp_ntz").alias("landed_at"))


@query("stream_ingest", "X1 M1", """
WITH stored AS (SELECT *, job_id % 4 <> 3 AND NOT is_deleted AS there FROM v_job),
seen AS (SELECT *, CASE WHEN job_id % 5 = 0 THEN 2 ELSE 1 END AS day FROM stored
  WHERE job_id % 6 <> 1)
SELECT company_id, source_url, CASE WHEN job_id % 5 = 0 THEN title || ' II' ELSE title END AS title,
  CASE WHEN NOT there THEN 'open' WHEN status IN ('possibly_closed', 'likely_closed', 'closed')
    AND NOT is_manual_status THEN 'open' ELSE status END AS status,
  CASE day WHEN 2 THEN TIMESTAMP '2002-01-02' ELSE TIMESTAMP '2002-01-01' END AS last_seen_at,
  NOT there AS is_new FROM seen
UNION ALL SELECT company_id, source_url, title, status, last_seen_at, false FROM stored
  WHERE (job_id % 6 = 1 AND job_id % 4 <> 3) OR (job_id % 6 <> 1 AND job_id % 4 <> 3 AND NOT there)""")
def _(v):
    """Two days of documents, each its own micro-batch; the second lists a fifth of the jobs again
    under a longer title."""
    folder, k = new_folder(v.spark, "ingest"), F.col("job_id")
    landed(v, F.col("title"), "2002-01-01", k % 6 != 1).coalesce(1).write.parquet(
        f"{folder}/feeds/day=1")
    landed(v, F.concat("title", F.lit(" II")), "2002-01-02", (k % 6 != 1) & (k % 5 == 0)).coalesce(
        1).write.parquet(f"{folder}/feeds/day=2")
    stored = stored_jobs(v)
    started = jobs.stream_ingest(
        v.spark, f"{folder}/feeds/*", v.company(), stored, f"{folder}/state", f"{folder}/progress",
        files_per_batch=1)
    started.awaitTermination()
    final = VersionStore(v.spark, f"{folder}/state").read("jobs")
    known = stored.select("job_id").withColumn("_known", F.lit(True))
    return final.join(known, "job_id", "left").select(
        "company_id", "source_url", "title", "status", "last_seen_at",
        F.col("_known").isNull().alias("is_new"))


@query("dedupe_runs", "X4", """
SELECT company_id FROM v_run WHERE company_id IS NOT NULL GROUP BY company_id""")
def _(v):
    """All runs as they landed at one moment: one per company is left."""
    folder = new_folder(v.spark, "runs")
    moment = F.lit("2002-01-01").cast("timestamp_ntz")
    runs = v.run().select("company_id", moment.alias("finished_at"))
    runs.write.parquet(f"{folder}/runs")
    stream = v.spark.readStream.schema(runs.schema).parquet(f"{folder}/runs")
    return jobs.run_to_table(jobs.dedupe_runs(stream), "dedupe").select("company_id")

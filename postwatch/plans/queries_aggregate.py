"""Facets, counts, dashboards and run histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, history
from ..sources.exports import job_posting_jsonld, sitemap_urls
from .registry import query
from .views import EVENTS_AS_OF, HEALTH, as_of

LIVE = "status = 'open' AND is_published AND NOT is_deleted"


@query("facet_work_mode", "A1",
       f"SELECT work_mode, count(*) AS jobs FROM v_job WHERE {LIVE} GROUP BY work_mode")
def _(v):
    return aggregates.facet(v.job(), "work_mode")


@query("facet_job_type", "A2",
       f"SELECT job_type, count(*) AS jobs FROM v_job WHERE {LIVE} GROUP BY job_type")
def _(v):
    return aggregates.facet(v.job(), "job_type")


@query("facet_company_top20", "A3", f"""
SELECT c.slug AS company_slug, c.name AS company_name, count(*) AS jobs
FROM v_job j JOIN v_company c USING (company_id)
WHERE status = 'open' AND is_published AND NOT j.is_deleted
GROUP BY ALL ORDER BY jobs DESC, company_slug LIMIT 20""")
def _(v):
    return aggregates.facet_company(v.job(), v.company())


@query("facet_department_top20", "A4", f"""
SELECT department, count(*) AS jobs FROM v_job WHERE {LIVE} AND department <> ''
GROUP BY department ORDER BY jobs DESC, department LIMIT 20""")
def _(v):
    return aggregates.facet_department(v.job())


@query("job_facets_all", "A5", f"""
WITH live AS (SELECT j.*, c.slug AS company_slug FROM v_job j
  LEFT JOIN v_company c USING (company_id)
  WHERE status = 'open' AND is_published AND NOT j.is_deleted),
companies AS (SELECT 'company' AS facet, company_slug AS value, count(*) AS jobs FROM live
  WHERE company_slug IS NOT NULL GROUP BY ALL ORDER BY jobs DESC, value LIMIT 20),
departments AS (SELECT 'department' AS facet, department AS value, count(*) AS jobs FROM live
  WHERE department <> '' GROUP BY ALL ORDER BY jobs DESC, value LIMIT 20)
SELECT 'work_mode' AS facet, work_mode AS value, count(*) AS jobs FROM live GROUP BY ALL
UNION ALL SELECT 'job_type', job_type, count(*) FROM live GROUP BY ALL
UNION ALL SELECT * FROM companies UNION ALL SELECT * FROM departments""")
def _(v):
    return aggregates.job_facets(v.job(), v.company())


@query("health_counts_zero_filled", "A6", """
WITH domain AS (SELECT unnest(['unknown', 'healthy', 'degraded', 'failing', 'paused', 'retired'])
  AS scrape_health)
SELECT scrape_health, count(company_id) AS total FROM domain
LEFT JOIN v_company USING (scrape_health) GROUP BY scrape_health""")
def _(v):
    return aggregates.count_by_enum(v.company(), "scrape_health", (*HEALTH, "retired"))


@query("company_job_counts", "A7", """
SELECT c.company_id, count(*) FILTER (j.status = 'open') AS open_jobs,
  count(j.job_id) AS total_jobs
FROM v_company c LEFT JOIN v_job j USING (company_id) GROUP BY c.company_id""")
def _(v):
    counted = aggregates.with_job_counts(v.company(), v.job())
    return counted.select("company_id", "open_jobs", "total_jobs")


@query("public_job_counts", "A8", """
SELECT c.company_id, count(*) FILTER (j.status = 'open' AND j.is_published
  AND NOT j.is_deleted) AS open_jobs_count
FROM v_company c LEFT JOIN v_job j USING (company_id) GROUP BY c.company_id""")
def _(v):
    counted = aggregates.with_public_job_counts(v.company(), v.job())
    return counted.select("company_id", "open_jobs_count")


@query("ops_dashboard", "A9", """
SELECT count(*) AS companies, count(*) FILTER (is_verified) AS verified,
  count(*) FILTER (detection_status = 'pending') AS pending,
  count(*) FILTER (detection_status = 'needs_review') AS needs_review,
  count(*) FILTER (is_verified AND is_active AND career_url <> '' AND scrape_health <> 'paused'
    AND (next_scrape_at IS NULL OR next_scrape_at <= TIMESTAMP '2001-11-05')) AS due_now,
  min(next_scrape_at) FILTER (is_verified AND is_active AND career_url <> ''
    AND scrape_health <> 'paused' AND next_scrape_at <= TIMESTAMP '2001-11-05') AS next_scrape_at
FROM v_company WHERE NOT is_deleted""")
def _(v):
    return aggregates.ops_dashboard(v.company(), as_of())


@query("jobs_by_status", "A9", """
SELECT status, count(*) AS jobs FROM v_job WHERE NOT is_deleted GROUP BY status""")
def _(v):
    return aggregates.jobs_by_status(v.job())


@query("latest_runs", "A9", """
SELECT run_id, company_id, finished_at, status FROM v_run
ORDER BY finished_at DESC, run_id LIMIT 10""")
def _(v):
    return aggregates.latest_runs(v.run()).select("run_id", "company_id", "finished_at", "status")


@query("unchanged_rate_7d", "A10", f"""
SELECT count(*) AS runs, count(*) FILTER (notes = 'not_modified') AS same,
  CASE WHEN count(*) = 0 THEN '-' ELSE count(*) FILTER (notes = 'not_modified') || '/'
    || count(*) END AS label,
  round(count(*) FILTER (notes = 'not_modified') * 100 / count(*), 4) AS rate
FROM v_run WHERE finished_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAYS""")
def _(v):
    return aggregates.unchanged_rate(v.run(), as_of(EVENTS_AS_OF))


@query("review_count", "A11", """
SELECT count(*) AS review_count FROM v_job WHERE needs_review AND NOT is_deleted""")
def _(v):
    return aggregates.review_count(v.job())


@query("reports_needing_review", "A12", """
WITH counted AS (SELECT job_id, count(*) AS open_reports FROM v_report WHERE status = 'open'
  GROUP BY job_id HAVING count(*) >= 3)
SELECT job_id, open_reports, 'user reports' AS review_reason FROM v_job JOIN counted
USING (job_id) WHERE is_published""")
def _(v):
    found = aggregates.reports_to_review(v.job(), v.report())
    return found.select("job_id", "open_reports", "review_reason")


@query("date_drilldown", "A16", """
SELECT CAST(year(posted_at) AS INTEGER) AS y, CAST(month(posted_at) AS INTEGER) AS m,
  CAST(day(posted_at) AS INTEGER) AS d, count(*) AS total
FROM v_job WHERE posted_at IS NOT NULL
GROUP BY GROUPING SETS ((y), (y, m), (y, m, d))""")
def _(v):
    return aggregates.date_hierarchy(v.job(), "posted_at")


@query("recount_saves", "A17", """
WITH s AS (SELECT job_id, count(DISTINCT user_id) AS n FROM v_saved GROUP BY job_id),
r AS (SELECT job_id, count(*) AS n FROM v_report GROUP BY job_id)
SELECT job_id, coalesce(s.n, 0) AS save_count, coalesce(r.n, 0) AS report_count
FROM v_job LEFT JOIN s USING (job_id) LEFT JOIN r USING (job_id)""")
def _(v):
    counted = aggregates.recount(v.job(), v.saved(), v.report())
    return counted.select("job_id", "save_count", "report_count")


@query("health_totals", "A19", """
SELECT company_id, count(*) AS total_scrapes,
  count(*) FILTER (status = 'failed') AS total_failures FROM v_run GROUP BY company_id""")
def _(v):
    return aggregates.health_totals(v.run())


@query("run_baseline", "W3", """
SELECT run_id, coalesce(last_value(CASE WHEN status = 'success' THEN jobs_found END IGNORE NULLS)
  OVER (PARTITION BY company_id ORDER BY finished_at, run_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS baseline
FROM v_run""")
def _(v):
    return history.with_baseline(v.run()).select("run_id", "baseline")


@query("recent_trusted_runs", "W4", """
WITH ranked AS (SELECT company_id, run_id, jobs_added, jobs_missing, row_number() OVER (
  PARTITION BY company_id ORDER BY finished_at DESC, run_id DESC) AS nth
  FROM v_run WHERE verdict = 'trusted')
SELECT company_id, string_agg(jobs_added || ':' || jobs_missing, ',' ORDER BY nth) AS recent
FROM ranked WHERE nth <= 3 GROUP BY company_id""")
def _(v):
    recent = history.recent_trusted(v.run())
    text = F.transform("recent", lambda r: F.concat_ws(
        ":", r["added"].cast("string"), r["missing"].cast("string")))
    return recent.select("company_id", F.array_join(text, ",").alias("recent"))


@query("failure_streaks", "W11", """
WITH numbered AS (SELECT *, sum(CASE WHEN status = 'failed' THEN 0 ELSE 1 END) OVER (
  PARTITION BY company_id ORDER BY finished_at, run_id) AS series FROM v_run)
SELECT company_id, min(finished_at) AS first_failure, max(finished_at) AS last_failure,
  count(*) AS failures FROM numbered WHERE status = 'failed' GROUP BY company_id, series""")
def _(v):
    return history.failure_streaks(v.run())


@query("current_failures", "W11", """
WITH g AS (SELECT company_id, max((finished_at, run_id)) FILTER (status <> 'failed') AS good
  FROM v_run GROUP BY company_id)
SELECT company_id, count(*) AS consecutive_failures FROM v_run JOIN g USING (company_id)
WHERE status = 'failed' AND (good IS NULL OR (finished_at, run_id) > good)
GROUP BY company_id""")
def _(v):
    return history.current_failures(v.run())


@query("status_timeline", "W10", """
SELECT job_id, created_at, seq, part_key, to_status,
  coalesce(lag(to_status) OVER w, '') AS from_status,
  date_diff('second', lag(created_at) OVER w, created_at) AS dwell_seconds
FROM v_status_event
WINDOW w AS (PARTITION BY job_id ORDER BY created_at, seq, part_key, run_id)""")
def _(v):
    steps = history.status_timeline(v.status_event(), ["seq", "part_key", "run_id"])
    return steps.select(
        "job_id", "created_at", "seq", "part_key", "to_status", "from_status", "dwell_seconds"
    )


@query("source_history", "W9", """
SELECT run_id AS source_id, company_id, lead(finished_at) OVER w AS retired_at,
  lead(finished_at) OVER w IS NULL AS is_current
FROM v_run WINDOW w AS (PARTITION BY company_id ORDER BY finished_at, run_id)""")
def _(v):
    changes = v.run().select(
        F.col("run_id").alias("source_id"), "company_id", F.col("finished_at").alias("set_at")
    )
    return history.source_history(changes).select(
        "source_id", "company_id", "retired_at", "is_current"
    )


@query("rate_windows", "W12", """
SELECT CAST(user_id AS VARCHAR) AS domain, date_trunc('minute', ts) AS minute,
  count(*) AS requests, greatest(count(*) - 1, 0) AS over_limit
FROM events GROUP BY ALL""")
def _(v):
    requests = v.table("events").select(F.col("user_id").cast("string").alias("domain"), "ts")
    return history.rate_audit(requests, 1)


@query("request_turns", "W12", """
SELECT event_id, 'd' || user_id % 5 AS domain, date_trunc('hour', ts) AS minute,
  row_number() OVER w AS turn, row_number() OVER w > 2 AS over_limit
FROM (SELECT event_id, user_id, date_trunc('hour', ts) + to_seconds(event_id % 60) AS ts FROM events)
WINDOW w AS (PARTITION BY user_id % 5, date_trunc('hour', ts) ORDER BY ts, event_id)""")
def _(v):
    """Requests of five domains, moved into the first minute of their hour so that turns are long."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    requests = v.table("events").select(
        "event_id", F.concat(F.lit("d"), F.col("user_id") % 5).alias("domain"),
        (hour + F.make_dt_interval(secs=F.col("event_id") % 60)).alias("ts"))
    return history.request_turns(requests, 2, "event_id").select(
        "event_id", "domain", "minute", "turn", "over_limit")


@query("unique_slugs", "W8", """
WITH existing AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '-')
    ELSE replace(p_name, ' ', '-') || '-' || (p_partkey % 40) END AS slug FROM part),
numbers AS (SELECT p_name, unnest(range(0, 400)) AS n FROM (SELECT DISTINCT p_name FROM part)),
free AS (SELECT p_name, n, row_number() OVER (PARTITION BY p_name ORDER BY n) AS nth
  FROM numbers WHERE replace(p_name, ' ', '-') || CASE WHEN n = 0 THEN '' ELSE '-' || n END
    NOT IN (SELECT slug FROM existing)),
wanted AS (SELECT p_partkey, p_name,
  row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS nth FROM part)
SELECT p_partkey, replace(p_name, ' ', '-') || CASE WHEN n = 0 THEN '' ELSE '-' || n END AS slug
FROM wanted JOIN free USING (p_name, nth)""")
def _(v):
    part = v.table("part").select(
        "p_partkey", F.replace("p_name", F.lit(" "), F.lit("-")).alias("base")
    )
    key = F.col("p_partkey")
    existing = part.select(
        F.when(key % 3 == 0, F.col("base")).otherwise(
            F.concat_ws("-", "base", (key % 40).cast("string"))).alias("slug")
    )
    return history.unique_slugs(part, existing, "p_partkey", "base").select("p_partkey", "slug")


@query("sitemap_urls", "S9 F41", f"""
WITH rows AS (
  SELECT 'jobs' AS section, slug, '/jobs/' || slug || '/' AS path, last_seen_at AS lastmod,
    'hourly' AS changefreq, 0.8::DOUBLE AS priority
  FROM v_job WHERE {LIVE} AND duplicate_of IS NULL
  UNION ALL SELECT 'companies', slug, '/companies/' || slug || '/', created_at, 'daily', 0.7
  FROM v_company WHERE is_verified AND is_active AND NOT is_deleted
  UNION ALL SELECT 'exams', exam_slug, '/exams/' || exam_slug || '/', NULL, 'weekly', 0.6
  FROM v_exam
  UNION ALL SELECT 'static', p, p, NULL, 'daily', CASE WHEN p = '/' THEN 0.8 ELSE 0.7 END
  FROM (SELECT unnest(['/', '/jobs/', '/companies/', '/exams/', '/exams/calendar/']) AS p))
SELECT section, CAST((row_number() OVER (PARTITION BY section ORDER BY slug) - 1) // 500 + 1
  AS INTEGER) AS page, 'https://site.example.org' || path AS loc, lastmod, changefreq, priority
FROM rows""")
def _(v):
    exams = v.exam().withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    companies = v.company().withColumnRenamed("created_at", "updated_at")
    return sitemap_urls(v.job(), companies, exams, "https://site.example.org/", page_size=500)


@query("job_posting_jsonld", "S10 F23 F24 F25 F26 P26", """
SELECT job_id, '{"@context":"https://schema.org","@type":"JobPosting","title":"' || title
  || '","datePosted":"' || strftime(coalesce(posted_at, first_seen_at), '%Y-%m-%dT%H:%M:%S')
  || '+00:00","validThrough":"' || strftime(first_seen_at + to_days(60), '%Y-%m-%dT%H:%M:%S')
  || '+00:00","hiringOrganization":{"@type":"Organization","name":"' || c.name
  || '","sameAs":"https://' || domain || '"},"jobLocation":{"@type":"Place","address":'
  || '{"@type":"PostalAddress","addressCountry":"IN"}}'
  || CASE WHEN source_job_id = '' THEN '' ELSE ',"identifier":{"@type":"PropertyValue","name":"'
    || c.name || '","value":"' || source_job_id || '"}' END
  || ',"directApply":false,"employmentType":"' || CASE job_type WHEN 'full_time' THEN 'FULL_TIME'
    WHEN 'contract' THEN 'CONTRACTOR' ELSE 'INTERN' END || '"'
  || CASE WHEN work_mode = 'remote' THEN ',"jobLocationType":"TELECOMMUTE",'
    || '"applicantLocationRequirements":{"@type":"Country","name":"Any"}' ELSE '' END
  || '}' AS document
FROM v_job j JOIN v_company c USING (company_id)
WHERE is_published AND status = 'open'""")
def _(v):
    return job_posting_jsonld(v.job().drop("salary_min", "salary_max"), v.company())


@query("salary_documents", "F24", """
SELECT job_id, 'MonetaryAmount INR MONTH ' || CAST(round(salary_min, 0) AS BIGINT) || ' '
  || coalesce(CAST(CAST(round(salary_max, 0) AS BIGINT) AS VARCHAR), '-') AS salary FROM v_job""")
def _(v):
    from ..functions.rules import base_salary

    salary = base_salary(F.col("salary_min"), F.col("salary_max"), F.lit(""), F.lit(None))
    pay = salary["value"]
    return v.job().select(
        "job_id",
        F.concat_ws(
            " ", salary["@type"], salary["currency"], salary["unitText"],
            F.round(pay["minValue"]).cast("long").cast("string"),
            F.coalesce(F.round(pay["maxValue"]).cast("long").cast("string"), F.lit("-")),
        ).alias("salary"),
    )

"""Data-quality queries over all canonical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts, urls
from ..operators import quality
from .queries_state import candidate_table
from .registry import query


@query("dq_jobs", "Q1 Q2", """
SELECT 'missing_count_max' AS rule, CAST(job_id AS VARCHAR) AS key, '' AS detail FROM v_job
  WHERE missing_count > 3
UNION ALL SELECT 'closed_needs_time', CAST(job_id AS VARCHAR), '' FROM v_job
  WHERE status = 'closed' AND closed_at IS NULL
UNION ALL SELECT 'salary_range', CAST(job_id AS VARCHAR), '' FROM v_job
  WHERE salary_max < salary_min
UNION ALL SELECT 'confidence_range', CAST(job_id AS VARCHAR), '' FROM v_job
  WHERE extraction_confidence > 100
UNION ALL SELECT 'job_source_id', company_id || '|' || sid, CAST(count(*) AS VARCHAR) FROM (
  SELECT company_id, department AS sid FROM v_job
  WHERE NOT is_deleted AND department <> '') GROUP BY company_id, sid HAVING count(*) > 1
UNION ALL SELECT 'job_title_url', company_id || '|' || lower(title) || '|' || 'u',
  CAST(count(*) AS VARCHAR) FROM v_job WHERE NOT is_deleted
  GROUP BY company_id, lower(title) HAVING count(*) > 1""")
def _(v):
    jobs = v.job()
    coarse = jobs.withColumn("source_job_id", F.col("department")).withColumn(
        "title_normalized", texts.title_normalized("title")
    ).withColumn("normalized_source_url", F.lit("u"))
    return quality.union([quality.check_job_rows(jobs), quality.check_job_unique(coarse)])


@query("dq_job_keys", "Q1 F1 F7", """
SELECT 'job_source_id' AS rule, company_id || '|' || source_job_id AS key,
  CAST(count(*) AS VARCHAR) AS detail FROM v_job WHERE NOT is_deleted AND source_job_id <> ''
GROUP BY company_id, source_job_id HAVING count(*) > 1""")
def _(v):
    jobs = v.job().withColumn("title_normalized", texts.title_normalized("title")).withColumn(
        "normalized_source_url", urls.normalize_url("source_url")
    )
    return quality.check_job_unique(jobs)


@query("dq_companies", "Q3 Q11", """
WITH live AS (SELECT * FROM v_company WHERE NOT is_deleted)
SELECT 'company_domain' AS rule, domain AS key, CAST(count(*) AS VARCHAR) AS detail FROM live
  GROUP BY domain HAVING count(*) > 1
UNION ALL SELECT 'company_career_url', career_url, CAST(count(*) AS VARCHAR) FROM live
  WHERE career_url <> '' GROUP BY career_url HAVING count(*) > 1
UNION ALL SELECT 'company_board', career_source_type || '|' || ats_identifier,
  CAST(count(*) AS VARCHAR) FROM live WHERE ats_identifier <> ''
  GROUP BY career_source_type, ats_identifier HAVING count(*) > 1
UNION ALL SELECT 'verified_needs_url', CAST(company_id AS VARCHAR), '' FROM v_company
  WHERE is_verified AND career_url = ''
UNION ALL SELECT 'board_as_domain', CAST(company_id AS VARCHAR), '' FROM v_company
  WHERE domain LIKE '%.greenhouse.io'""")
def _(v):
    firms = v.company()
    return quality.union([quality.check_companies(firms), quality.check_ats_domains(firms)])


@query("dq_sources", "Q4", """
WITH cand AS (SELECT company_id, n, CAST((company_id + n) * 17 % 101 AS INTEGER) AS score,
    CASE WHEN (company_id + n) % 4 = 0 THEN 'rejected' ELSE 'approved' END AS status
  FROM v_company, (SELECT unnest([1, 2, 3]) AS n)),
cur AS (SELECT company_id, run_id % 5 = 0 AS is_current FROM v_run)
SELECT 'one_current_source' AS rule, CAST(company_id AS VARCHAR) AS key,
  CAST(count(*) AS VARCHAR) AS detail FROM cur WHERE is_current GROUP BY company_id
  HAVING count(*) > 1
UNION ALL SELECT 'one_approved_candidate', CAST(company_id AS VARCHAR), CAST(count(*) AS VARCHAR)
FROM cand WHERE status = 'approved' GROUP BY company_id HAVING count(*) > 1""")
def _(v):
    sources = v.run().select("company_id", (F.col("run_id") % 5 == 0).alias("is_current"))
    cands = candidate_table(v).replace("pending", "approved", subset=["status"])
    return quality.check_sources(sources, cands)


@query("dq_cycles", "Q5", """
SELECT 'cycle_triple' AS rule, exam_id || '|' || cycle_year || '|' || cycle_label AS key,
  CAST(count(*) AS VARCHAR) AS detail FROM v_cycle GROUP BY exam_id, cycle_year, cycle_label
  HAVING count(*) > 1
UNION ALL SELECT 'cycle_confidence', CAST(cycle_id AS VARCHAR), '' FROM v_cycle
  WHERE extraction_confidence > 100
UNION ALL SELECT 'published_needs_check', CAST(cycle_id AS VARCHAR), '' FROM v_cycle
  WHERE is_published AND NOT verified_by_human""")
def _(v):
    return quality.check_cycles(v.cycle())


@query("dq_children", "Q6", """
SELECT 'stage_order' AS rule, cycle_id || '|' || stage_order AS key,
  CAST(count(*) AS VARCHAR) AS detail FROM v_stage GROUP BY cycle_id, stage_order
  HAVING count(*) > 1
UNION ALL SELECT 'saved_exam', user_id || '|' || job_id % 100, CAST(count(*) AS VARCHAR)
  FROM v_saved GROUP BY user_id, job_id % 100 HAVING count(*) > 1
UNION ALL SELECT 'saved_job', user_id || '|' || job_id, CAST(count(*) AS VARCHAR) FROM v_saved
  GROUP BY user_id, job_id HAVING count(*) > 1
UNION ALL SELECT 'one_open_report', job_id || '|' || user_id, CAST(count(*) AS VARCHAR)
  FROM v_report WHERE status = 'open' GROUP BY job_id, user_id HAVING count(*) > 1""")
def _(v):
    exams = v.saved().select("user_id", (F.col("job_id") % 100).alias("exam_id"))
    return quality.check_child_unique(v.stage(), exams, v.saved(), v.report())


@query("dq_users", "Q7", r"""
SELECT 'user_email' AS rule, lower(email) AS key, CAST(count(*) AS VARCHAR) AS detail FROM v_user
  GROUP BY lower(email) HAVING count(*) > 1
UNION ALL SELECT 'user_phone', CAST(user_id AS VARCHAR), '' FROM v_user
  WHERE phone <> '' AND NOT regexp_matches(phone, '^\+[1-9][0-9]{1,14}$')
UNION ALL SELECT 'user_experience', CAST(user_id AS VARCHAR), '' FROM v_user
  WHERE experience_years < 0""")
def _(v):
    return quality.check_users(v.user())


@query("dq_enums", "Q8", """
SELECT 'enum_work_mode' AS rule, work_mode AS key, CAST(count(*) AS VARCHAR) AS detail FROM v_job
  WHERE work_mode NOT IN ('onsite', 'remote', 'hybrid', 'unknown') GROUP BY work_mode
UNION ALL SELECT 'enum_department', department, CAST(count(*) AS VARCHAR) FROM v_job
  GROUP BY department""")
def _(v):
    return quality.check_enums(v.job(), {
        "status": "job.status", "work_mode": "job.work_mode", "job_type": "job.job_type",
        "department": "exam.category",
    })


@query("dq_orphans", "Q9", """
SELECT 'sighting_job' AS rule, CAST(job_id AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail
FROM v_sighting WHERE job_id NOT IN (SELECT job_id FROM v_job WHERE NOT is_deleted)
GROUP BY job_id
UNION ALL SELECT 'verifier', CAST(verified_by AS VARCHAR), CAST(count(*) AS VARCHAR)
FROM v_company WHERE verified_by NOT IN (SELECT user_id FROM v_user) GROUP BY verified_by""")
def _(v):
    people = v.user().withColumnRenamed("user_id", "verified_by")
    return quality.union([
        quality.check_orphans(v.sighting(), v.job().filter(~F.col("is_deleted")), "job_id",
                              "sighting_job"),
        quality.check_orphans(v.company(), people, "verified_by", "verifier"),
    ])


BAD_SQL = """bad AS (SELECT company_id FROM v_company c LEFT JOIN v_user u
    ON u.user_id = c.verified_by WHERE is_verified AND NOT is_deleted AND (email IS NULL
    OR NOT u.is_active OR lower(email) LIKE '%@example.com' OR lower(email) LIKE '%.invalid'))"""


@query("public_surface_audit", "Q10 J2", f"""
WITH {BAD_SQL}
SELECT 'bad_provenance' AS violation, CAST(company_id AS VARCHAR) AS key FROM bad
UNION ALL SELECT 'job_of_bad_company', CAST(job_id AS VARCHAR) FROM v_job
  WHERE is_published AND status = 'open' AND NOT is_deleted
  AND company_id IN (SELECT company_id FROM bad)
UNION ALL SELECT 'active_fixture_user', CAST(user_id AS VARCHAR) FROM v_user WHERE is_active
  AND (lower(email) LIKE '%@example.com' OR lower(email) LIKE '%.invalid')""")
def _(v):
    return quality.public_surface_audit(v.company(), v.job(), v.user())


@query("audit_summary", "A18", f"""
WITH {BAD_SQL}, n AS (SELECT count(*) AS verified FROM v_company
  WHERE is_verified AND NOT is_deleted)
SELECT verified, (SELECT count(*) FROM bad) AS violations,
  verified - (SELECT count(*) FROM bad) AS clean FROM n""")
def _(v):
    return quality.audit_summary(v.company(), v.user())

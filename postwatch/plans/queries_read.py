"""Read-side queries: filters, searches, joins, orders, pages, calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import (
    aggregates, calendar, filters, history, joins, paging, search, search_index,
)
from ..session import new_folder
from ..sources.versions import VersionStore
from .registry import query
from .views import AS_OF, as_of

DAY = "1998-06-15"


def day():
    return F.lit(DAY).cast("date")


@query("live_jobs", "P1 P2", """
SELECT job_id, title, company_id FROM v_job
WHERE status = 'open' AND is_published AND NOT is_deleted""")
def _(v):
    return filters.live_jobs(v.job()).select("job_id", "title", "company_id")


@query("jobs_by_state", "P3", """
SELECT 'published' AS state, count(*) AS jobs FROM v_job WHERE is_published
UNION ALL SELECT 'open', count(*) FROM v_job WHERE status = 'open'
UNION ALL SELECT 'stale', count(*) FROM v_job
  WHERE status IN ('possibly_closed', 'likely_closed')
UNION ALL SELECT 'closed', count(*) FROM v_job WHERE status = 'closed'
UNION ALL SELECT 'needs_review', count(*) FROM v_job WHERE needs_review""")
def _(v):
    names = list(filters.JOB_STATES)
    counts = v.job().agg(*[F.count_if(filters.JOB_STATES[n]()).alias(n) for n in names])
    return counts.unpivot([], names, "state", "jobs")


@query("fresh_jobs", "P4", f"""
SELECT job_id, last_seen_at FROM v_job
WHERE last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 4000 HOURS""")
def _(v):
    return filters.fresh(v.job(), 4000, as_of()).select("job_id", "last_seen_at")


@query("company_public_jobs", "P5", """
SELECT job_id, title FROM v_job
WHERE status = 'open' AND is_published AND NOT is_deleted AND company_id IN (
  SELECT company_id FROM v_company WHERE slug = 'customer-000000008'
    AND is_verified AND is_active AND NOT is_deleted)""")
def _(v):
    found = filters.company_jobs(v.job(), v.company(), "customer-000000008")
    return found.select("job_id", "title")


@query("job_filter_multi", "P6 J1", """
SELECT job_id, work_mode, job_type, department, location_raw, c.slug AS company_slug
FROM v_job j JOIN v_company c USING (company_id)
WHERE work_mode IN ('remote', 'hybrid') AND job_type IN ('full_time')
  AND contains(lower(department), 'eco') AND contains(lower(location_raw), 'brand#1')
  AND posted_at >= TIMESTAMP '1997-01-01'""")
def _(v):
    jobs = joins.with_company(v.job(), v.company())
    found = filters.filter_jobs(
        jobs, work_mode="remote, hybrid", job_type=["full_time"], department="ECO",
        location="brand#1", posted_after=as_of("1997-01-01"),
    )
    return found.select("job_id", "work_mode", "job_type", "department", "location_raw",
                        "company_slug")


@query("job_filter_has_apply", "P6", f"""
SELECT job_id, apply_url FROM v_job
WHERE apply_url = '' AND posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 700 DAYS""")
def _(v):
    found = filters.filter_jobs(
        v.job(), has_apply_url=False, posted_within_days=700, as_of=as_of()
    )
    return found.select("job_id", "apply_url")


TRIGRAMS_SQL = r"""
list_distinct(flatten(list_transform(
  list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


def similarity_sql(left: str, right: str) -> str:
    """Trigram similarity in the checking engine, as a 4-byte float."""
    a, b = TRIGRAMS_SQL.format(text=left), TRIGRAMS_SQL.format(text=right)
    shared = f"len(list_intersect({a}, {b}))"
    return f"""(CASE WHEN len({a}) + len({b}) = 0 THEN CAST(0 AS FLOAT) ELSE
CAST(CAST({shared} AS DOUBLE) / (len({a}) + len({b}) - {shared}) AS FLOAT) END)"""


@query("job_search_trigram", "P7 F11 J1", f"""
WITH scored AS (
  SELECT job_id, CAST({similarity_sql('title', "'small gear urgent'")}
    + {similarity_sql('c.name', "'small gear urgent'")}
    + {similarity_sql('department', "'small gear urgent'")} AS DOUBLE) AS s
  FROM v_job j JOIN v_company c USING (company_id))
SELECT job_id, round(s, 5) AS similarity FROM scored WHERE s > 0.1""")
def _(v):
    found = search.search_jobs(v.job(), v.company(), "small gear urgent")
    return found.select("job_id", F.round("similarity", 5).alias("similarity"))


def search_store(v):
    """An index that was built while a quarter of the jobs was missing, a fifth had other titles
    and a seventh other companies, and was then brought up to date."""
    store, k = VersionStore(v.spark, new_folder(v.spark, "search")), F.col("job_id")
    now = v.job()
    old = now.filter(k % 4 != 3).withColumn(
        "title", F.when(k % 5 == 0, F.concat(F.lit("urgent small "), "title")).otherwise(
            F.col("title"))
    ).withColumn("company_id", F.when(k % 7 == 0, F.col("company_id") + 1).otherwise(
        F.col("company_id")))
    gone = old.filter(k % 9 == 0).withColumn("job_id", -1 - k)  # jobs that will be purged
    was = old.unionByName(gone)
    exams = joins.with_body(v.exam(), v.body())
    store.commit(0, search_index.index_tables(was, v.company(), exams), keys=search_index.KEYS)
    tables, buckets = search_index.changed_jobs(store, was, now)
    store.commit(1, tables, buckets=buckets)
    return store


@query("job_search_indexed", "P7 F11 J1 M1", f"""
WITH scored AS (
  SELECT job_id, title, c.name AS company_name,
    CAST({similarity_sql('title', "'small gear urgent'")}
    + {similarity_sql('c.name', "'small gear urgent'")}
    + {similarity_sql('department', "'small gear urgent'")} AS DOUBLE) AS s
  FROM v_job j JOIN v_company c USING (company_id))
SELECT job_id, title, company_name, round(s, 5) AS similarity FROM scored WHERE s > 0.1""")
def _(v):
    found = search_index.search_jobs(search_store(v), v.job(), v.company(), "small gear urgent")
    return found.select("job_id", "title", "company_name",
                        F.round("similarity", 5).alias("similarity"))


@query("company_search_indexed", "P8 F11", f"""
WITH scored AS (SELECT company_id, name,
  CAST({similarity_sql('name', "'customer 12'")} AS DOUBLE) AS s FROM v_company)
SELECT company_id, name, round(s, 5) AS similarity FROM scored WHERE s > 0.1""")
def _(v):
    found = search_index.search_companies(search_store(v), v.company(), "customer 12")
    return found.select("company_id", "name", F.round("similarity", 5).alias("similarity"))


@query("exam_search_indexed", "P16 F11", f"""
WITH scored AS (SELECT exam_id, name, greatest(
  CAST({similarity_sql('name', "'blue gear'")} AS DOUBLE),
  CAST({similarity_sql('short_name', "'blue gear'")} AS DOUBLE),
  CAST({similarity_sql('body_name', "'blue gear'")} AS DOUBLE)) AS s
  FROM v_exam JOIN v_body USING (body_id))
SELECT exam_id, name, round(s, 5) AS similarity FROM scored WHERE s >= 0.3""")
def _(v):
    found = search_index.search_exams(search_store(v), v.exam(), v.body(), "blue gear")
    return found.select("exam_id", "name", F.round("similarity", 5).alias("similarity"))


@query("job_search_short", "P7", """
SELECT job_id, title FROM v_job j JOIN v_company c USING (company_id)
WHERE contains(lower(title), 'ge') OR contains(lower(c.name), 'ge')
  OR contains(lower(department), 'ge')""")
def _(v):
    return search.search_jobs(v.job(), v.company(), "Ge").select("job_id", "title")


@query("company_search", "P8 F11", f"""
WITH scored AS (SELECT company_id, name,
  CAST({similarity_sql('name', "'customer 12'")} AS DOUBLE) AS s FROM v_company)
SELECT company_id, name, round(s, 5) AS similarity FROM scored WHERE s > 0.1""")
def _(v):
    found = search.search_companies(v.company(), "customer 12")
    return found.select("company_id", "name", F.round("similarity", 5).alias("similarity"))


@query("company_filter", "P8 A8", """
WITH counted AS (
  SELECT company_id, count(*) FILTER (status = 'open' AND is_published AND NOT is_deleted) AS n
  FROM v_job GROUP BY company_id)
SELECT c.company_id, industry, coalesce(n, 0) AS open_jobs_count
FROM v_company c LEFT JOIN counted USING (company_id)
WHERE contains(lower(industry), 'build') AND coalesce(n, 0) > 0""")
def _(v):
    counted = aggregates.with_public_job_counts(v.company(), v.job())
    found = filters.filter_companies(counted, industry="BUILD", has_open_jobs=True)
    return found.select("company_id", "industry", "open_jobs_count")


@query("exam_search", "P16 F11", f"""
WITH scored AS (SELECT exam_id, name, greatest(
  CAST({similarity_sql('name', "'blue gear'")} AS DOUBLE),
  CAST({similarity_sql('short_name', "'blue gear'")} AS DOUBLE),
  CAST({similarity_sql('body_name', "'blue gear'")} AS DOUBLE)) AS s
  FROM v_exam JOIN v_body USING (body_id))
SELECT exam_id, name, round(s, 5) AS similarity FROM scored WHERE s >= 0.3""")
def _(v):
    found = search.search_exams(v.exam(), v.body(), "blue gear")
    return found.select("exam_id", "name", F.round("similarity", 5).alias("similarity"))


@query("exam_filter", "P15", """
SELECT exam_id, category, level, body_slug FROM v_exam JOIN v_body USING (body_id)
WHERE category IN ('ECONOMY', 'SMALL') AND level = 'national'""")
def _(v):
    found = filters.filter_exams(
        joins.with_body(v.exam(), v.body()), category="ECONOMY, SMALL", level="national"
    )
    return found.select("exam_id", "category", "level", "body_slug")


SCRAPABLE_SQL = """is_verified AND is_active AND NOT is_deleted AND career_url <> ''
  AND scrape_health <> 'paused'"""


@query("scrapable_companies", "P9", f"""
SELECT company_id FROM v_company WHERE {SCRAPABLE_SQL}""")
def _(v):
    return filters.scrapable(v.company()).select("company_id")


@query("companies_due", "P10 S16", f"""
SELECT company_id, name, career_url, career_source_type, next_scrape_at, scrape_health
FROM v_company WHERE {SCRAPABLE_SQL}
  AND (next_scrape_at IS NULL OR next_scrape_at <= TIMESTAMP '{AS_OF}')""")
def _(v):
    from ..sources.exports import due_report

    return due_report(v.company(), as_of())


@query("dispatch_set", "P11", f"""
SELECT company_id, next_scrape_at FROM v_company
WHERE is_verified AND is_active AND NOT is_deleted AND scrape_health <> 'failing'
  AND next_scrape_at <= TIMESTAMP '{AS_OF}'""")
def _(v):
    return filters.dispatch_set(v.company(), as_of()).select("company_id", "next_scrape_at")


@query("needs_attention", "P12", """
SELECT company_id, scrape_health, detection_status FROM v_company
WHERE scrape_health IN ('failing', 'paused')
  OR detection_status IN ('needs_review', 'failed', 'not_found')""")
def _(v):
    found = filters.needs_attention(v.company())
    return found.select("company_id", "scrape_health", "detection_status")


@query("pending_detection", "P13", """
SELECT company_id, created_at FROM v_company
WHERE NOT is_deleted AND detection_status = 'pending' ORDER BY created_at, company_id LIMIT 50""")
def _(v):
    return filters.pending_detection(v.company()).select("company_id", "created_at")


@query("public_companies", "P14 P26", """
WITH counted AS (
  SELECT company_id, count(*) FILTER (status = 'open' AND is_published AND NOT is_deleted) AS n
  FROM v_job GROUP BY company_id)
SELECT name, slug, domain, industry, coalesce(n, 0) AS open_jobs_count
FROM v_company c LEFT JOIN counted USING (company_id)
WHERE is_verified AND is_active AND NOT is_deleted""")
def _(v):
    from ..sources.exports import project_company

    return project_company(filters.public_companies(v.company()), v.job())


@query("applications_open", "P17 J4", f"""
SELECT exam_id, name FROM v_exam WHERE exam_id IN (
  SELECT exam_id FROM v_cycle WHERE is_published
    AND application_start <= DATE '{DAY}' AND application_end >= DATE '{DAY}')""")
def _(v):
    return filters.applications_open(v.exam(), v.cycle(), day()).select("exam_id", "name")


@query("upcoming_exams", "P18 J4", f"""
SELECT exam_id FROM v_exam WHERE exam_id IN (
  SELECT exam_id FROM v_cycle c LEFT JOIN v_stage s USING (cycle_id)
  WHERE c.is_published AND (
    c.notification_date BETWEEN DATE '{DAY}' AND DATE '{DAY}' + 5
    OR c.application_start BETWEEN DATE '{DAY}' AND DATE '{DAY}' + 5
    OR c.application_end BETWEEN DATE '{DAY}' AND DATE '{DAY}' + 5
    OR c.fee_last_date BETWEEN DATE '{DAY}' AND DATE '{DAY}' + 5
    OR c.result_date BETWEEN DATE '{DAY}' AND DATE '{DAY}' + 5
    OR s.date_start BETWEEN DATE '{DAY}' AND DATE '{DAY}' + 5
    OR s.admit_card_date BETWEEN DATE '{DAY}' AND DATE '{DAY}' + 5
    OR s.result_date BETWEEN DATE '{DAY}' AND DATE '{DAY}' + 5))""")
def _(v):
    return filters.upcoming(v.exam(), v.cycle(), v.stage(), day(), 5).select("exam_id")


@query("final_year_exams", "P19", """
SELECT exam_id FROM v_exam WHERE exam_id IN (
  SELECT exam_id FROM v_eligibility WHERE allow_final_year)""")
def _(v):
    return filters.allows_final_year(v.exam(), v.eligibility()).select("exam_id")


@query("published_cycles", "P20", """
SELECT cycle_id, exam_id, cycle_year, status, application_start FROM v_cycle
WHERE is_published AND status = 'announced' AND cycle_year = 1999""")
def _(v):
    found = filters.published_cycles(v.cycle(), status="announced", year=1999)
    return found.select("cycle_id", "exam_id", "cycle_year", "status", "application_start")


@query("admin_search", "P22", """
SELECT job_id, title, location_raw FROM v_job
WHERE (contains(lower(title), 'blue') OR contains(lower(location_raw), 'blue'))
  AND (contains(lower(title), 'brand#2') OR contains(lower(location_raw), 'brand#2'))
  AND status = 'open'""")
def _(v):
    found = filters.admin_search(
        v.job(), "Blue  brand#2", ["title", "location_raw"], {"status": "open"}
    )
    return found.select("job_id", "title", "location_raw")


@query("flag_fixtures", "P24", """
SELECT 'company' AS kind, company_id AS key,
  CASE WHEN is_verified THEN 'unverified' ELSE 'skip (already unverified)' END AS action
FROM v_company WHERE domain LIKE '%.example' OR domain LIKE '%.invalid'
  OR domain = 'example.com' OR regexp_matches(name,
    '^(Smoke|Bulk Co|Company |Probe|Due Now|Paused Inc|Failing Co|Click Lever|Burly Wood)')
UNION ALL
SELECT 'user', user_id,
  CASE WHEN is_active THEN 'deactivated' ELSE 'skip (already inactive)' END
FROM v_user WHERE lower(email) LIKE '%@example.com' OR lower(email) LIKE '%.invalid'""")
def _(v):
    return filters.flag_fixtures(v.company(), v.user())


@query("job_lookup", "P25", "SELECT job_id, title, slug FROM v_job WHERE job_id = 77")
def _(v):
    return filters.lookup(v.job(), "job_id", 77).select("job_id", "title", "slug")


@query("job_detail", "P26 J3 S10", """
WITH mine AS (SELECT DISTINCT job_id FROM v_saved WHERE user_id = 7)
SELECT j.job_id, j.slug, title, c.name AS company_name, location_raw, work_mode, job_type,
  department, posted_at, apply_url, mine.job_id IS NOT NULL AS is_saved,
  'about ' || title AS description, '<p>about ' || title || '</p>' AS description_html_sanitized,
  source_url, 'senior' AS experience_level, extraction_confidence, last_seen_at AS scraped_at,
  'https://site.example.org/jobs/' || j.slug AS canonical_url, title AS posting_title,
  '<p>about ' || title || '</p>' AS posting_text, c.name AS posting_company
FROM v_job j JOIN v_company c USING (company_id) LEFT JOIN mine ON mine.job_id = j.job_id
WHERE status = 'open' AND is_published AND NOT j.is_deleted""")
def _(v):
    from ..sources.exports import project_job_detail

    about = F.concat(F.lit("about "), F.col("title"))
    jobs = v.job().drop("salary_min", "salary_max").withColumns({
        "description": about, "experience_level": F.lit("senior"),
        "description_html_sanitized": F.concat(F.lit("<p>"), about, F.lit("</p>")),
    })
    live = joins.with_is_saved(filters.live_jobs(jobs), v.saved(), 7)
    shown = project_job_detail(live, v.company(), "https://site.example.org")
    found = F.from_json("structured_data", "title string, description string, "
                                           "hiringOrganization struct<name:string>")
    return shown.withColumn("_s", found).select(
        "job_id", "slug", "title", F.col("company.name").alias("company_name"), "location_raw",
        "work_mode", "job_type", "department", "posted_at", "apply_url", "is_saved",
        "description", "description_html_sanitized", "source_url", "experience_level",
        "extraction_confidence", "scraped_at", "canonical_url",
        F.col("_s.title").alias("posting_title"), F.col("_s.description").alias("posting_text"),
        F.col("_s.hiringOrganization.name").alias("posting_company"))


@query("company_detail", "P26 A8", """
WITH counted AS (
  SELECT company_id, count(*) FILTER (status = 'open' AND is_published AND NOT is_deleted) AS n
  FROM v_job GROUP BY company_id)
SELECT name, slug, domain, industry, coalesce(n, 0) AS open_jobs_count, career_url, is_verified
FROM v_company LEFT JOIN counted USING (company_id)""")
def _(v):
    from ..sources.exports import project_company_detail

    return project_company_detail(v.company(), v.job())


@query("job_list_projection", "P26 J3", """
WITH mine AS (SELECT DISTINCT job_id FROM v_saved WHERE user_id = 7)
SELECT j.job_id, j.slug, title, c.name AS company_name, c.slug AS company_slug,
  c.domain AS company_domain, location_raw, work_mode, job_type, department, posted_at,
  apply_url, mine.job_id IS NOT NULL AS is_saved
FROM v_job j JOIN v_company c USING (company_id) LEFT JOIN mine ON mine.job_id = j.job_id
WHERE status = 'open' AND is_published AND NOT j.is_deleted""")
def _(v):
    from ..sources.exports import project_job_list

    live = joins.with_is_saved(filters.live_jobs(v.job()), v.saved(), 7)
    listed = project_job_list(live, v.company())
    return listed.select(
        "job_id", "slug", "title", F.col("company.name").alias("company_name"),
        F.col("company.slug").alias("company_slug"),
        F.col("company.domain").alias("company_domain"), "location_raw", "work_mode", "job_type",
        "department", "posted_at", "apply_url", "is_saved",
    )


@query("exam_list_projection", "P26 W2", """
WITH newest AS (
  SELECT exam_id, arg_max(status, (cycle_year, created_at, cycle_id)) AS latest_cycle_status
  FROM v_cycle WHERE is_published GROUP BY exam_id)
SELECT exam_id, exam_slug, name, short_name, body_name, category, level, official_url, is_active,
  latest_cycle_status
FROM v_exam JOIN v_body USING (body_id) LEFT JOIN newest USING (exam_id)""")
def _(v):
    from ..sources.exports import project_exam_list

    listed = project_exam_list(v.exam(), v.body(), v.cycle())
    return listed.withColumn("body_name", F.col("conducting_body.body_name")).drop(
        "conducting_body"
    )


@query("companies_with_verifier", "J2", """
SELECT company_id, email AS verifier_email, u.is_active AS verifier_active
FROM v_company c LEFT JOIN v_user u ON u.user_id = c.verified_by""")
def _(v):
    return joins.with_verifier(v.company(), v.user()).select(
        "company_id", "verifier_email", "verifier_active"
    )


@query("jobs_seen_in_run", "J5", """
SELECT job_id, title FROM v_job WHERE job_id IN (
  SELECT job_id FROM v_status_event WHERE run_id = 5)""")
def _(v):
    return joins.seen_in_run(v.job(), v.status_event(), 5).select("job_id", "title")


@query("unseen_jobs", "J6", """
SELECT job_id, company_id FROM v_job WHERE job_id NOT IN (
  SELECT job_id FROM v_sighting WHERE seen_at >= TIMESTAMP '2000-01-01')""")
def _(v):
    seen = v.sighting().filter(F.col("seen_at") >= as_of("2000-01-01"))
    return joins.unseen_jobs(v.job(), seen).select("job_id", "company_id")


@query("exams_latest_status", "J7 W1", """
WITH newest AS (
  SELECT exam_id, arg_max(status, (cycle_year, cycle_label, cycle_id)) AS s
  FROM v_cycle WHERE is_published GROUP BY exam_id)
SELECT exam_id, name FROM v_exam JOIN newest USING (exam_id) WHERE s = 'applications_open'""")
def _(v):
    found = joins.exams_with_latest_status(v.exam(), v.cycle(), "applications_open")
    return found.select("exam_id", "name")


@query("latest_cycle_label", "W1", """
SELECT exam_id, cycle_id, status FROM v_cycle WHERE is_published QUALIFY row_number() OVER (
  PARTITION BY exam_id ORDER BY cycle_year DESC, cycle_label DESC, cycle_id DESC) = 1""")
def _(v):
    return joins.latest_cycle(v.cycle()).select("exam_id", "cycle_id", "status")


@query("latest_cycle_created", "W2", """
SELECT exam_id, cycle_id, status FROM v_cycle WHERE is_published QUALIFY row_number() OVER (
  PARTITION BY exam_id ORDER BY cycle_year DESC, created_at DESC, cycle_id DESC) = 1""")
def _(v):
    return joins.latest_cycle(v.cycle(), "created_at").select("exam_id", "cycle_id", "status")


@query("exam_documents", "J11", """
SELECT exam_id, 'exam' AS node, CAST(NULL AS BIGINT) AS cycle_id, CAST(0 AS BIGINT) AS ord,
  '{"name":"' || name || '","short_name":"' || short_name || '","category":"' || category
  || '","level":"' || level || '"}' AS body FROM v_exam
UNION ALL SELECT exam_id, 'cycle', cycle_id, 1, '{"cycle_year":' || cycle_year
  || ',"cycle_label":"' || cycle_label || '","status":"' || status || '"}' FROM v_cycle
UNION ALL SELECT exam_id, 'stage', cycle_id, stage_order + 1, '{"stage_order":' || stage_order
  || ',"stage_name":"' || stage_name || '","date_start":"' || date_start || '"}'
  FROM v_stage JOIN v_cycle USING (cycle_id)
UNION ALL SELECT exam_id, 'eligibility', NULL, 0, '{"allow_final_year":' || allow_final_year
  || '}' FROM v_eligibility""")
def _(v):
    return joins.exam_documents(v.exam(), v.cycle(), v.stage(), v.eligibility())


@query("saved_jobs", "J11", """
SELECT s.user_id, s.job_id, s.saved_at, j.title, c.name AS company_name
FROM v_saved s JOIN v_job j USING (job_id) JOIN v_company c USING (company_id)""")
def _(v):
    rows = joins.saved_jobs(v.saved(), v.job(), v.company())
    return rows.select("user_id", "job_id", "saved_at", "title", "company_name")


@query("saved_exams", "J12", """
SELECT exam_id, name FROM v_exam WHERE is_active AND exam_id IN (
  SELECT job_id FROM v_saved WHERE user_id = 11)""")
def _(v):
    saved = v.saved().withColumnRenamed("job_id", "exam_id")
    return joins.saved_exams(v.exam(), saved, 11).select("exam_id", "name")


@query("duplicate_companies", "J13", """
WITH incoming AS (
  SELECT company_id AS incoming_id, career_source_type, ats_identifier,
    CASE WHEN company_id % 3 = 0 THEN domain ELSE 'new' || domain END AS domain,
    CASE WHEN company_id % 2 = 0 THEN career_url ELSE '' END AS career_url FROM v_company),
by_board AS (SELECT career_source_type, ats_identifier, min(company_id) AS m FROM v_company
  WHERE NOT is_deleted AND ats_identifier <> '' GROUP BY ALL),
by_domain AS (SELECT domain, min(company_id) AS m FROM v_company WHERE NOT is_deleted
  GROUP BY domain),
by_url AS (SELECT career_url, min(company_id) AS m FROM v_company
  WHERE NOT is_deleted AND career_url <> '' GROUP BY career_url)
SELECT incoming_id,
  CASE WHEN b.m IS NOT NULL THEN 1 WHEN d.m IS NOT NULL THEN 2 WHEN u.m IS NOT NULL THEN 3 END
    AS match_rule,
  coalesce(b.m, d.m, u.m) AS match_id
FROM incoming i LEFT JOIN by_board b USING (career_source_type, ats_identifier)
LEFT JOIN by_domain d ON d.domain = i.domain LEFT JOIN by_url u ON u.career_url = i.career_url""")
def _(v):
    k = F.col("company_id")
    incoming = v.company().select(
        k.alias("incoming_id"), "career_source_type", "ats_identifier",
        F.when(k % 3 == 0, F.col("domain")).otherwise(
            F.concat(F.lit("new"), F.col("domain"))).alias("domain"),
        F.when(k % 2 == 0, F.col("career_url")).otherwise("").alias("career_url"),
    )
    found = joins.find_duplicate_companies(v.company(), incoming)
    return found.select("incoming_id", "match_rule", "match_id")


@query("resolve_duplicates", "J14", """
WITH RECURSIVE edges AS (
  SELECT job_id, CASE WHEN job_id % 1000 = 0 AND job_id > 0 THEN job_id + 1
    WHEN job_id % 1000 = 1 AND job_id > 1 THEN job_id - 1
    WHEN job_id % 7 <> 0 THEN job_id - 1 ELSE duplicate_of END AS duplicate_of FROM v_job),
links AS (SELECT * FROM edges WHERE duplicate_of IS NOT NULL),
walk AS (
  SELECT job_id, duplicate_of AS at, 1 AS steps FROM links
  UNION ALL
  SELECT w.job_id, l.duplicate_of, w.steps + 1 FROM walk w JOIN links l ON l.job_id = w.at
  WHERE w.steps < 40),
ends AS (SELECT w.job_id, w.at FROM walk w WHERE w.at NOT IN (SELECT job_id FROM links))
SELECT l.job_id, e.at AS root, e.at IS NULL AS in_circle
FROM links l LEFT JOIN ends e USING (job_id)""")
def _(v):
    k = F.col("job_id")
    edges = v.job().select(
        "job_id",
        F.when((k % 1000 == 0) & (k > 0), k + 1).when((k % 1000 == 1) & (k > 1), k - 1)
        .when(k % 7 != 0, k - 1).otherwise(F.col("duplicate_of")).alias("duplicate_of"),
    )
    return joins.resolve_duplicates(edges)


@query("order_nulls_last", "O1 O3", """
SELECT job_id, title, posted_at FROM v_job
WHERE status = 'open' AND is_published AND NOT is_deleted
ORDER BY posted_at DESC NULLS LAST, title, job_id LIMIT 20 OFFSET 40""")
def _(v):
    page = paging.paginate(
        filters.live_jobs(v.job()), paging.job_order("-posted_at,title"), page=3
    )
    return page.select("job_id", "title", "posted_at")


@query("default_job_page", "O1 O2 O3", """
SELECT job_id, posted_at FROM v_job WHERE status = 'open' AND is_published AND NOT is_deleted
ORDER BY posted_at DESC NULLS FIRST, job_id LIMIT 100""")
def _(v):
    page = paging.paginate(filters.live_jobs(v.job()), paging.job_order(), size=100)
    return page.select("job_id", "posted_at")


@query("page_total", "O3", """
SELECT count(*) AS count FROM v_job WHERE status = 'open' AND is_published AND NOT is_deleted""")
def _(v):
    return paging.total_count(filters.live_jobs(v.job()))


@query("order_companies", "O5", """
WITH counted AS (
  SELECT company_id, count(*) FILTER (status = 'open' AND is_published AND NOT is_deleted) AS n
  FROM v_job GROUP BY company_id)
SELECT company_id, name, coalesce(n, 0) AS open_jobs_count
FROM v_company LEFT JOIN counted USING (company_id)
WHERE is_verified AND is_active AND NOT is_deleted
ORDER BY open_jobs_count DESC, company_id LIMIT 20""")
def _(v):
    counted = aggregates.with_public_job_counts(filters.public_companies(v.company()), v.job())
    page = paging.paginate(counted, paging.company_order("-open_jobs_count"))
    return page.select("company_id", "name", "open_jobs_count")


@query("exam_calendar", "U1", f"""
WITH d AS (
  SELECT cycle_id, notification_date AS date, 'notification' AS event_type, NULL AS stage_name,
    false AS is_tentative FROM v_cycle
  UNION ALL SELECT cycle_id, application_start, 'application_start', NULL, false FROM v_cycle
  UNION ALL SELECT cycle_id, application_end, 'application_end', NULL, false FROM v_cycle
  UNION ALL SELECT cycle_id, fee_last_date, 'fee_last_date', NULL, false FROM v_cycle
  UNION ALL SELECT cycle_id, correction_window_start, 'correction_start', NULL, false FROM v_cycle
  UNION ALL SELECT cycle_id, correction_window_end, 'correction_end', NULL, false FROM v_cycle
  UNION ALL SELECT cycle_id, result_date, 'result', NULL, false FROM v_cycle
  UNION ALL SELECT cycle_id, date_start, 'stage_exam', stage_name, is_date_tentative FROM v_stage
  UNION ALL SELECT cycle_id, admit_card_date, 'admit_card', stage_name, is_date_tentative
    FROM v_stage
  UNION ALL SELECT cycle_id, result_date, 'stage_result', stage_name, is_date_tentative
    FROM v_stage)
SELECT date, event_type, e.name AS exam_name, exam_slug, cycle_label, stage_name, is_tentative,
  CASE WHEN official_notification_url <> '' THEN official_notification_url
    ELSE official_url END AS official_url
FROM d JOIN v_cycle c USING (cycle_id) JOIN v_exam e USING (exam_id)
WHERE c.is_published AND date BETWEEN DATE '{DAY}' AND DATE '{DAY}' + 90""")
def _(v):
    return calendar.exam_calendar(v.exam(), v.cycle(), v.stage(), day())


@query("keep_first_urls", "W5 F1", """
SELECT regexp_replace(url, '[?#].*$', '') AS bare, min(page_id) AS page_id FROM pages GROUP BY 1""")
def _(v):
    pages = v.table("pages").select(
        F.regexp_replace("url", "[?#].*$", "").alias("bare"), "page_id"
    )
    return history.keep_first(pages, ["bare"], ["page_id"])


@query("cap_per_group", "W6", """
SELECT company_id, job_id FROM v_job QUALIFY row_number() OVER (
  PARTITION BY company_id ORDER BY posted_at DESC NULLS LAST, job_id) <= 3""")
def _(v):
    jobs = v.job().select("company_id", "job_id", "posted_at")
    capped = history.cap_per_group(
        jobs, ["company_id"], 3, [F.col("posted_at").desc_nulls_last(), F.col("job_id")]
    )
    return capped.select("company_id", "job_id")

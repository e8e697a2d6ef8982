"""Column functions over URLs, pages, documents and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, rules, texts, urls
from ..operators import exams, history
from .registry import query
from .views import AS_OF, as_of

@query("normalize_urls", "F1", r"""
WITH parts AS (
  SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
    lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
    regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1),
      '/+$', ''), '/{2,}', '/', 'g') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS pairs
  FROM pages)
SELECT page_id, scheme || '://' || host || path
  || CASE WHEN len(pairs) = 0 THEN '' ELSE '?' || array_to_string(pairs, '&') END AS norm
FROM parts""")
def _(v):
    return v.table("pages").select("page_id", urls.normalize_url("url").alias("norm"))


@query("registrable_domains", "F2 F3 F4", r"""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS raw FROM pages)
SELECT page_id, regexp_replace(raw, '^www\.', '') AS host,
  CASE WHEN starts_with(raw, 'www.') THEN substr(raw, 5) ELSE raw END AS registrable,
  raw LIKE '%.example.com' AS own
FROM h""")
def _(v):
    raw = urls.host_of("url", strip_www=False)
    return v.table("pages").select(
        "page_id", urls.host_of("url").alias("host"),
        urls.registrable_domain(raw).alias("registrable"),
        urls.is_own_host(raw, F.lit("example.com")).alias("own"),
    )


def career_urls(v):
    """Career addresses of all dialects, made from the customer table."""
    k = F.col("c_custkey")

    def at(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    forms = (
        at("https://boards.greenhouse.io/org", k, "/jobs/", k),
        at("jobs.lever.co/org", k),
        at("https://ORG", k, ".ashbyhq.com/open"),
        at("https://careers.smartrecruiters.com/org", k, "/all"),
        at("https://org", k, ".myworkdayjobs.com/careers"),
        at("https://in.linkedin.com/jobs/", k),
        at("https://careers.c", k, ".example.org/"),
        at("http://www.c", k, ".example.org/about"),
    )
    return v.table("customer").select(
        k.alias("company_id"), F.element_at(F.array(*forms), (k % 8 + 1).cast("int")).alias("url")
    )


CAREER_URLS_SQL = """
career_urls AS (SELECT c_custkey AS company_id, c_custkey % 8 AS form, CASE c_custkey % 8
  WHEN 0 THEN 'https://boards.greenhouse.io/org' || c_custkey || '/jobs/' || c_custkey
  WHEN 1 THEN 'jobs.lever.co/org' || c_custkey
  WHEN 2 THEN 'https://ORG' || c_custkey || '.ashbyhq.com/open'
  WHEN 3 THEN 'https://careers.smartrecruiters.com/org' || c_custkey || '/all'
  WHEN 4 THEN 'https://org' || c_custkey || '.myworkdayjobs.com/careers'
  WHEN 5 THEN 'https://in.linkedin.com/jobs/' || c_custkey
  WHEN 6 THEN 'https://careers.c' || c_custkey || '.example.org/'
  ELSE 'http://www.c' || c_custkey || '.example.org/about' END AS url FROM customer)"""


@query("sniff_sources", "F5 J9", f"""
WITH {CAREER_URLS_SQL}
SELECT company_id,
  CASE form WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby'
    WHEN 3 THEN 'smartrecruiters' WHEN 4 THEN 'workday' WHEN 5 THEN NULL
    ELSE 'own_career_page' END AS source_type,
  CASE WHEN form < 4 THEN 'org' || company_id WHEN form = 5 THEN NULL ELSE '' END AS identifier,
  form = 5 AS blocked FROM career_urls""")
def _(v):
    return career_urls(v).select("company_id", urls.sniff_source("url").alias("s")).select(
        "company_id", "s.*"
    )


@query("host_flags", "F6 P21", f"""
WITH {CAREER_URLS_SQL}
SELECT company_id, form = 5 AS blocked, form < 5 AS ats, form = 4 AS workday,
  form IN (1, 3, 6) AS career_subdomain FROM career_urls""")
def _(v):
    rows = career_urls(v).withColumn("host", urls.host_of("url", strip_www=False))
    return rows.select("company_id", urls.host_flags("host").alias("f")).select(
        "company_id", "f.*"
    )


@query("drop_blocked", "P21", f"""
WITH {CAREER_URLS_SQL} SELECT company_id FROM career_urls WHERE form <> 5""")
def _(v):
    from ..operators.filters import drop_blocked

    return drop_blocked(career_urls(v), "url").select("company_id")


@query("title_hash", "F7 F8", r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]+', '', 'g'),
    '^\s+|\s+$', '', 'g')) AS title_sha,
  sha256(lang || chr(31) || source || chr(31) || text) AS content_hash
FROM documents""")
def _(v):
    return v.table("documents").select(
        "doc_id", F.sha2(texts.title_normalized("text"), 256).alias("title_sha"),
        texts.content_hash(F.col("lang"), F.col("source"), F.col("text")).alias("content_hash"),
    )


@query("strip_html", "F13", r"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html,
  '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g') AS h FROM pages)
SELECT page_id, sha256(trim(regexp_replace(regexp_replace(h, '<[^>]+>', '', 'g'),
  '\s+', ' ', 'g'))) AS text_sha FROM t""")
def _(v):
    return v.table("pages").select("page_id", F.sha2(texts.strip_html("html"), 256).alias(
        "text_sha"))


VISIBLE_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"""


@query("visible_text", "F14 F16", rf"""
WITH t AS (SELECT page_id, {VISIBLE_SQL} AS text FROM pages)
SELECT page_id, sha256(text) AS text_sha, CAST(length(text) AS INTEGER) AS chars,
  regexp_matches(lower(text), '\bno\s+(?:open\s+)?(?:positions|roles|vacancies)\b|\bnothing available\b|\bnot currently hiring\b|\bno\s+job\s+opportunities\b|\bno\s+(?:open\s+)?recruitments?\b')
    AS no_openings
FROM t""")
def _(v):
    text = texts.visible_text("html")
    return v.table("pages").select(
        "page_id", F.sha2(text, 256).alias("text_sha"), F.length(text).alias("chars"),
        texts.no_openings("html").alias("no_openings"),
    )


@query("page_titles", "F15", r"""
SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1),
  '<[^>]+>', '', 'g')) AS title FROM pages""")
def _(v):
    return v.table("pages").select("page_id", texts.page_title("html").alias("title"))


@query("render_reasons", "F42", rf"""
WITH t AS (SELECT page_id, CAST(length({VISIBLE_SQL}) AS INTEGER) AS chars,
  len(regexp_extract_all(html, '(?i)<a\s[^>]*href')) AS links FROM pages)
SELECT page_id, concat_ws('; ', CASE WHEN links < 5 THEN 'only ' || links || ' anchors' END,
  CASE WHEN chars < 500 THEN 'visible text ' || chars || ' chars' END) AS reasons FROM t""")
def _(v):
    links = F.regexp_count("html", F.lit(r"(?i)<a\s[^>]*href"))
    return v.table("pages").select(
        "page_id", texts.render_reasons(F.col("html"), links).alias("reasons")
    )


@query("work_modes", "F12", """
WITH t AS (SELECT doc_id, lower(source || ' ' || text) AS b FROM documents)
SELECT doc_id, CASE WHEN contains(b, 'hybrid') THEN 'hybrid'
  WHEN contains(b, 'remote') OR contains(b, 'work from home') OR contains(b, 'wfh') THEN 'remote'
  WHEN contains(b, 'onsite') OR contains(b, 'on-site') OR contains(b, 'in office') THEN 'onsite'
  ELSE '' END AS work_mode FROM t""")
def _(v):
    mode = texts.work_mode_from_text(F.col("source"), F.col("text"))
    return v.table("documents").select("doc_id", mode.alias("work_mode"))


@query("keyword_links", "F17 F18 F19", rf"""
WITH {CAREER_URLS_SQL},
u AS (SELECT company_id, form, url, regexp_replace(regexp_replace(url, '^https?://', ''),
  '^[^/]*', '') AS path FROM career_urls)
SELECT company_id,
  regexp_matches(path, '(?i)(^|[/_-])(career|job|vacancy|vacancies|opening|hiring|opportunities|recruitment|employment)')
    AS career_path,
  form = 5 OR regexp_matches(lower(url),
    '(^|[^a-z0-9])(careers?|jobs?)([^a-z0-9]|$)') AS career_text,
  CASE form WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN false
    WHEN 4 THEN false WHEN 5 THEN true ELSE false END AS job_link
FROM u""")
def _(v):
    rows = career_urls(v).withColumn("full", urls.with_scheme(F.col("url")))
    return rows.select(
        "company_id",
        texts.path_has_keyword(urls.path_of("full")).alias("career_path"),
        texts.text_has_keyword("url").alias("career_text"),
        texts.is_job_link("full", F.lit("")).alias("job_link"),
    )


@query("trust_labels", "F28", f"""
SELECT job_id, concat_ws(' | ',
  CASE WHEN is_verified AND career_source_type IN ('greenhouse', 'lever', 'ashby',
    'smartrecruiters') THEN 'Verified source'
    WHEN career_source_type = 'own_career_page' THEN 'Official career page' END,
  CASE WHEN last_seen_at >= TIMESTAMP '2001-08-01' - INTERVAL 6 HOURS THEN 'Checked recently'
    END) AS trust_label
FROM v_job JOIN v_company USING (company_id)""")
def _(v):
    firm = v.company().select("company_id", "career_source_type", "is_verified")
    return v.job().join(firm, "company_id").select(
        "job_id",
        rules.trust_label(F.col("career_source_type"), F.col("is_verified"),
                          F.col("last_seen_at"), as_of("2001-08-01")).alias("trust_label"),
    )


@query("job_ages", "F26 F27", f"""
SELECT job_id,
  CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(coalesce(posted_at, first_seen_at)))
    / 86400000000) AS BIGINT) AS age_days,
  coalesce(posted_at, first_seen_at) AS date_posted, first_seen_at + to_days(60) AS valid_through
FROM v_job""")
def _(v):
    posted, seen = F.col("posted_at"), F.col("first_seen_at")
    return v.job().select(
        "job_id", rules.age_days(posted, seen, as_of()).alias("age_days"),
        rules.date_posted(posted, seen).alias("date_posted"),
        rules.valid_through(F.lit(None).cast("timestamp_ntz"), seen).alias("valid_through"),
    )


@query("next_scrape", "F32 F33 F34 F35", f"""
WITH b AS (SELECT *, scrape_interval_minutes * CASE WHEN consecutive_failures <= 1 THEN 1
  ELSE CAST(2 ** (consecutive_failures - 1) AS BIGINT) END AS base FROM v_company)
SELECT company_id, TIMESTAMP '{AS_OF}' + to_minutes(CAST(least(base, 1440)
    + company_id % greatest(1, least(base, 60)) AS INTEGER)) AS next_at,
  CASE WHEN consecutive_failures = 0 THEN 'healthy' WHEN consecutive_failures <= 2 THEN 'degraded'
    WHEN consecutive_failures <= 4 THEN 'failing' ELSE 'paused' END AS health,
  CASE detection_status WHEN 'pending' THEN 'enqueued' WHEN 'verified' THEN 'clean'
    WHEN 'failed' THEN 'retry' ELSE 'review' END AS action
FROM b""")
def _(v):
    failures = F.col("consecutive_failures")
    return v.company().select(
        "company_id",
        rules.next_scrape_at(
            as_of(), F.col("scrape_interval_minutes"), F.col("company_id"),
            rules.backoff_factor(failures),
        ).alias("next_at"),
        rules.health_for(failures).alias("health"),
        rules.next_action("detection_status").alias("action"),
    )


@query("adaptive_interval", "F31 W4 M24", """
WITH ranked AS (SELECT company_id, jobs_added, jobs_missing, row_number() OVER (
  PARTITION BY company_id ORDER BY finished_at DESC, run_id DESC) AS nth
  FROM v_run WHERE verdict = 'trusted'),
r AS (SELECT company_id, count(*) AS n, bool_and(jobs_added = 0 AND jobs_missing = 0) AS idle,
  max(jobs_added) FILTER (nth = 1) AS newest FROM ranked WHERE nth <= 3 GROUP BY company_id)
SELECT company_id, CAST(CASE WHEN n < 3 THEN scrape_interval_minutes
  WHEN idle THEN least(scrape_interval_minutes * 2, 1440)
  WHEN newest > 0 THEN greatest(scrape_interval_minutes // 2, 30)
  ELSE scrape_interval_minutes END AS INTEGER) AS new_interval
FROM v_company JOIN r USING (company_id)""")
def _(v):
    recent = history.recent_trusted(v.run())
    return v.company().join(recent, "company_id").select(
        "company_id",
        rules.adaptive_interval(F.col("scrape_interval_minutes"), F.col("recent"))
        .cast("int").alias("new_interval"),
    )


@query("run_verdicts", "F36 W3", """
WITH b AS (SELECT *, coalesce(last_value(CASE WHEN status = 'success' THEN jobs_found END
  IGNORE NULLS) OVER (PARTITION BY company_id ORDER BY finished_at, run_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS baseline FROM v_run)
SELECT run_id,
  CASE WHEN status <> 'success' THEN 'untrusted' WHEN baseline < 5 THEN 'trusted'
    WHEN jobs_found = 0 OR jobs_found < baseline * 0.5 THEN 'quarantined' ELSE 'trusted' END
    AS verdict,
  CASE WHEN status <> 'success' THEN 'Run status is ' || status
    WHEN baseline < 5 THEN 'Below baseline (' || baseline || ' < 5)'
    WHEN jobs_found = 0 THEN 'Found 0 jobs (last had ' || baseline || ')'
    WHEN jobs_found < baseline * 0.5 THEN 'Drop ratio ' || jobs_found || '/' || baseline
      || ' < 0.5' ELSE 'Within acceptable range' END AS reason
FROM b""")
def _(v):
    runs = history.with_baseline(v.run())
    verdict = rules.run_verdict(F.col("status"), F.col("jobs_found"), F.col("baseline"))
    return runs.select("run_id", verdict.alias("v")).select("run_id", "v.*")


@query("eligibility_checks", "F27 F29 F30", """
WITH pairs AS (SELECT DISTINCT user_id, job_id % (SELECT count(*) FROM part) AS exam_id
  FROM v_saved),
j AS (SELECT p.user_id, p.exam_id, u.*, e.min_age, e.max_age, e.allow_final_year,
  CAST(date_part('year', DATE '2001-11-05') - date_part('year', date_of_birth)
    - CASE WHEN strftime(DATE '2001-11-05', '%m%d') < strftime(date_of_birth, '%m%d')
      THEN 1 ELSE 0 END AS INTEGER) AS age
  FROM pairs p JOIN v_user u ON u.user_id = p.user_id JOIN v_eligibility e
    ON e.exam_id = p.exam_id),
lim AS (SELECT *, max_age + greatest(
    CASE WHEN category IN ('SC', 'ST') THEN 5 WHEN category = 'OBC' THEN 3 ELSE 0 END,
    CASE WHEN is_pwbd THEN CASE WHEN category IN ('SC', 'ST') THEN 15
      WHEN category = 'OBC' THEN 13 ELSE 10 END ELSE 0 END,
    CASE WHEN is_ex_serviceman THEN greatest(0, 8 - service_years) ELSE 0 END) AS age_limit
  FROM j)
SELECT user_id, exam_id, age, CAST(age_limit AS INTEGER) AS age_limit,
  coalesce(age >= min_age, true) AND coalesce(age <= age_limit, true)
    AND (allow_final_year OR NOT is_final_year) AS eligible
FROM lim""")
def _(v):
    n = v.table("part").select(F.count(F.lit(1))).scalar()
    pairs = v.saved().select("user_id", F.pmod("job_id", n).alias("exam_id")).distinct()
    checked = exams.eligibility_checks(
        pairs, v.user(), v.eligibility(), F.lit("2001-11-05").cast("date")
    )
    return checked.select("user_id", "exam_id", "age", "age_limit", "eligible")


def notices(v):
    """Order dates rendered into short notices in the four written forms."""
    day = F.col("o_orderdate")
    text = F.concat(
        F.lit("Notice "), F.col("o_orderkey").cast("string"), F.lit(": apply by "),
        F.date_format(day, "dd-MM-yyyy"), F.lit(", fee until "),
        F.date_format(day, "yyyy/MM/dd"), F.lit(".\nExam on "),
        F.date_format(day, "MMM d, yyyy"), F.lit(" and result on "),
        F.date_format(day, "d MMMM yyyy"), F.lit("; again: apply by "),
        F.date_format(day, "dd-MM-yyyy"),
    )
    return v.table("orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


@query("date_candidates", "F37", r"""
WITH t AS (SELECT o_orderkey AS doc_id, o_orderdate AS d, 'Notice ' || o_orderkey || ': apply by '
  || strftime(o_orderdate, '%d-%m-%Y') || ', fee until ' || strftime(o_orderdate, '%Y/%m/%d')
  || '.' || chr(10) || 'Exam on ' || strftime(o_orderdate, '%b %-d, %Y') || ' and result on '
  || strftime(o_orderdate, '%-d %B %Y') || '; again: apply by '
  || strftime(o_orderdate, '%d-%m-%Y') AS text FROM orders),
p AS (
  SELECT *, 0 AS pos, 'day-month-year' AS hint, strftime(d, '%d-%m-%Y') AS raw FROM t
  UNION ALL SELECT *, 1, 'year-month-day', strftime(d, '%Y/%m/%d') FROM t
  UNION ALL SELECT *, 2, 'month-day-year', strftime(d, '%b %-d, %Y') FROM t
  UNION ALL SELECT *, 3, 'day-month-year-text', strftime(d, '%-d %B %Y') FROM t)
SELECT doc_id, pos, raw, hint, CAST(d AS DATE) AS parsed,
  replace(substr(text, greatest(instr(text, raw) - 30, 1),
    length(raw) + 30 + least(instr(text, raw) - 1, 30)), chr(10), ' ') AS context,
  pos < 2 AND day(d) <= 12 AND day(d) <> month(d) AS ambiguous
FROM p""")
def _(v):
    return dates.date_candidates(notices(v), "doc_id", "text", 2001)


@query("date_candidates_documents", "F37", r"""
WITH m AS (SELECT doc_id, unnest(list_concat(
    regexp_extract_all(text, '\b\d{1,2}[-\s/]\d{1,2}[-\s/]\d{2,4}\b'),
    regexp_extract_all(text, '\b\d{2,4}[-\s/]\d{1,2}[-\s/]\d{1,2}\b'),
    regexp_extract_all(text, '(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b'),
    regexp_extract_all(text, '(?i)\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}\b')
  )) AS raw FROM documents)
SELECT DISTINCT doc_id, raw FROM m""")
def _(v):
    found = dates.date_candidates(v.table("documents"), "doc_id", "text", 2024)
    return found.select("doc_id", "raw")


@query("clamped_confidence", "F10", """
SELECT event_id, CAST(CASE WHEN event_id % 7 = 0 THEN 0
  ELSE greatest(0, least(100, event_id % 251 - 60)) END AS INTEGER) AS confidence FROM events""")
def _(v):
    """Claimed confidences from -60 to 190 as texts; every seventh is no number, or missing."""
    k = F.col("event_id")
    claimed = F.when(k % 14 == 0, F.lit(None)).when(k % 7 == 0, F.lit("high")).otherwise(
        (k % 251 - 60).cast("string"))
    return v.table("events").select("event_id", texts.clamp_confidence(claimed).alias("confidence"))


@query("job_slugs", "F9 M28", r"""
SELECT job_id, left(trim(regexp_replace(regexp_replace(lower(title || '-' || c.name || '-'
  || location_raw), '[^a-z0-9_\s-]', '', 'g'), '[-\s]+', '-', 'g'), '-_'), 311)
  || '-' || left(CAST(job_id AS VARCHAR), 8) AS slug
FROM v_job JOIN v_company c USING (company_id)""")
def _(v):
    named = v.company().select("company_id", F.col("name").alias("company_name"))
    return v.job().join(named, "company_id").select(
        "job_id",
        texts.job_slug(F.col("title"), F.col("company_name"), F.col("location_raw"),
                       F.col("job_id"), fold=False).alias("slug"),
    )


@query("document_slugs", "F9")
def _(v):
    return v.table("documents").select("doc_id", texts.slugify("text").alias("slug"))


@query("sanitized_pages", "F40")
def _(v):
    from ..functions.sanitize import sanitize_html

    return v.table("pages").select("page_id", F.sha2(sanitize_html("html"), 256).alias("sha"))


@query("client_ips", "F39", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || user_id
  ELSE '203.0.113.' || user_id END AS ip FROM events""")
def _(v):
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    hop = F.concat(F.lit(" 203.0.113."), u, F.lit(" , 10.1.1.1"))
    forwarded = F.when(k % 3 == 0, F.lit("")).otherwise(hop)
    remote = F.concat(F.lit("10.0.0."), u)
    return v.table("events").select("event_id", urls.client_ip(forwarded, remote).alias("ip"))


@query("uuid_spread", "F33", """
SELECT event_id, CAST(CAST(event_id * 7919 + 12345 AS HUGEINT) * 18446744073709551616
  % 60 AS BIGINT) AS jitter FROM events""")
def _(v):
    high = F.lpad(F.lower(F.hex(F.col("event_id") * 7919 + 12345)), 16, "0")
    text = F.concat_ws("-", F.substring(high, 1, 8), F.substring(high, 9, 4),
                       F.substring(high, 13, 4), F.lit("0000"), F.lit("000000000000"))
    return v.table("events").select(
        "event_id", rules.uuid_mod(text, F.lit(60)).alias("jitter")
    )

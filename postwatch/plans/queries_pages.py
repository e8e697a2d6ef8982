"""Page corpus queries: harvesting, link graph, scoring, ranking, robots, sitemaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import aggregates, discovery
from ..sources import pages as page_source
from ..sources import robots, sitemaps
from .queries_text import CAREER_URLS_SQL, career_urls
from .registry import query
from .views import as_of

ORIGIN_SQL = "regexp_extract(url, '^[a-z]+://[^/?#]*')"
HOST_SQL = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"
ANCHORS_SQL = r"""
tags AS (SELECT page_id, url, html, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS tag FROM (
  SELECT page_id, url, html, regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>') AS t FROM pages)),
anchors AS (SELECT page_id, url, pos, regexp_extract(tag, 'href="([^"]*)"', 1) AS href,
    trim(regexp_replace(tag, '<[^>]+>', '', 'g')) AS text,
    contains(regexp_extract(html, '(?is)<nav>.*?</nav>'), tag) AS in_nav FROM tags)"""


@query("harvest_postings", "S5 W5 W6", rf"""
WITH {ANCHORS_SQL},
ok AS (SELECT page_id, pos, {ORIGIN_SQL} || href AS source_url, text AS title FROM anchors
  WHERE length(text) BETWEEN 5 AND 120 AND starts_with(href, '/')),
first AS (SELECT *, row_number() OVER (PARTITION BY page_id, source_url ORDER BY pos) AS n
  FROM ok)
SELECT page_id, source_url, title FROM first WHERE n = 1""")
def _(v):
    pages = v.table("pages").withColumn("career_url", F.col("url"))
    return page_source.harvest_postings(pages).select("page_id", "source_url", "title")


@query("link_graph", "D1", rf"""
WITH {ANCHORS_SQL},
full_links AS (SELECT page_id, pos, {ORIGIN_SQL} || href AS href, text, in_nav FROM anchors),
spread AS (SELECT page_id, pos, href, text, 'all' AS region FROM full_links
  UNION ALL SELECT page_id, pos, href, text, 'header' FROM full_links WHERE in_nav)
SELECT page_id, region, href, text FROM spread QUALIFY row_number() OVER (
  PARTITION BY page_id, region, href ORDER BY pos) = 1""")
def _(v):
    facts = page_source.page_facts(v.table("pages"))
    return page_source.link_graph(facts).select("page_id", "region", "href", "text")


def marked_pages(v):
    """The corpus with career links, board links and structured data put into some pages, and
    every page as the home page of a company of its own."""
    k = F.col("page_id")
    label = F.concat(F.lit("firm"), k.cast("string"))
    nav = F.concat(
        F.lit("<nav><a href=\"/careers/open\">Careers</a>"),
        F.when(k % 3 == 0, F.concat(
            F.lit("<a href=\"https://boards.greenhouse.io/"), label, F.lit("\">Join us</a>")
        )).otherwise(""),
    )
    data = F.when(
        k % 5 == 0,
        F.lit("<script type=\"application/ld+json\">{\"@graph\":[{\"@type\":\"JobPosting\","
              "\"title\":\"Engineer\"}]}</script>"),
    ).otherwise("")
    html = F.concat(F.replace("html", F.lit("<nav>"), nav), data)
    site = F.concat(F.lit("https://"), label, F.lit(".example.net"))
    base = v.table("pages").select("page_id", site.alias("site"), html.alias("html"))
    home = base.select(
        (k * 2).alias("page_id"), F.concat("site", F.lit("/")).alias("url"), "html")
    careers = base.select(
        (k * 2 + 1).alias("page_id"), F.concat("site", F.lit("/careers/open")).alias("url"), "html"
    )
    pages = home.unionByName(careers).withColumn("final_url", F.col("url")).withColumn(
        "status", F.lit(200)
    )
    companies = v.table("pages").select(
        k.alias("company_id"), F.concat(label, F.lit(".example.net")).alias("domain"),
        label.alias("slug"),
    )
    return companies, pages


@query("jsonld_postings", "S11 D7", """
SELECT page_id * 2 + h AS page_id, page_id % 5 = 0 AS has_posting,
  CAST(CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS posting_count,
  CASE WHEN page_id % 5 = 0 THEN 'Engineer' ELSE '' END AS titles
FROM pages, (SELECT unnest([0, 1]) AS h)""")
def _(v):
    _, pages = marked_pages(v)
    return page_source.page_facts(pages).select(
        "page_id", "has_posting", "posting_count",
        F.array_join("posting_titles", ",").alias("titles"),
    )


@query("nav_candidates", "D3 F17 F18", """
SELECT page_id AS company_id, 'https://firm' || page_id || '.example.net/careers/open' AS url,
  'header link: Careers' AS via FROM pages
UNION ALL SELECT page_id, 'https://boards.greenhouse.io/firm' || page_id, 'header link: Join us'
FROM pages WHERE page_id % 3 = 0""")
def _(v):
    companies, pages = marked_pages(v)
    facts = page_source.page_facts(pages)
    links = discovery.home_links(companies, pages, facts)
    return discovery.nav_candidates(links).select("company_id", "url", "via")


@query("ats_candidates", "D2", """
SELECT page_id AS company_id, 'https://boards.greenhouse.io/firm' || page_id AS url,
  'greenhouse' AS ats_source, 'firm' || page_id AS ats_identifier FROM pages
WHERE page_id % 3 = 0""")
def _(v):
    companies, pages = marked_pages(v)
    facts = page_source.page_facts(pages)
    links = discovery.home_links(companies, pages, facts)
    return discovery.ats_candidates(companies, links, pages, facts).select(
        "company_id", "url", "ats_source", "ats_identifier"
    )


@query("detect_career_pages", "D1 D2 D3 D6 D7 D8 D9 D11 D12 D13 D14", """
SELECT page_id AS company_id, CASE WHEN page_id % 3 = 0
    THEN 'https://boards.greenhouse.io/firm' || page_id
    ELSE 'https://firm' || page_id || '.example.net/careers/open' END AS url,
  CASE WHEN page_id % 3 = 0 THEN 'ats_pattern' ELSE 'header_link' END AS origin
FROM pages""")
def _(v):
    companies, pages = marked_pages(v)
    facts = page_source.page_facts(pages)
    ranked = discovery.detect(companies, pages, facts)
    return ranked.filter(F.col("rank") == 1).select("company_id", "url", "origin")


@query("detection_results", "D8 D12 D13 D14 A15", """
SELECT page_id AS company_id, CAST(CASE WHEN page_id % 3 = 0 THEN 55
    WHEN page_id % 5 = 0 THEN 65 ELSE 35 END AS INTEGER) AS best_score,
  CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END AS candidates_found FROM pages""")
def _(v):
    companies, pages = marked_pages(v)
    facts = page_source.page_facts(pages)
    ranked = discovery.detect(companies, pages, facts)
    return aggregates.detection_summary(ranked)


def scored_candidates(v):
    k = F.col("company_id")
    rows = career_urls(v).select(
        "company_id", urls.normalize_url(urls.with_scheme(F.col("url"))).alias("url"),
        F.when(k % 8 < 4, "ats_pattern").when(k % 2 == 0, "header_link").otherwise("sitemap")
        .alias("origin"),
        F.lit("").alias("via"),
        *[F.lit(None).cast("boolean").alias(f) for f in discovery.FLAGS
          if f not in ("http_200", "nav_header", "in_sitemap", "title_keyword")],
        (k % 2 == 0).alias("http_200"), (k % 3 == 0).alias("nav_header"),
        (k % 5 == 0).alias("in_sitemap"), (k % 7 == 0).alias("title_keyword"),
        F.when(k % 11 == 0, 404).otherwise(200).alias("http_status"),
        F.lit(None).cast("string").alias("ats_source"),
        F.lit("").alias("ats_identifier"), F.lit("").alias("content_type"),
        F.lit("").alias("page_title"), F.array().cast("array<string>").alias("sample_job_titles"),
        F.concat(F.lit("c"), k.cast("string"), F.lit(".example.org")).alias("domain"),
    )
    return discovery.score_candidates(rows)


SCORES_SQL = f"""{CAREER_URLS_SQL},
raw AS (SELECT company_id, form, CASE
    WHEN form = 5 OR company_id % 11 = 0 THEN 0 ELSE
    CASE form WHEN 0 THEN 55 WHEN 1 THEN 58 WHEN 2 THEN 65 - 25 WHEN 3 THEN 40 + 18 - 10
      WHEN 4 THEN 25 - 20 WHEN 6 THEN 18 ELSE 0 END
    + CASE WHEN company_id % 2 = 0 THEN 5 ELSE 0 END + CASE WHEN company_id % 3 = 0 THEN 15 ELSE 0
      END + CASE WHEN company_id % 5 = 0 THEN 10 ELSE 0 END
    + CASE WHEN company_id % 7 = 0 THEN 15 ELSE 0 END END AS s FROM career_urls),
scores AS (SELECT company_id, form, CAST(greatest(0, least(100, s)) AS INTEGER) AS score FROM raw)"""


@query("score_candidates", "D12", f"""
WITH {SCORES_SQL}
SELECT company_id, score,
  CASE WHEN form = 5 THEN 'blocked_domain' WHEN company_id % 11 = 0 THEN 'bad_status' ELSE
  concat_ws(',', CASE WHEN form < 4 THEN 'ats_host' END,
    CASE WHEN form IN (0, 4) THEN 'career_path_keyword' END,
    CASE WHEN form IN (1, 3, 6) THEN 'career_subdomain' END,
    CASE WHEN company_id % 3 = 0 THEN 'nav_header' END,
    CASE WHEN company_id % 7 = 0 THEN 'title_keyword' END,
    CASE WHEN company_id % 5 = 0 THEN 'in_sitemap' END,
    CASE WHEN company_id % 2 = 0 THEN 'http_200' END,
    CASE WHEN form = 4 THEN 'workday' END,
    CASE WHEN form IN (0, 3) THEN 'deep_path' END) END AS trail
FROM scores""")
def _(v):
    return scored_candidates(v).select(
        "company_id", "score",
        F.array_join(F.transform("trail", lambda r: r["rule"]), ",").alias("trail"),
    )


@query("rank_candidates", "D13 W7", f"""
WITH {SCORES_SQL}, grouped AS (SELECT company_id // 16 AS firm, company_id, score,
  CASE WHEN form < 4 THEN 2 WHEN company_id % 2 = 0 THEN 1 ELSE 3 END AS cost FROM scores
  WHERE score >= 20)
SELECT firm AS company_id, company_id AS member, score, CAST(row_number() OVER (
  PARTITION BY firm ORDER BY score DESC, cost, length(u.url), u.url) AS INTEGER) AS rank
FROM grouped JOIN (SELECT company_id, regexp_replace(CASE WHEN contains(url, '://') THEN url
  ELSE 'https://' || url END, '/$', '') AS url0, CASE WHEN form = 2 THEN lower(url0) ELSE url0 END
  AS url FROM career_urls) u USING (company_id)
QUALIFY rank <= 10""")
def _(v):
    rows = scored_candidates(v).withColumn("member", F.col("company_id")).withColumn(
        "company_id", F.floor(F.col("company_id") / 16)
    )
    firms = rows.select("company_id").distinct().withColumn("domain", F.lit("")).withColumn(
        "slug", F.lit("")
    )
    return discovery.rank_candidates(rows, firms).select("company_id", "member", "score", "rank")


def robots_bodies(v):
    k = F.col("c_custkey").cast("string")
    body = F.concat(
        F.lit("# rules of "), k, F.lit("\nUser-agent: *\nDisallow: /private\nDisallow: /jobs/"),
        k, F.lit("\nAllow: /jobs/"), k, F.lit("/open\n\nUser-agent: probot\nDisallow:\n"
                                            "Disallow: /careers\nCrawl-delay: 5\n"
                                            "Sitemap: https://c"), k,
        F.lit(".example.org/sitemap.xml\n"),
    )
    return v.table("customer").select(
        F.concat(F.lit("c"), k, F.lit(".example.org")).alias("domain"), body.alias("body")
    )


@query("robots_rules", "S7", """
SELECT 'c' || c_custkey || '.example.org' AS domain, user_agent, rule, CASE WHEN keyed
  THEN path || c_custkey || tail ELSE path END AS path
FROM customer, (VALUES ('*', 'disallow', '/private', '', false),
  ('*', 'disallow', '/jobs/', '', true), ('*', 'allow', '/jobs/', '/open', true),
  ('probot', 'disallow', '/careers', '', false), ('probot', 'crawl-delay', '5', '', false))
  AS r(user_agent, rule, path, tail, keyed)""")
def _(v):
    return robots.robots_rules(robots_bodies(v)).select("domain", "user_agent", "rule", "path")


@query("robots_allowed", "J10", """
SELECT l_orderkey * 100 + l_linenumber AS url_id, count(*) AS hits,
  NOT (l_linenumber % 4 = 1 OR l_linenumber % 4 = 2) AS allowed
FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def _(v):
    item, n = v.table("lineitem"), F.col("l_linenumber")
    firms = F.count(F.lit(1))
    total = v.table("customer").select(firms).scalar()
    key = F.pmod("l_orderkey", total).cast("string")
    path = (
        F.when(n % 4 == 1, F.concat(F.lit("/jobs/"), key, F.lit("/x")))
        .when(n % 4 == 2, F.lit("/private/a"))
        .when(n % 4 == 3, F.concat(F.lit("/jobs/"), key, F.lit("/open/1")))
        .otherwise("/careers")
    )
    visits = item.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("hits"))
    asked = visits.select(
        (F.col("l_orderkey") * 100 + n).alias("url_id"), "hits",
        F.concat(F.lit("c"), key, F.lit(".example.org")).alias("domain"), path.alias("path"),
    )
    bodies = robots_bodies(v)
    decided = robots.robots_allowed(
        asked, robots.robots_rules(bodies), "somebot/1.0", robots.robots_agents(bodies)
    )
    return decided.select("url_id", "hits", "allowed")


@query("robots_candidates", "D4", """
SELECT c_custkey AS company_id, 'https://c' || c_custkey || '.example.org' || p.path AS url,
  p.path <> '/jobs/' || c_custkey || '/open' AS disallowed
FROM customer, LATERAL (SELECT unnest(['/jobs/' || c_custkey, '/jobs/' || c_custkey || '/open',
  '/careers']) AS path) p""")
def _(v):
    companies = v.company().select("company_id", "domain")
    rows = discovery.robots_candidates(companies, robots.robots_rules(robots_bodies(v)))
    return rows.select(
        "company_id", "url",
        F.coalesce("robots_disallowed", F.lit(False)).alias("disallowed"),
    )


def sitemap_bodies(v):
    k = F.col("c_custkey").cast("string")
    site = F.concat(F.lit("https://c"), k, F.lit(".example.org"))
    index = F.concat(
        F.lit("<sitemapindex><sitemap><loc> "), site, F.lit("/pages.xml </loc></sitemap>"
                                                         "</sitemapindex>")
    )
    leaf = F.concat(
        F.lit("<urlset><url><loc>"), site, F.lit("/careers/</loc></url><url><LOC>\n"), site,
        F.lit("/blog/one</LOC></url><url><loc>"), site,
        F.lit("/careers/</loc></url><url><loc>ftp://x/y</loc></url></urlset>"),
    )
    docs = F.array(
        F.struct(F.lit("/sitemap.xml").alias("path"), index.alias("body")),
        F.struct(F.lit("/pages.xml").alias("path"), leaf.alias("body")),
    )
    return v.table("customer").select(site.alias("site"), F.explode(docs).alias("d")).select(
        F.concat("site", "d.path").alias("doc_url"), "d.body"
    )


@query("sitemap_locs", "S8", """
SELECT 'https://c' || c_custkey || '.example.org' || doc AS doc_url, is_index,
  'https://c' || c_custkey || '.example.org' || loc AS loc, CAST(pos AS INTEGER) AS pos
FROM customer, (VALUES ('/sitemap.xml', true, '/pages.xml', 0), ('/pages.xml', false,
  '/careers/', 0), ('/pages.xml', false, '/blog/one', 1)) AS r(doc, is_index, loc, pos)""")
def _(v):
    return sitemaps.sitemap_locs(sitemap_bodies(v)).select("doc_url", "is_index", "loc", "pos")


@query("sitemap_candidates", "D5 D10", """
SELECT c_custkey AS company_id, 'https://c' || c_custkey || '.example.org/careers' AS url
FROM customer""")
def _(v):
    locs = sitemaps.sitemap_locs(sitemap_bodies(v))
    roots = v.company().select(
        "company_id", F.concat(F.lit("https://"), "domain", F.lit("/sitemap.xml")).alias(
            "doc_url"), F.lit(0).alias("pos"),
    )
    leaves = discovery.sitemap_pages(locs, roots)
    found = discovery.sitemap_candidates(leaves)
    return discovery.with_sitemap_flag(found, leaves).filter("in_sitemap").select(
        "company_id", "url"
    )


@query("guess_candidates", "D6", """
SELECT c_custkey AS company_id, CASE WHEN c_custkey % 2 = 0
  THEN 'https://c' || c_custkey || '.example.org/careers'
  ELSE 'https://jobs.c' || c_custkey || '.example.org' END AS url FROM customer
WHERE c_custkey % 3 <> 0""")
def _(v):
    k = F.col("company_id")
    page = F.when(
        k % 2 == 0, F.concat(F.lit("https://"), "domain", F.lit("/careers/"))
    ).otherwise(F.concat(F.lit("https://jobs."), "domain", F.lit("/")))
    pages = v.company().select(
        page.alias("url"), F.when(k % 3 == 0, 404).otherwise(200).alias("status")
    )
    firms = v.company().select("company_id", "domain")
    nothing = firms.select("company_id", F.col("domain").alias("url")).filter("false")
    return discovery.guess_candidates(firms, pages, nothing).select("company_id", "url")


@query("persist_detection", "D15", """
SELECT company_id, CASE WHEN is_deleted OR (is_verified AND career_url <> '') THEN 'superseded'
    WHEN company_id % 9 = 0 THEN 'failed' ELSE 'success' END AS status
FROM v_company""")
def _(v):
    ranked = scored_candidates(v).filter(F.col("score") >= discovery.MIN_SCORE)
    attempted = v.company().select(
        "company_id",
        F.when(F.col("company_id") % 9 == 0, "timed out").otherwise("").alias("homepage_error"),
    )
    stored = v.company().filter("false").select(
        "company_id", F.col("career_url").alias("normalized_url"), F.col("career_url").alias(
            "url"), F.lit(0).alias("score"), F.lit("").alias("origin"),
        F.lit("").alias("guessed_type"), F.lit("").alias("ats_identifier"),
        F.lit("pending").alias("status"),
    )
    _, _, runs = discovery.persist_detection(v.company(), stored, ranked, attempted, as_of())
    return runs.select("company_id", "status")


@query("backfill_sanitized", "M29 F40", """
SELECT count(*) AS scanned, count(*) AS updated, CAST(0 AS BIGINT) AS unchanged FROM pages""")
def _(v):
    from ..operators.backfills import backfill_sanitized

    jobs = v.table("pages").select(
        F.col("page_id").alias("job_id"), F.col("html").alias("description_html"),
        F.lit("").alias("description_html_sanitized"),
    )
    _, counts = backfill_sanitized(jobs, dry_run=True)
    return counts


@query("backfill_slugs", "M28 F9", r"""
SELECT job_id, CASE WHEN job_id % 2 = 0 THEN slug ELSE
  trim(regexp_replace(regexp_replace(lower(title || '-' || c.name || '-'),
    '[^a-z0-9_\s-]', '', 'g'), '[-\s]+', '-', 'g'), '-_') || '-'
  || left(CAST(job_id AS VARCHAR), 8) END AS slug
FROM (SELECT * EXCLUDE slug, slug FROM v_job) j JOIN (SELECT company_id, name FROM v_company) c
USING (company_id)""")
def _(v):
    from ..operators.backfills import backfill_slugs

    jobs = v.job().withColumn("slug", F.when(F.col("job_id") % 2 == 0, F.col("slug")))
    return backfill_slugs(jobs, v.company(), fold=False).select("job_id", "slug")


@query("unverify_report", "M18e M31", """
SELECT company_id, is_verified AND NOT (domain LIKE '%.org') AS is_verified FROM v_company""")
def _(v):
    from ..operators.companies import unverify_fixtures

    state, _ = unverify_fixtures(v.company(), v.user(), suffixes=(".example", ".org"))
    return state.select("company_id", "is_verified")

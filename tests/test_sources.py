"""Feed documents, pages, robots and sitemaps against worked documents."""

import datetime as dt
import json

from pyspark.sql import functions as F

from postwatch.sources import feeds, pages, robots, sitemaps, snapshots


def documents(spark, source, body):
    text = body if isinstance(body, str) else json.dumps(body)
    return spark.createDataFrame([(1, source, text)],
                                 "company_id long, source_type string, body string")


def test_greenhouse(spark):
    body = {"jobs": [
        {"id": 31, "title": "Glazier", "location": {"name": "Remote, Ghent"},
         "content": "<div><p>Join us.</p><p>Now.</p></div>",
         "absolute_url": "https://boards.greenhouse.io/glas/jobs/31",
         "departments": [{"name": "Workshop"}], "updated_at": "2031-07-04T06:30:00Z"},
        {"id": 2, "title": "PM", "location": "Pune", "departments": [], "updated_at": None},
    ]}
    first, second = feeds.ingest_postings(
        documents(spark, "greenhouse", body)).orderBy("pos").collect()
    assert first.source_job_id == "31"
    assert first.description == "Join us.Now."
    assert (first.location_raw, first.work_mode, first.department) == (
        "Remote, Ghent", "remote", "Workshop")
    assert first.posted_at == dt.datetime(2031, 7, 4, 6, 30)
    assert first.parser_version == "greenhouse@1"
    assert (second.location_raw, second.department, second.posted_at) == ("Pune", "", None)


def test_lever(spark):
    body = [{"id": "a", "text": "Backend", "categories": {
        "location": "Remote", "team": "Core", "commitment": "Full-time"},
        "description": "<div>Hello</div>", "hostedUrl": "https://jobs.lever.co/acme/a",
        "createdAt": 1700000000000, "workplaceType": "on-site"}]
    row = feeds.ingest_postings(documents(spark, "lever", body)).first()
    assert (row.department, row.job_type, row.work_mode) == ("Core", "full_time", "onsite")
    assert row.description == "Hello"
    assert row.apply_url == row.source_url
    assert row.posted_at == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert feeds.ingest_postings(documents(spark, "lever", {"id": "a"})).count() == 0


def test_ashby_and_smartrecruiters(spark):
    body = {"jobPostings": [{"id": "x", "title": "UX", "locationName": "Pune", "isRemote": True,
                             "employmentType": "Internship", "publishedAt": "2025-02-01"}]}
    row = feeds.ingest_postings(documents(spark, "ashby", body)).first()
    assert (row.work_mode, row.job_type, row.posted_at) == (
        "remote", "internship", dt.datetime(2025, 2, 1))
    body = {"content": [{"id": "s", "name": "DA", "location": {
        "city": "Austin", "region": "TX", "country": "US", "remote": True},
        "department": {"label": "BI"}, "ref": "https://x/s"}]}
    row = feeds.ingest_postings(documents(spark, "smartrecruiters", body)).first()
    assert (row.location_raw, row.work_mode, row.extraction_confidence) == (
        "Austin, TX, US (Remote)", "remote", 60)


def test_broken_documents_give_no_rows(spark):
    rows = [(1, source, body) for source in (*feeds.DIALECTS, "other")
            for body in ("{not json", "{}", "[]", '{"jobs": 3}', None)]
    raw = spark.createDataFrame(rows, "company_id long, source_type string, body string")
    assert feeds.ingest_postings(raw).count() == 0


def test_harvest(spark):
    html = ("<a href='/jobs/1'>Software Engineer</a><a href='/jobs/2'>Product Manager</a>"
            "<a href='/jobs/1/?utm_source=x'>Software Engineer again</a><a href='/x'>abc</a>"
            "<a href='https://linkedin.com/jobs'>Follow us there</a>"
            "<a href='https://other.com/jobs/9'>Other company</a>")
    page = spark.createDataFrame(
        [(1, "https://example.com/careers", html, "https://example.com/careers")],
        "page_id long, url string, html string, career_url string")
    rows = pages.harvest_postings(page).orderBy("pos").collect()
    assert [(r.title, r.source_url) for r in rows] == [
        ("Software Engineer", "https://example.com/jobs/1"),
        ("Product Manager", "https://example.com/jobs/2")]


def test_six_source_types_in_one_scan(spark):
    """Career pages are read like feeds; a page has as many postings as it has links."""
    links = "".join(f"<a href='/jobs/{i}'>Posting number {i}</a>" for i in range(450))
    rows = [(1, "own_career_page", links, "https://a.com/careers", "https://a.com/careers"),
            (2, "unknown", "<a href='/x/1'>Glazier wanted</a>", "https://b.com/", "https://b.com/"),
            (3, "own_career_page", links, "https://c.com/", ""),
            (4, "lever", json.dumps([{"id": "a", "text": "Backend"}]), None, None),
            (5, "greenhouse", json.dumps({"jobs": [None, {"id": 1, "title": "T"}]}), None, None)]
    raw = spark.createDataFrame(
        rows, "company_id long, source_type string, body string, url string, career_url string")
    found = feeds.ingest_postings(raw)
    assert found._jdf.queryExecution().executedPlan().toString().count("Generate") == 1
    got = {}
    for r in found.collect():
        got.setdefault(r.company_id, []).append(r)
    assert sorted(got) == [1, 2, 4, 5] and len(got[1]) == 450
    assert [r.pos for r in sorted(got[1], key=lambda r: r.pos)] == list(range(450))
    assert (got[2][0].source_url, got[2][0].title, got[2][0].extraction_confidence) == (
        "https://b.com/x/1", "Glazier wanted", 40)
    assert {r.parser_version for r in got[1] + got[2]} == {"static@1"}
    assert (got[4][0].parser_version, got[5][0].pos) == ("lever@1", 1)


def test_links_know_their_region():
    html = ("<header><a href='/a'>A</a></header><nav><b><a href='b'>B</a></nav>"
            "<a href='#x'>no</a><footer><a href='http://z.org/'>Z</a></footer><a href='/a'>A2</a>")
    found = [(x["href"], x["text"], x["in_header"], x["in_footer"])
             for x in pages.page_links(html, "https://s.com/p/")]
    assert found == [
        ("https://s.com/a", "A", True, False), ("https://s.com/p/b", "B", True, False),
        ("http://z.org/", "Z", False, True), ("https://s.com/a", "A2", False, False)]


def test_structured_data_is_found_at_any_depth():
    html = ('<script type="application/ld+json">{"@graph":[{"x":[{"@type":"JobPosting",'
            '"title":"Dev"}]}]}</script><script type="application/ld+json">{bad</script>')
    assert [p["title"] for p in pages.page_postings(html)] == ["Dev"]


ROBOTS = """Disallow: /before
User-agent: *
Disallow: /jobs
Allow: /jobs/open
User-agent: probot
Disallow:
Sitemap: https://a.com/s.xml
"""


def test_robots(spark):
    bodies = spark.createDataFrame([("a.com", ROBOTS)], "domain string, body string")
    asked = spark.createDataFrame(
        [(1, "a.com", "/jobs/1"), (2, "a.com", "/jobs/open/1"), (3, "a.com", "/x"),
         (4, "b.com", "/jobs")], "url_id int, domain string, path string")
    rules, agents = robots.robots_rules(bodies), robots.robots_agents(bodies)

    def verdicts(name):
        rows = robots.robots_allowed(asked, rules, name, agents).orderBy("url_id").collect()
        return [r.allowed for r in rows]

    assert verdicts("other/1.0") == [False, True, True, True]
    assert verdicts("ProBot/1.0") == [True, True, True, True]
    assert [r.sitemap_url for r in robots.robots_sitemaps(bodies).collect()] == [
        "https://a.com/s.xml"]


def test_sitemaps(spark):
    body = "<urlset><url><loc> https://a.com/1 </loc></url><url><loc>https://a.com/1</loc></url>" \
           "<url><loc>ftp://a.com/2</loc></url></urlset>"
    rows = sitemaps.sitemap_locs(
        spark.createDataFrame([("d", body)], "doc_url string, body string")).collect()
    assert [(r.loc, r.is_index) for r in rows] == [("https://a.com/1", False)]


def test_cleared_state_and_quarantine(spark):
    state = spark.createDataFrame([("u1", "e"), ("u2", "e")], "url string, etag string").select(
        snapshots.url_hash("url").alias("url_hash"), "url", "etag")
    bad = spark.createDataFrame([("u1",)], "url string")
    cleared = {r.url: r.etag for r in snapshots.clear_fetch_state(state, bad).collect()}
    assert cleared == {"u1": "", "u2": "e"}
    runs = spark.createDataFrame([(1, 9, "untrusted"), (2, 9, "trusted")],
                                 "run_id int, company_id int, verdict string")
    bodies = spark.createDataFrame([(1, "u", "äbc"), (2, "u", "x")],
                                   "run_id int, url string, body string")
    row = snapshots.quarantine(runs, bodies, cap=2).collect()
    assert [(r.byte_size, r.truncated, bytes(r.content)) for r in row] == [
        (4, True, "ä".encode())]
    assert snapshots.purge(
        spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 20),)],
                              "created_at timestamp_ntz"),
        F.lit("2024-01-21").cast("timestamp_ntz")).count() == 1


def test_robots_lookup_equals_trying_every_rule(spark):
    """One domain holds nearly all rules and addresses; paths nest, repeat, are empty or null."""
    import random

    rng = random.Random(5)

    def path():
        return "/" + "/".join(rng.choice(["a", "b", "ab", "é", "\U0001f600"])
                              for _ in range(rng.randrange(6)))

    rules = [("hot", 1, "*", rng.choice(["allow", "disallow"]), path(), n) for n in range(1500)]
    rules += [("hot", 1, "*", "allow", "", 1500), ("hot", 2, "else", "disallow", "/", 1501),
              ("cold", 1, "*", "disallow", "/a", 1), ("cold", 1, "*", "crawl-delay", "/b", 2)]
    asked = [(n, "hot", path()) for n in range(2000)]
    asked += [(2000, "cold", "/ab"), (2001, "cold", "/b"), (2002, "none", "/"),
              (2003, "hot", None), (2004, "hot", "")]
    decided = robots.robots_allowed(
        spark.createDataFrame(asked, "url_id int, domain string, path string"),
        spark.createDataFrame(
            rules, "domain string, block int, user_agent string, rule string, path string, "
                   "line_no int"), "somebot")
    plan = decided._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith(path" not in plan and "NestedLoop" not in plan

    def allowed(domain, text):
        hits = [(kind, rule) for d, block, _, kind, rule, _ in rules
                if d == domain and block == 1 and text is not None and text.startswith(rule)]
        no = [rule for kind, rule in hits if kind == "disallow"]
        yes = [rule for kind, rule in hits if kind == "allow"]
        return not no or bool(yes and len(yes[-1]) > len(no[-1]))

    got = {r.url_id: r.allowed for r in decided.collect()}
    assert got == {n: allowed(domain, text) for n, domain, text in asked}
    assert len(set(got.values())) == 2

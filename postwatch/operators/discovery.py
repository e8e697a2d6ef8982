"""Career-page discovery over a landed page corpus.

Every strategy turns tables into candidate rows of one shape; they are merged per canonical URL,
scored by a fixed rubric and ranked per company. All pages are local, so nothing is fetched and
there is no budget; work is bounded by the corpus.

Page tables have ``page_id, url, final_url, status, html``; ``page_facts`` of them is computed once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts, urls
from ..functions.core import let, text_or_blank
from ..session import cut_lineage
from .ordered import first_per_key, top_per_key

# What finding a candidate costs; cheaper origins win.
ORIGIN_COSTS = {
    "header_link": 1, "footer_link": 1, "ats_pattern": 2, "robots_txt": 2, "sitemap": 3,
    "common_path": 3, "subdomain_guess": 3, "json_ld": 3, "manual": 1,
}
# Paths and addresses worth a guess.
COMMON_PATHS = (
    "/careers", "/careers/", "/career", "/jobs", "/jobs/", "/job", "/about/careers",
    "/company/careers", "/en/careers", "/work-with-us", "/join-us", "/join-our-team",
    "/opportunities", "/hiring", "/openings", "/vacancies",
)
BOARD_PATTERNS = (
    "https://boards.greenhouse.io/{}", "https://jobs.lever.co/{}", "https://jobs.ashbyhq.com/{}",
    "https://{}.smartrecruiters.com/",
)
MIN_SCORE = 20
MAX_CANDIDATES = 10
SHORT_CIRCUIT_SCORE = 60
PROVISIONAL = 5
SAMPLE_TITLES = 5
SITEMAP_DOCS = 3
SITEMAP_URLS = 5000
TRACE_CHARS = 2000

FLAGS = (
    "nav_header", "nav_footer", "robots_disallowed", "in_sitemap", "http_200",
    "json_ld_jobposting", "multiple_job_links", "single_posting", "title_keyword",
    "explicit_no_openings",
)
SCALARS = {
    "ats_source": "string", "ats_identifier": "string", "http_status": "int",
    "content_type": "string", "page_title": "string",
}
LISTS = ("sample_job_titles",)


def candidate_url(url: Column | str) -> Column:
    """Key of a candidate: scheme assumed, default ports dropped, canonical."""
    full = urls.with_scheme(F.col(url) if isinstance(url, str) else url)
    return urls.normalize_url(F.regexp_replace(full, r"^(\w+://[^/?#]*):(?:80|443)(?=[/?#]|$)",
                                               "$1"))


def page_addresses(pages: DataFrame) -> DataFrame:
    """page_id, status and ``address`` (the candidate key) of every page, one row per page."""
    return pages.select("page_id", "status", candidate_url("url").alias("address"))


def candidates(
    df: DataFrame, url: Column, origin: str | Column, via: Column, **evidence: Column
) -> DataFrame:
    """Candidate rows of one origin; evidence not given stays unknown."""
    def value(name: str, kind: str) -> Column:
        return (evidence[name] if name in evidence else F.lit(None)).cast(kind).alias(name)

    rows = df.select(
        "company_id", candidate_url(url).alias("url"),
        (F.lit(origin) if isinstance(origin, str) else origin).alias("origin"),
        via.alias("via"), *[value(n, "boolean") for n in FLAGS],
        *[value(n, k) for n, k in SCALARS.items()], *[value(n, "array<string>") for n in LISTS],
    )
    return rows.filter(F.col("url").rlike(r"^https?://"))


def home_links(companies: DataFrame, pages: DataFrame, facts: DataFrame) -> DataFrame:
    """Links on the reachable home page of every company, bare host before www."""
    root = companies.select("company_id", F.lower("domain").alias("_host")).filter(
        F.col("_host") != ""
    )
    home = pages.filter(
        F.col("status").between(200, 299) & (urls.path_of("url") == "/")
    ).select(
        "page_id", urls.host_of("url", strip_www=False).alias("_raw"),
        urls.host_of("url").alias("_host"),
    )
    picked = first_per_key(
        root.join(home, "_host").withColumn("_www", F.col("_raw") != F.col("_host")),
        ["company_id"], ["_www", "page_id"],
    ).select("company_id", "page_id")
    return picked.join(facts.select("page_id", "links"), "page_id").select(
        "company_id", "page_id", F.posexplode("links").alias("pos", "link")
    ).select("company_id", "page_id", "pos", "link.*")


def _org_slug(companies: DataFrame) -> DataFrame:
    label = F.substring_index(urls.registrable_domain("domain"), ".", 1)
    return companies.select(
        "company_id", "domain", label.alias("label"),
        F.when(text_or_blank(F.col("slug")) != "", F.col("slug")).otherwise(label).alias("org"),
    )


def ats_candidates(
    companies: DataFrame, links: DataFrame, pages: DataFrame, facts: DataFrame,
    addresses: DataFrame | None = None,
) -> DataFrame:
    """Board links on home pages, and guessed board addresses that exist in the corpus and show
    a trace of the company. ``addresses`` (here and below): ``page_addresses`` of the pages, where
    they are made already."""
    sniffed = links.filter(F.col("href").rlike(r"(?i)^https?://")).withColumn(
        "_s", urls.sniff_source("href")
    ).filter(F.col("_s.source_type").isin(*urls.ATS_TYPES))
    text = F.substring("text", 1, 80)
    harvested = candidates(
        sniffed, F.col("href"), "ats_pattern",
        F.when(text != "", text).otherwise("homepage anchor"),
        ats_source=F.col("_s.source_type"), ats_identifier=F.col("_s.identifier"),
    )
    named = _org_slug(companies).withColumn(
        "_slug", F.when(F.col("label") != "", F.col("label")).otherwise(F.col("org"))
    )
    guesses = named.select(
        "company_id", "_slug",
        F.explode(F.array(*[F.replace(F.lit(p), F.lit("{}"), F.col("_slug"))
                            for p in BOARD_PATTERNS])).alias("guess"),
    ).filter(F.col("_slug") != "").withColumn("url", candidate_url("guess"))
    good = pages.filter(F.col("status").between(200, 299))
    answers = (page_addresses(pages) if addresses is None else addresses).filter(
        F.col("status").between(200, 299))
    hit = guesses.join(_page_of_url(guesses, answers), "url").join(
        good.select("page_id", "html"), "page_id"
    ).join(facts.select("page_id", "has_posting"), "page_id")
    shown = F.lower(F.concat_ws(
        " ", texts.page_title("html"), F.substring(texts.visible_text("html"), 1, TRACE_CHARS)))
    traced = hit.filter(F.col("has_posting") | shown.contains(F.lower("_slug"))).withColumn(
        "_s", urls.sniff_source("guess")
    )
    guessed = candidates(
        traced, F.col("guess"), "ats_pattern", F.lit("ats_pattern slug guess"),
        ats_source=F.col("_s.source_type"), ats_identifier=F.col("_s.identifier"),
    )
    return harvested.unionByName(guessed)


def nav_candidates(links: DataFrame) -> DataFrame:
    """Header, navigation and footer links that speak of careers in address or text."""
    hit = links.filter(
        texts.path_has_keyword("href") | texts.text_has_keyword("text")
    )
    text = F.substring("text", 1, 60)

    def region(name: str, inside: str, flag: str) -> DataFrame:
        return candidates(
            hit.filter(inside), F.col("href"), f"{name}_link",
            F.concat(F.lit(f"{name} link: "), text), **{flag: F.lit(True)},
        )

    return region("header", "in_header", "nav_header").unionByName(
        region("footer", "in_footer", "nav_footer")
    )


def robots_candidates(companies: DataFrame, rules: DataFrame) -> DataFrame:
    """Career paths named in the robots rules of a domain (rules of the ``*`` selection)."""
    paths = rules.filter(
        F.col("rule").isin("allow", "disallow") & texts.path_has_keyword("path")
    ).groupBy("domain", "path").agg(
        F.bool_or(F.col("rule") == "allow").alias("_allowed")
    )
    root = F.concat(F.lit("https://"), F.col("domain"), F.lit("/"))
    rows = companies.select("company_id", "domain").join(paths, "domain")
    return candidates(
        rows, urls.absolute_url(root, F.col("path")), "robots_txt",
        F.concat(F.lit("robots "), F.col("path")),
        robots_disallowed=F.when(~F.col("_allowed"), True),
    )


def sitemap_pages(locs: DataFrame, roots: DataFrame) -> DataFrame:
    """Leaf locations per company: listed documents directly, index documents through their
    children, three documents and 5000 locations each at most.

    ``roots``: company_id, doc_url, pos of the documents to start from; ``locs``: doc_url,
    is_index, pos, loc of all landed documents.
    """
    # all sides grow with the companies, and their sizes are guessed too low: never broadcast
    docs = locs.select("doc_url", "is_index").distinct()
    start = roots.select("company_id", candidate_url("doc_url").alias("_key"), "pos")
    landed = docs.withColumn("_key", candidate_url("doc_url"))
    top = start.join(landed.hint("merge"), "_key").select(
        "company_id", "doc_url", "is_index", F.struct("pos", F.lit(-1)).alias("_order")
    )
    children = top.filter("is_index").join(
        locs.select("doc_url", "pos", "loc").hint("merge"), "doc_url"
    ).select(
        "company_id", candidate_url("loc").alias("_key"),
        F.struct(F.col("_order.pos").alias("pos"), F.col("pos").alias("col2")).alias("_order"),
    ).join(landed.hint("merge"), "_key").select("company_id", "doc_url", "is_index", "_order")
    # an index document uses up one of the three documents itself
    chosen = top_per_key(
        top.unionByName(children), ["company_id"], [F.col("_order"), F.col("doc_url")],
        SITEMAP_DOCS,
    ).filter(~F.col("is_index"))
    listed = locs.filter(F.col("pos") < SITEMAP_URLS)
    return chosen.select("company_id", "doc_url").join(
        listed.select("doc_url", "loc").hint("merge"), "doc_url"
    )


def sitemap_candidates(leaves: DataFrame) -> DataFrame:
    hit = leaves.filter(texts.path_has_keyword("loc"))
    return candidates(
        hit, F.col("loc"), "sitemap", F.concat(F.lit("sitemap "), F.col("doc_url"))
    )


def guess_candidates(
    companies: DataFrame, pages: DataFrame, known: DataFrame, addresses: DataFrame | None = None,
) -> DataFrame:
    """Common paths and career sub-domains that answer in the corpus and are no candidates yet."""
    base = urls.registrable_domain("domain")
    paths = [(F.concat(F.lit("https://"), F.col("domain"), F.lit(p)), "common_path")
             for p in COMMON_PATHS]
    subs = [(F.concat(F.lit(f"https://{s}."), base, F.lit("/")), "subdomain_guess")
            for s in urls.CAREER_SUBDOMAINS]
    guesses = F.array(*[F.struct(u.alias("guess"), F.lit(o == "common_path").alias("by_path"))
                        for u, o in paths + subs])
    # made canonical inside the list, so that no filter further on is moved below and does it again
    pairs = F.transform(guesses, lambda g: F.struct(
        candidate_url(g["guess"]).alias("url"), g["by_path"].alias("by_path")))
    # dealt by company before the addresses are written, so that grouping them moves nothing
    rows = companies.filter(F.col("domain") != "").select("company_id", "domain").repartition(
        "company_id"
    ).select("company_id", F.explode_outer(pairs).alias("_g")).select("company_id", "_g.*")
    # sizes are guessed from files here, too low for texts made from a key: never broadcast
    fresh = rows.groupBy("company_id", "url").agg(F.bool_or("by_path").alias("by_path")).join(
        known.select("company_id", "url").hint("merge"), ["company_id", "url"], "left_anti"
    )
    if addresses is None:
        addresses = pages.select("status", candidate_url("url").alias("address"))
    answers = addresses.groupBy(F.col("address").alias("url")).agg(
        F.min("status").alias("_status"))
    ok = fresh.join(answers.hint("merge"), "url").filter(
        F.col("_status").between(200, 299)
        | (F.col("by_path") & F.col("_status").between(200, 399))
    )
    return candidates(
        ok, F.col("url"), F.when(F.col("by_path"), "common_path").otherwise("subdomain_guess"),
        F.when(F.col("by_path"), "common path probe").otherwise("subdomain guess"))


def merge_candidates(raw: DataFrame) -> DataFrame:
    """One row per company and canonical URL. True flags win, lists are united, other values
    keep the first; a board finding names the origin, else the cheapest one does.

    First one row per origin is kept, so at most nine rows meet per URL."""
    order = F.lit(99)
    rank = {
        "ats_pattern": 1, "header_link": 2, "footer_link": 3, "robots_txt": 4, "sitemap": 5,
        "common_path": 6, "subdomain_guess": 7, "json_ld": 8, "manual": 0,
    }
    for name, position in rank.items():
        order = F.when(F.col("origin") == name, position).otherwise(order)
    cost = F.lit(99)
    for name, value in ORIGIN_COSTS.items():
        cost = F.when(F.col("origin") == name, value).otherwise(cost)
    key = ["company_id", "url"]

    def first(name: str, at: Column) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), at))

    ranked = raw.withColumn("_order", order)
    single = ranked.groupBy(*key, "origin", "_order").agg(
        *[F.bool_or(f).alias(f) for f in FLAGS],
        *[F.min(s).alias(s) for s in SCALARS],
        F.min("via").alias("via"),
        *[first(n, F.col("via")).alias(n) for n in LISTS],
    )
    boards = F.when(F.col("ats_source").isNotNull(), F.struct("_order", "origin"))
    entries = F.array_sort(F.collect_list(F.struct("_order", "via")))
    titles = F.flatten(F.transform(
        F.array_sort(F.collect_list(F.when(
            F.col("sample_job_titles").isNotNull(), F.struct("_order", "sample_job_titles")))),
        lambda e: e["sample_job_titles"],
    ))
    merged = single.withColumn("_cost", cost).groupBy(*key).agg(
        F.min(boards)["origin"].alias("_board"),
        F.min(F.struct("_cost", "_order", "origin"))["origin"].alias("_cheap"),
        *[F.bool_or(f).alias(f) for f in FLAGS],
        *[first(s, F.col("_order")).alias(s) for s in SCALARS],
        F.array_distinct(titles).alias("sample_job_titles"),
        F.concat_ws("; ", F.filter(
            F.transform(entries, lambda e: e["via"]), lambda via: via != "")).alias("via"),
    )
    return merged.withColumn("origin", F.coalesce("_board", "_cheap")).drop("_board", "_cheap")


ASSETS = r"(?i)\.(?:pdf|doc|docx|zip|jpg|png|svg|xml|json)$"


def score_candidates(rows: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """Score (0..100) and the ordered trail of rules that applied.

    ``rows`` need ``domain`` (the company's), or ``domains`` (company_id, domain) to join it.
    """
    if domains is not None:
        rows = rows.join(domains.select("company_id", "domain"), "company_id", "left")
    parts = F.struct(
        urls.host_of("url", strip_www=False).alias("host"), urls.path_of("url").alias("path"),
        urls.scheme_of("url").alias("scheme"), urls.query_of("url").alias("query"),
    )
    # bound once, so that a later filter on the score copies no URL parsing
    judged = rows.withColumn("_r", let(parts, _rubric))
    return judged.select(
        *rows.columns, F.col("_r.trail").alias("trail"), F.col("_r.score").alias("score")
    )


def _rubric(u: Column) -> Column:
    """Trail and score of one candidate from the parts of its URL and its evidence columns."""
    host, path, scheme = u["host"], u["path"], u["scheme"]
    status = F.col("http_status")
    board, workday = urls.is_scoring_ats_host(host), urls.is_workday_host(host)

    def rule(name: str, points: int, detail: Column | str) -> Column:
        text = F.lit(detail) if isinstance(detail, str) else detail
        return F.struct(
            F.lit(name).alias("rule"), F.lit(points).alias("points"), text.alias("detail")
        )

    def says(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    knock_out = (
        F.when(urls.is_blocked_host(host),
               rule("blocked_domain", 0, says(host, " is on the list of hosts to skip")))
        .when((status < 200) | (status >= 300),
              rule("bad_status", 0, says("answered with status ", status.cast("string"))))
        .when(~scheme.isin("http", "https"),
              rule("bad_scheme", 0, says("not a web address: ", F.when(scheme == "", "no scheme").otherwise(
                  scheme))))
        .when(text_or_blank(F.col("domain")) == "",
              rule("missing_domain_evidence", 0, "no domain to compare with"))
        .when(~(urls.is_own_host(host, F.col("domain")) | board | workday),
              rule("foreign_host", 0, says(host, " belongs to somebody else")))
    )
    not_html = (text_or_blank(F.col("content_type")) != "") & ~F.lower(
        text_or_blank(F.col("content_type"))).contains("html")
    depth = F.size(F.filter(F.split(path, "/"), lambda part: part != ""))
    checks = (
        (board, rule("ats_host", 40, says(host, " is a job board we can read"))),
        (F.col("json_ld_jobposting"),
         rule("json_ld_jobposting", 30, "structured data names a job")),
        (texts.path_has_keyword(path),
         rule("career_path_keyword", 25, "career word in the path")),
        (F.col("multiple_job_links"),
         rule("multiple_job_links", 20, "at least three links to jobs")),
        (urls.is_career_subdomain(host),
         rule("career_subdomain", 18,
              says(F.substring_index(host, ".", 1), " names a career host"))),
        (F.col("nav_header"), rule("nav_header", 15, "found in the page head")),
        (F.col("title_keyword"), rule("title_keyword", 15, "career word in the title")),
        (F.col("nav_footer"), rule("nav_footer", 10, "found in the page foot")),
        (F.col("in_sitemap"), rule("in_sitemap", 10, "listed by the sitemap")),
        (F.col("http_200"), rule("http_200", 5, "fetched without error")),
        (F.col("explicit_no_openings"),
         rule("explicit_no_openings", 5, "says that nothing is open")),
        (path.rlike(ASSETS) | not_html,
         rule("pdf_or_asset", -40, "a file, not a page")),
        (texts.path_has_keyword(path, texts.NOISE_WORDS),
         rule("noise_path", -30, "unrelated word in the path")),
        (workday, rule("workday", -20, "board of a kind we cannot read")),
        (F.col("single_posting"),
         rule("single_posting", -15, "shows a single job")),
        (depth >= 2, rule("deep_path", -10, "two or more path parts")),
        (F.size(F.split(u["query"], "&")) >= 2,
         rule("query_heavy", -5, "two or more query parts")),
    )
    applied = F.array_compact(F.array(*[F.when(test, entry) for test, entry in checks]))
    trail = let(knock_out, lambda k: F.when(k.isNotNull(), F.array(k)).otherwise(applied))
    return let(trail, lambda t: F.struct(
        t.alias("trail"),
        F.greatest(F.lit(0), F.least(F.lit(100), F.aggregate(
            t, F.lit(0), lambda total, r: total + r["points"]))).alias("score"),
    ))


def _with_cost(rows: DataFrame) -> DataFrame:
    pairs = [F.lit(part) for pair in ORIGIN_COSTS.items() for part in pair]
    return rows.withColumn(
        "_cost", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("origin")), F.lit(99))
    )


def confirmed_board(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Flag candidates of a board that names the company."""
    joined = rows.join(_org_slug(companies).select("company_id", "org"), "company_id", "left")
    org = text_or_blank(F.col("org"))
    names = (org != "") & (
        (F.col("ats_identifier") == org) | F.col("url").contains(org)
    )
    return joined.withColumn(
        "confirmed", (F.col("origin") == "ats_pattern") & F.coalesce(names, F.lit(False))
    ).drop("org")


def short_circuit(scored: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies whose board is certain, so that further guessing is skipped."""
    marked = confirmed_board(scored, companies)
    sure = (F.col("origin") == "ats_pattern") & (
        F.col("confirmed") | (F.col("score") >= SHORT_CIRCUIT_SCORE)
    )
    return marked.groupBy("company_id").agg(
        F.coalesce(F.bool_or(sure), F.lit(False)).alias("short_circuited")
    )


def _provisional(scored: DataFrame, n: int, rank: str) -> DataFrame:
    return top_per_key(
        _with_cost(scored), ["company_id"],
        [F.col("score").desc(), F.col("_cost"), F.length("url"), F.col("url")], n, rank,
    ).drop("_cost")


def rank_candidates(
    scored: DataFrame, companies: DataFrame, min_score: int = MIN_SCORE,
    limit: int = MAX_CANDIDATES,
) -> DataFrame:
    """Best candidates per company: confirmed boards first, then score, cost, shorter URL."""
    good = _with_cost(confirmed_board(scored.filter(F.col("score") >= min_score), companies))
    return top_per_key(
        good, ["company_id"],
        [F.col("confirmed").desc(), F.col("score").desc(), F.col("_cost"), F.length("url"),
         F.col("url")],
        limit, "rank",
    ).drop("_cost")


def _page_of_url(urls_wanted: DataFrame, addresses: DataFrame) -> DataFrame:
    """Page that answered under each wanted address. Only addresses and ids are shuffled here;
    the markup is fetched by page id afterwards."""
    slim = addresses.select(F.col("address").alias("url"), "page_id")
    return slim.join(urls_wanted.select("url").distinct(), "url", "left_semi").groupBy(
        "url"
    ).agg(F.min("page_id").alias("page_id"))


def _landed(
    rows: DataFrame, pages: DataFrame, facts: DataFrame, addresses: DataFrame | None = None
) -> DataFrame:
    """Candidates with the page that answered under their address."""
    placed = rows.join(_page_of_url(
        rows, page_addresses(pages) if addresses is None else addresses), "url")
    return placed.join(
        pages.select("page_id", "final_url", "status", "html"), "page_id"
    ).join(facts, "page_id", "left")


def jsonld_evidence(
    scored: DataFrame, pages: DataFrame, facts: DataFrame, addresses: DataFrame | None = None
) -> DataFrame:
    """JobPosting and status evidence for the five leading candidates of each company."""
    leading = _provisional(scored, PROVISIONAL, "_nth").select("company_id", "url", "origin",
                                                                "via")
    found = _landed(leading, pages, facts, addresses)
    return _evidence_rows(
        found, json_ld_jobposting=F.when(F.col("has_posting"), True),
        http_status=F.col("status"), http_200=F.when(F.col("status") < 400, True),
    )


def _evidence_rows(found: DataFrame, **evidence: Column) -> DataFrame:
    """More evidence for known candidates, under their own origin."""
    return candidates(found, F.col("url"), F.col("origin"), F.col("via"), **evidence)


def verify_evidence(
    scored: DataFrame, pages: DataFrame, facts: DataFrame, companies: DataFrame,
    flags: DataFrame | None = None, addresses: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Evidence read off the pages of the leading candidates, and the candidates to drop since
    they land on a blocked or foreign host. With a certain board only its best page is read."""
    leading = _provisional(scored, MAX_CANDIDATES, "_nth")
    if flags is not None:
        leading = leading.join(flags, "company_id", "left")
        certain = F.coalesce("short_circuited", F.lit(False))
        boards = _provisional(
            scored.join(flags.filter("short_circuited").select("company_id"), "company_id",
                        "left_semi")
            .filter((F.col("origin") == "ats_pattern") & (F.col("score") >= MIN_SCORE)),
            1, "_nth",
        )
        leading = leading.filter(~certain).drop("short_circuited").unionByName(boards)
    firm = companies.select(
        "company_id", urls.registrable_domain("domain").alias("_company_domain")
    )
    found = _landed(
        leading.select("company_id", "url", "origin", "via"), pages, facts, addresses
    ).join(firm, "company_id")
    asked = urls.host_of("url", strip_www=False)
    landed = urls.host_of(F.coalesce("final_url", "url"), strip_www=False)
    own = F.when(
        urls.is_scoring_ats_host(asked), urls.is_own_host(landed, F.col("_company_domain"))
    ).otherwise(
        urls.is_own_host(landed, urls.registrable_domain(asked))
        | urls.is_scoring_ats_host(landed)
    )
    moved = (landed != "") & (asked != "") & (landed != asked)
    trusted = ~moved | (own & ~urls.is_blocked_host(landed))
    unique_links = F.array_distinct(F.transform("links", lambda x: x["href"]))
    job_links = F.size(F.filter(
        F.transform(
            unique_links,
            lambda href: texts.is_job_link(href, F.element_at(F.filter(
                "links", lambda x: x["href"] == href), 1)["text"]),
        ),
        lambda hit: hit,
    ))
    single = (F.col("posting_count") == 1) & urls.last_segment("url").rlike(
        r"(?i)^(?:\d+|[0-9a-f]{32})$"
    )
    plain = F.filter(
        F.transform("links", lambda x: F.trim(x["text"])),
        lambda t: (F.length(t) >= 3) & (F.length(t) <= 60) & ~F.exists(
            F.split(F.lower(t), r"\s+"), lambda w: w.isin(*texts.NOISE_WORDS)),
    )
    titles = F.concat("posting_titles", plain)
    lowered = F.transform(titles, lambda t: F.lower(t))
    samples = F.slice(F.filter(
        titles, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1), 1, SAMPLE_TITLES)
    # one pass over the pages leaves a slim table, which then splits in two
    read = cut_lineage(found.select(
        "company_id", "url", "origin", "via", "status", "posting_count",
        trusted.alias("trusted"), texts.page_title("html").alias("title"),
        job_links.alias("job_links"), single.alias("single"), samples.alias("samples"),
        texts.no_openings("html").alias("no_openings"),
    ))
    dropped = read.filter(~F.col("trusted")).select("company_id", "url")
    status = F.col("status")

    def flag(test: Column) -> Column:
        return F.when(test, True)

    evidence = _evidence_rows(
        read.filter("trusted"), http_status=status, http_200=flag(status.between(200, 299)),
        multiple_job_links=flag(F.col("job_links") >= 3),
        json_ld_jobposting=flag(F.col("posting_count") > 0),
        single_posting=flag(F.col("single")),
        title_keyword=flag(texts.text_has_keyword("title")),
        explicit_no_openings=flag(F.col("no_openings")),
        page_title=F.col("title"), sample_job_titles=F.col("samples"),
    )
    return evidence, dropped


def with_sitemap_flag(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Mark candidates the sitemap of their company lists."""
    listed = leaves.select(
        "company_id", candidate_url("loc").alias("url"), F.lit(True).alias("_listed")
    ).distinct()
    return rows.join(listed.hint("merge"), ["company_id", "url"], "left").withColumn(
        "in_sitemap", F.coalesce("in_sitemap", "_listed")
    ).drop("_listed")


def detect(
    companies: DataFrame, pages: DataFrame, facts: DataFrame,
    robots: DataFrame | None = None, locs: DataFrame | None = None,
    roots: DataFrame | None = None,
) -> DataFrame:
    """All strategies for all companies: ranked candidates with score and trail."""
    domains = companies.select("company_id", "domain")
    # every cut below is a slim table that several later steps read
    facts = cut_lineage(facts)
    addresses = cut_lineage(page_addresses(pages))
    links = cut_lineage(home_links(companies, pages, facts))
    early = cut_lineage(merge_candidates(
        ats_candidates(companies, links, pages, facts, addresses).unionByName(nav_candidates(links))
    ))
    flags = cut_lineage(short_circuit(score_candidates(early, domains), companies))
    rest = companies.join(
        flags.filter("short_circuited").select("company_id"), "company_id", "left_anti"
    )
    parts = [early]
    if robots is not None:
        parts.append(robots_candidates(rest, robots))
    leaves = None
    if locs is not None and roots is not None:
        leaves = sitemap_pages(
            locs, roots.join(rest.select("company_id"), "company_id", "left_semi")
        )
        parts.append(sitemap_candidates(leaves))
    known = reduce(lambda a, b: a.unionByName(b), parts)
    found = merge_candidates(known.unionByName(guess_candidates(rest, pages, known, addresses)))
    if leaves is not None:
        found = with_sitemap_flag(found, leaves)
    found = cut_lineage(found)
    probed = jsonld_evidence(
        score_candidates(
            found.join(rest.select("company_id"), "company_id", "left_semi"), domains
        ),
        pages, facts, addresses,
    )
    enriched = cut_lineage(merge_candidates(found.unionByName(probed)))
    evidence, dropped = verify_evidence(
        score_candidates(enriched, domains), pages, facts, companies, flags, addresses
    )
    final = cut_lineage(merge_candidates(enriched.unionByName(evidence)).join(
        dropped, ["company_id", "url"], "left_anti"
    ))
    return rank_candidates(score_candidates(final, domains), companies)


def persist_detection(
    companies: DataFrame, stored: DataFrame, ranked: DataFrame, attempted: DataFrame,
    as_of: Column,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Company state, candidate table and run rows after a detection batch.

    ``attempted``: company_id, homepage_error. ``companies`` is the state at the time of writing:
    a company deleted or verified meanwhile gets a superseded run and no changes.
    """
    best = ranked.groupBy("company_id").agg(
        F.max("score").alias("best_score"), F.count(F.lit(1)).alias("candidates_found")
    )
    now = companies.select(
        "company_id", "is_deleted", F.col("is_verified").alias("_verified"),
        F.col("career_url").alias("_url"),
    )
    judged = attempted.join(now, "company_id", "left").join(best, "company_id", "left").fillna(
        0, subset=["best_score", "candidates_found"]
    )
    note = (
        F.when(F.col("is_deleted").isNull(), "company deleted mid-run")
        .when(F.col("is_deleted"), "company soft-deleted mid-run")
        .when(F.col("_verified") & (F.col("_url") != ""), "company became verified mid-run")
    )
    status = (
        F.when(text_or_blank(F.col("homepage_error")) != "", "failed")
        .when(F.col("candidates_found") == 0, "no_candidates").otherwise("candidates_found")
    )
    runs = judged.withColumn("note", note).withColumn("final_status", status).select(
        "company_id",
        F.when(F.col("note").isNotNull(), "superseded").when(
            F.col("final_status") == "failed", "failed").otherwise("success").alias("status"),
        F.coalesce("note", F.lit("")).alias("notes"), "final_status",
        F.col("candidates_found").cast("int").alias("candidates_found"),
        F.col("best_score").alias("best_score"), as_of.alias("finished_at"),
    )
    valid = runs.filter(F.col("status") != "superseded")
    marked = companies.join(
        valid.select("company_id", F.col("final_status").alias("_final")), "company_id", "left"
    )
    hit = F.col("_final").isNotNull()
    changes = {"detection_status": F.col("_final"), "last_detection_at": as_of}
    if "detection_attempts" in companies.columns:
        changes["detection_attempts"] = F.col("detection_attempts") + 1
    state = marked.select(*[
        F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
        for c in companies.columns
    ])
    key = ["company_id", "normalized_url"]
    new = ranked.join(valid.select("company_id"), "company_id", "left_semi").select(
        "company_id", F.col("url").alias("normalized_url"), F.col("url").alias("n_url"),
        F.col("score").alias("n_score"), F.col("origin").alias("n_origin"),
        F.coalesce("ats_source", F.lit("unknown")).alias("n_guessed_type"),
        F.coalesce("ats_identifier", F.lit("")).alias("n_ats_identifier"),
    )
    both = stored.join(new, key, "full_outer")

    def taken(name: str) -> Column:
        return F.coalesce(f"n_{name}", name).alias(name)

    table = both.select(
        *key, *[taken(n) for n in ("url", "score", "origin", "guessed_type", "ats_identifier")],
        F.coalesce("status", F.lit("pending")).alias("status"),
    )
    return state, table, runs

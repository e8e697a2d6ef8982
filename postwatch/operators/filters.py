"""Predicates over the canonical tables. Parameters left empty change nothing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import all_of, any_of, contains_ci
from ..functions.urls import host_of, is_blocked_host

STALE = ("possibly_closed", "likely_closed")
ATTENTION_HEALTH = ("failing", "paused")
ATTENTION_DETECTION = ("needs_review", "failed", "not_found")


def alive(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_deleted"))


def deleted(df: DataFrame) -> DataFrame:
    return df.filter("is_deleted")


def is_live() -> Column:
    return (F.col("status") == "open") & F.col("is_published") & ~F.col("is_deleted")


def live_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(is_live())


JOB_STATES = {
    "published": lambda: F.col("is_published"),
    "open": lambda: F.col("status") == "open",
    "stale": lambda: F.col("status").isin(*STALE),
    "closed": lambda: F.col("status") == "closed",
    "needs_review": lambda: F.col("needs_review"),
}


def jobs_in_state(jobs: DataFrame, state: str) -> DataFrame:
    return jobs.filter(JOB_STATES[state]())


def fresh(jobs: DataFrame, hours: int, as_of: Column) -> DataFrame:
    return jobs.filter(F.col("last_seen_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def company_jobs(jobs: DataFrame, companies: DataFrame, slug: str) -> DataFrame:
    """Live jobs of one public company."""
    chosen = public_companies(companies).filter(F.col("slug") == slug).select("company_id")
    return live_jobs(jobs).join(chosen, "company_id", "left_semi")


def _values(spec: str | Sequence[str] | None) -> list[str]:
    items = spec.split(",") if isinstance(spec, str) else list(spec or [])
    return [item.strip() for item in items if item.strip()]


def filter_jobs(
    jobs: DataFrame,
    work_mode: str | Sequence[str] | None = None,
    job_type: str | Sequence[str] | None = None,
    company: str | Sequence[str] | None = None,
    department: str = "",
    location: str = "",
    posted_after: Column | None = None,
    posted_within_days: int | None = None,
    has_apply_url: bool | None = None,
    as_of: Column | None = None,
    company_slug: str = "company_slug",
) -> DataFrame:
    """Search-page filters; ``company`` needs the company slug joined on."""
    tests: list[Column] = []
    for name, spec in (("work_mode", work_mode), ("job_type", job_type), (company_slug, company)):
        chosen = _values(spec)
        if chosen:
            tests.append(F.col(name).isin(*chosen))
    for name, needle in (("department", department), ("location_raw", location)):
        if needle:
            tests.append(contains_ci(F.col(name), needle))
    if posted_after is not None:
        tests.append(F.col("posted_at") >= posted_after)
    if posted_within_days is not None:
        tests.append(F.col("posted_at") >= as_of - F.make_dt_interval(F.lit(posted_within_days)))
    if has_apply_url is not None:
        tests.append((F.col("apply_url") != "") == F.lit(has_apply_url))
    return jobs.filter(all_of(tests)) if tests else jobs


def filter_companies(
    companies: DataFrame, industry: str = "", has_open_jobs: bool | None = None
) -> DataFrame:
    result = companies
    if industry:
        result = result.filter(contains_ci(F.col("industry"), industry))
    if has_open_jobs is not None:
        result = result.filter((F.col("open_jobs_count") > 0) == F.lit(has_open_jobs))
    return result


def is_scrapable() -> Column:
    return (
        F.col("is_verified") & F.col("is_active") & ~F.col("is_deleted")
        & (F.col("career_url") != "") & (F.col("scrape_health") != "paused")
    )


def scrapable(companies: DataFrame) -> DataFrame:
    return companies.filter(is_scrapable())


def is_due(as_of: Column) -> Column:
    waiting = F.col("next_scrape_at").isNull() | (F.col("next_scrape_at") <= as_of)
    return is_scrapable() & waiting


def due(companies: DataFrame, as_of: Column) -> DataFrame:
    """Scrapable companies whose time has come, those never scheduled first."""
    return companies.filter(is_due(as_of)).orderBy(
        F.col("next_scrape_at").asc_nulls_first(), "company_id"
    )


def dispatch_set(companies: DataFrame, as_of: Column) -> DataFrame:
    """The scheduler's own rule: not failing, and a time that has passed."""
    return alive(companies).filter(
        F.col("is_verified") & F.col("is_active") & (F.col("scrape_health") != "failing")
        & (F.col("next_scrape_at") <= as_of)
    )


def needs_attention(companies: DataFrame) -> DataFrame:
    return companies.filter(
        F.col("scrape_health").isin(*ATTENTION_HEALTH)
        | F.col("detection_status").isin(*ATTENTION_DETECTION)
    )


def pending_detection(companies: DataFrame, limit: int = 50) -> DataFrame:
    waiting = alive(companies).filter(F.col("detection_status") == "pending")
    return waiting.orderBy("created_at", "company_id").limit(limit)


def is_public_company() -> Column:
    return F.col("is_verified") & F.col("is_active") & ~F.col("is_deleted")


def public_companies(companies: DataFrame) -> DataFrame:
    return companies.filter(is_public_company())


def filter_exams(
    exams: DataFrame, body: str = "", category: str = "", level: str = ""
) -> DataFrame:
    """Comma lists of body slugs, categories and levels; ``body_slug`` must be joined on."""
    result = exams
    for name, spec in (("body_slug", body), ("category", category), ("level", level)):
        if spec:
            result = result.filter(F.col(name).isin(*_values(spec)))
    return result


def applications_open(exams: DataFrame, cycles: DataFrame, on: Column) -> DataFrame:
    inside = (
        F.col("is_published") & (F.col("application_start") <= on)
        & (F.col("application_end") >= on)
    )
    return semi_any(exams, cycles, "exam_id", inside)


CYCLE_DATES = (
    "notification_date", "application_start", "application_end", "fee_last_date", "result_date",
)
STAGE_DATES = ("date_start", "admit_card_date", "result_date")


def upcoming(
    exams: DataFrame, cycles: DataFrame, stages: DataFrame, start: Column, days: int
) -> DataFrame:
    """Exams with any published cycle or stage date in the next ``days`` days."""
    end = F.date_add(start, days)
    published = cycles.filter("is_published")
    by_cycle = published.filter(any_of([F.col(c).between(start, end) for c in CYCLE_DATES]))
    hot = stages.filter(any_of([F.col(c).between(start, end) for c in STAGE_DATES]))
    by_stage = published.join(hot.select("cycle_id"), "cycle_id", "left_semi")
    hits = by_cycle.select("exam_id").unionByName(by_stage.select("exam_id"))
    return exams.join(hits, "exam_id", "left_semi")


def allows_final_year(exams: DataFrame, eligibility: DataFrame) -> DataFrame:
    return semi_any(exams, eligibility, "exam_id", F.col("allow_final_year"))


def published_cycles(
    cycles: DataFrame, exam_id: int | None = None, status: str = "", year: int | None = None
) -> DataFrame:
    result = cycles.filter("is_published")
    if exam_id is not None:
        result = result.filter(F.col("exam_id") == exam_id)
    if status:
        result = result.filter(F.col("status") == status)
    if year is not None:
        result = result.filter(F.col("cycle_year") == year)
    return result.orderBy(
        F.col("application_start").asc_nulls_last(), F.col("notification_date").asc_nulls_last(),
        "cycle_id",
    )


def semi_any(parent: DataFrame, child: DataFrame, key: str, condition: Column) -> DataFrame:
    """Parents with at least one child row that meets the condition."""
    return parent.join(child.filter(condition).select(key), key, "left_semi")


def drop_blocked(df: DataFrame, url_col: str) -> DataFrame:
    return df.filter(~is_blocked_host(host_of(url_col)))


def admin_search(
    df: DataFrame, text: str, fields: Sequence[str], equal: Mapping[str, object] | None = None
) -> DataFrame:
    """Every word must occur in at least one field; ``equal`` adds exact filters."""
    tests = [any_of([contains_ci(F.col(f), word) for f in fields]) for word in text.split()]
    tests += [F.col(name) == F.lit(value) for name, value in (equal or {}).items()]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def candidate_queue(candidates: DataFrame, status: str | None = None) -> DataFrame:
    return candidates.filter(F.col("status") == (status or "pending")).orderBy(
        F.col("score").desc(), "company_id", "url"
    )


# Names and domains that mark rows made for tests and demonstrations.
FIXTURE_DOMAIN_SUFFIXES = (".example", ".invalid", ".demo.example")
FIXTURE_DOMAINS = ("example.com",)
FIXTURE_NAME_PREFIXES = (
    "Smoke", "Bulk Co", "Company ", "Probe", "Due Now", "Paused Inc", "Failing Co",
    "Click Lever", "Burly Wood", "Acme Robotics", "Lever Demo",
)
FIXTURE_EMAIL_SUFFIXES = ("@example.com", "@test.invalid", ".invalid")


def is_fixture_company(
    domain: Column, name: Column, suffixes: Sequence[str] = FIXTURE_DOMAIN_SUFFIXES,
    prefixes: Sequence[str] = FIXTURE_NAME_PREFIXES,
) -> Column:
    host = F.lower(F.coalesce(domain, F.lit("")))
    return (
        any_of([host.endswith(s) for s in suffixes]) | host.isin(*FIXTURE_DOMAINS)
        | any_of([F.coalesce(name, F.lit("")).startswith(p) for p in prefixes])
    )


def is_fixture_email(email: Column, protected: Sequence[str] = ()) -> Column:
    address = F.lower(F.coalesce(email, F.lit("")))
    fixture = any_of([address.endswith(s) for s in FIXTURE_EMAIL_SUFFIXES])
    return fixture & ~address.isin(*protected) if protected else fixture


def flag_fixtures(
    companies: DataFrame, users: DataFrame, protected: Sequence[str] = ()
) -> DataFrame:
    """Fixture companies and users with what an apply run would do to each."""
    firms = companies.filter(is_fixture_company(F.col("domain"), F.col("name"))).select(
        F.lit("company").alias("kind"), F.col("company_id").alias("key"),
        F.when(F.col("is_verified"), "unverified").otherwise("skip (already unverified)").alias(
            "action"),
    )
    people = users.filter(is_fixture_email(F.col("email"), protected)).select(
        F.lit("user").alias("kind"), F.col("user_id").alias("key"),
        F.when(F.col("is_active"), "deactivated").otherwise("skip (already inactive)").alias(
            "action"),
    )
    return firms.unionByName(people)


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """Point lookup; the equality reaches the file scan."""
    return df.filter(F.col(key) == F.lit(value))

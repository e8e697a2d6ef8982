"""A whole scrape cycle over all companies as one Spark job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..session import cut_lineage
from ..sources.feeds import ingest_postings, unreadable
from ..sources.snapshots import clear_fetch_state, diff_snapshots, quarantine, url_hash
from .aggregates import run_tally
from .filters import dispatch_set
from .history import recent_trusted
from .merge import HIT, assign, with_hits
from .postings import upsert_postings
from .strikes import apply_strikes

#: Minutes until a company that needs a browser is visited again.
DEFER_MINUTES = 30
# The texts of run reasons; run tables that exist hold them.
UNMODIFIED_REASON = "Conditional GET indicated no changes"
SKIPPED = " (strikes skipped)"
TEXT_COLUMNS = ("url", "body", "error")


@dataclass(frozen=True)
class CycleResult:
    """The next versions of the tables, and what the cycle adds to others."""

    jobs: DataFrame
    companies: DataFrame
    runs: DataFrame
    events: DataFrame
    outcomes: DataFrame
    artifacts: DataFrame
    fetch_state: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"jobs": self.jobs, "companies": self.companies, "runs": self.runs,
                "events": self.events, "artifacts": self.artifacts,
                "fetch_state": self.fetch_state}


EMPTY_STATE = ("url_hash string, etag string, last_modified string, body_hash string, "
               "hit_count int, miss_count int")


def _documents(fetches: DataFrame, companies: DataFrame, due: DataFrame) -> DataFrame:
    """Fetched documents of due companies, with all columns a document may have."""
    given = fetches.columns
    blank = {c: F.lit(None).cast("string") for c in TEXT_COLUMNS if c not in given}
    blank |= {} if "http_status" in given else {"http_status": F.lit(200)}
    blank |= {} if "escalation" in given else {"escalation": F.lit(False)}
    rows = fetches.withColumns(blank).drop("career_url").join(due, "company_id", "left_semi")
    career = F.col("career_url") if "career_url" in companies.columns else F.lit("")
    return rows.join(companies.select("company_id", career.alias("career_url")), "company_id")


def _company_modes(docs: DataFrame, state: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(company_id, mode, error) of every fetched company, and the next fetch state of its
    addresses. Modes: failed, deferred, unmodified, unreadable, parsed."""
    fetched = docs.filter("error IS NULL AND url IS NOT NULL").select("url", "body", "http_status")
    seen = diff_snapshots(state, fetched.dropDuplicates(["url"]), as_of)
    same = docs.withColumn("_hash", url_hash("url")).join(
        seen.select(F.col("url_hash").alias("_hash"), F.col("outcome").alias("_seen")), "_hash",
        "left")
    unmodified = (F.col("http_status") == 304) | F.coalesce(
        F.col("_seen") == "not_modified", F.lit(False))
    modes = same.groupBy("company_id").agg(
        F.min("error").alias("error"), F.bool_or("escalation").alias("_deferred"),
        F.bool_and(unmodified).alias("_same"),
        F.bool_or(~unmodified & unreadable(F.col("source_type"), F.col("body"))).alias("_broken"),
    ).select("company_id", "error", F.when(F.col("error").isNotNull(), "failed").when(
        F.col("_deferred"), "deferred").when(F.col("_same"), "unmodified").when(
        F.col("_broken"), "unreadable").otherwise("parsed").alias("mode"))
    updated = state.join(seen.select("url_hash"), "url_hash", "left_anti")
    fresh = seen.join(state.drop("body_hash", "hit_count", "miss_count"), "url_hash", "left")
    return modes, updated.unionByName(fresh.select(*[
        F.col(c).cast(state.schema[c].dataType) for c in state.columns]))


def _baselines(history: DataFrame) -> DataFrame:
    good = (F.col("status") == "success") & (
        F.coalesce("notes", F.lit("")) != "deferred_to_browser")
    return history.filter(good).groupBy("company_id").agg(
        F.max_by("jobs_found", F.struct("finished_at", "run_id")).alias("baseline"))


def _judged(modes: DataFrame, tally: DataFrame, baseline: DataFrame, companies: DataFrame,
            as_of: Column) -> DataFrame:
    """One run per fetched company: counts, status, verdict, reason and notes."""
    prior = F.col("last_jobs_seen") if "last_jobs_seen" in companies.columns else F.col("baseline")
    rows = modes.join(tally, "company_id", "left").join(baseline, "company_id", "left").join(
        companies.select("company_id", *[c for c in ("last_jobs_seen",) if c in companies.columns]),
        "company_id", "left").fillna(0, subset=["baseline", *[
            c for c in tally.columns if c != "company_id"]])
    mode, parsed = F.col("mode"), F.col("jobs_found")
    verdict = rules.run_verdict(
        F.when(parsed > 0, "success").otherwise("failure"), parsed, F.col("baseline"))

    def reason(head: str, text: Column) -> Column:
        return F.concat(F.lit(head), F.substring(text, 1, 100))

    found = F.when(mode == "unmodified", F.coalesce(prior, F.lit(0))).when(
        mode == "parsed", parsed).otherwise(0)
    rows = rows.withColumn("_v", verdict).withColumn("_found", found)
    trusted = F.col("_v.verdict") == "trusted"
    return rows.select(
        "company_id", "mode", as_of.alias("finished_at"),
        F.when(mode == "failed", "failed").when(mode == "unreadable", "partial").when(
            mode == "deferred", "success").when(F.col("_found") > 0, "success").otherwise(
            "partial").alias("status"),
        F.col("_found").cast("int").alias("jobs_found"),
        F.col("jobs_created").cast("int").alias("jobs_added"),
        *[F.col(f"jobs_{c}").cast("int").alias(f"jobs_{c}")
          for c in ("updated", "unchanged", "reopened")],
        F.when(mode == "parsed", F.col("_v.verdict")).when(
            mode.isin("failed", "unreadable"), "untrusted").otherwise("trusted").alias("verdict"),
        F.when(mode == "parsed", F.concat("_v.reason", F.when(trusted, "").otherwise(SKIPPED)))
        .when(mode == "unmodified", UNMODIFIED_REASON).when(
            mode == "failed", reason("FetchError: ", F.col("error")))
        .when(mode == "unreadable", "ParseError: unreadable document").otherwise("").alias(
            "verdict_reason"),
        F.when(mode == "unmodified", "not_modified").when(
            mode == "deferred", "deferred_to_browser").otherwise("").alias("notes"),
    )


def _visited(companies: DataFrame, runs: DataFrame, recent: DataFrame, as_of: Column,
             uuid_key: bool) -> DataFrame:
    """Companies after one run each: failure counter, health, next visit and revisit interval. A
    failed or unreadable run moves the counter only; a run without changes counts as a full
    success; a run that waits for a browser moves the next visit only."""
    facts = runs.select("company_id", "mode", "jobs_found", "verdict").join(
        recent, "company_id", "left")
    marked = with_hits(companies, facts, "company_id", "mode", "jobs_found", "verdict", "recent")
    mode, parsed = F.col("c_mode"), F.col("c_mode") == "parsed"
    won = (mode == "unmodified") | (parsed & (F.col("c_jobs_found") > 0))
    waits = mode == "deferred"
    failures = F.when(won, 0).when(waits, F.col("consecutive_failures")).otherwise(
        F.col("consecutive_failures") + 1).cast("int")
    old = F.col("scrape_interval_minutes")
    interval = F.when(
        (F.col("c_verdict") == "trusted") & mode.isin("parsed", "unmodified"),
        rules.adaptive_interval(old, F.col("c_recent"))).otherwise(old).cast("int")
    marked = marked.withColumn("_failures", failures).withColumn("_interval", interval)
    n, moved = F.col("_failures"), F.col("_interval") != old
    visited = mode.isin("parsed", "unmodified")

    def jittered(minutes: Column) -> Column:
        return rules.next_scrape_at(as_of, minutes, F.col("company_id"), uuid_key=uuid_key)

    values: dict[str, Column] = {
        "consecutive_failures": n,
        "scrape_health": F.when(won, "healthy").when(waits | (n < 2), F.col("scrape_health")).when(
            n >= 5, "failing").otherwise("degraded"),
        "scrape_interval_minutes": F.col("_interval"),
        "last_scraped_at": F.when(visited, as_of).otherwise(F.col("last_scraped_at"))
        if "last_scraped_at" in companies.columns else as_of,
        "next_scrape_at": F.when(moved, jittered(F.col("_interval"))).when(
            parsed, as_of + rules.minutes(old)).when(mode == "unmodified", jittered(old)).when(
            waits, as_of + rules.minutes(F.lit(DEFER_MINUTES))).otherwise(
            F.col("next_scrape_at")),
    }
    same = mode == "unmodified"
    optional = {
        "last_successful_scrape_at": lambda: F.when(same, as_of).otherwise(
            F.col("last_successful_scrape_at")),
        "total_scrapes": lambda: F.col("total_scrapes") + F.when(same, 1).otherwise(0),
        "last_failure_reason": lambda: F.when(~same, F.col("last_failure_reason")).otherwise(""),
    }
    values |= {c: build() for c, build in optional.items() if c in companies.columns}
    return assign(marked, F.col(HIT), values, companies.columns)


def scrape_cycle(
    jobs: DataFrame, companies: DataFrame, history: DataFrame, fetches: DataFrame, as_of: Column,
    first_run_id: int = 0, uuid_key: bool = False, fetch_state: DataFrame | None = None,
) -> CycleResult:
    """Dispatch due companies, read what was fetched for them, and carry all tables on.

    ``fetches`` holds company_id, source_type and body, and optionally url, http_status, error (the
    fetch failed) and escalation (the page needs a browser); ``history`` the earlier runs;
    ``fetch_state`` what is known of addresses. A company has one run:

    * a failed fetch and an unreadable document count as failures and are not trusted;
    * a page that needs a browser is put off;
    * unchanged documents (status 304, or a known body) are a sighting of every open job;
    * other documents are parsed and merged, and the run is judged against the last successful one.
      Only a trusted run strikes the jobs it did not show; of others the reason says so.

    Bodies of runs that are not trusted are returned as artifacts, and the validators of their
    addresses cleared, so that the next fetch is a full one.
    """
    due = dispatch_set(companies, as_of).select("company_id")
    state = fetch_state if fetch_state is not None else fetches.sparkSession.createDataFrame(
        [], EMPTY_STATE)
    docs = cut_lineage(_documents(fetches, companies, due))
    modes, next_state = _company_modes(docs, state, as_of)
    modes = cut_lineage(modes)
    parsed = modes.filter("mode = 'parsed'").select("company_id")
    postings = ingest_postings(docs.join(parsed, "company_id", "left_semi")).withColumn(
        "row_id", F.struct("company_id", "source_type", "source_url", "source_job_id", "pos"))
    merged = upsert_postings(jobs, companies, postings, as_of)
    tally = run_tally(merged.outcomes, "company_id")
    runs = cut_lineage(_judged(modes, tally, _baselines(history), companies, as_of))
    trusted = runs.filter("mode = 'parsed' AND verdict = 'trusted'").select("company_id")
    seen = merged.outcomes.join(trusted, "company_id", "left_semi").select("company_id", "job_id")
    struck = apply_strikes(merged.jobs, seen, as_of)
    unchanged = runs.filter("mode = 'unmodified'").select("company_id")
    touched = with_hits(struck.jobs, unchanged, "company_id")
    alive = F.col(HIT) & (F.col("status") == "open") & ~F.col("is_deleted")
    next_jobs = assign(touched, alive, {"last_seen_at": as_of}, jobs.columns)

    missing = struck.struck.groupBy("company_id").agg(
        F.count(F.lit(1)).cast("int").alias("jobs_missing"))
    key = F.col("company_id") if uuid_key else F.col("company_id") + first_run_id
    runs = cut_lineage(runs.join(missing, "company_id", "left").fillna(
        0, subset=["jobs_missing"]).withColumn("run_id", key))
    columns = ("run_id", "company_id", "finished_at", "jobs_added", "jobs_missing", "verdict")
    ran = history.select(*columns).unionByName(
        runs.filter("mode <> 'deferred'").select(*columns)).join(
        runs.select("company_id"), "company_id", "left_semi")
    bad = runs.filter("verdict <> 'trusted'")
    bodies = docs.filter("body IS NOT NULL").join(
        bad.select("company_id", "run_id"), "company_id").select("run_id", "url", "body")
    bad_urls = docs.join(bad.select("company_id"), "company_id", "left_semi").filter(
        "url IS NOT NULL").select("url")
    events = merged.events.unionByName(
        struck.events.select("job_id", "from_status", "to_status", "trigger", "created_at"))
    return CycleResult(
        next_jobs, _visited(companies, runs, recent_trusted(ran), as_of, uuid_key), runs, events,
        merged.outcomes, quarantine(bad, bodies), clear_fetch_state(next_state, bad_urls))

"""Batches of company changes: adding, candidate decisions, schedule controls, archiving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, texts, urls
from ..session import cut_lineage
from .filters import FIXTURE_DOMAIN_SUFFIXES, is_fixture_company, is_fixture_email
from .history import unique_slugs
from .joins import find_duplicate_companies
from .merge import HIT, assign, with_hits
from .reviews import set_published

NO_TIME = "timestamp_ntz"

# Profile columns an edit may change.
PROFILE_COLUMNS = (
    "name", "logo_url", "description", "hq_location", "industry", "size_bucket", "linkedin_url",
    "notes",
)


def _empty_time() -> Column:
    return F.lit(None).cast(NO_TIME)


def _next(as_of: Column, interval: Column | None = None, uuid_key: bool = False) -> Column:
    wait = F.col("scrape_interval_minutes") if interval is None else interval
    return rules.next_scrape_at(as_of, wait, F.col("company_id"), uuid_key=uuid_key)


def _base_slug(fold: bool) -> Column:
    slug = F.substring(texts.slugify("name", fold), 1, 200)
    return F.when(slug == "", "company").otherwise(slug)


def _judge_new(
    companies: DataFrame, rows: DataFrame, reason: Column
) -> tuple[DataFrame, DataFrame]:
    """Split incoming rows into usable and rejected: own reason first, then collisions with
    stored companies, then with an earlier row of the same batch."""
    judged = cut_lineage(rows.withColumn("reject_reason", reason))
    fine = judged.filter(F.col("reject_reason").isNull())
    clash = find_duplicate_companies(companies, fine).withColumn(
        "reject_reason",
        F.when(F.col("match_id").isNotNull(), F.concat(
            F.lit("already tracked: "), F.col("match_id").cast("string"))),
    ).drop("match_rule", "match_id")
    fresh = clash.filter(F.col("reject_reason").isNull())
    as_stored = fresh.select(
        F.col("incoming_id").alias("company_id"), "career_source_type", "ats_identifier",
        "domain", "career_url", F.lit(False).alias("is_deleted"),
    )
    # a row collides inside the batch if an earlier one owns one of its keys
    inner = find_duplicate_companies(as_stored, fresh)
    late = F.col("match_id").isNotNull() & (F.col("match_id") < F.col("incoming_id"))
    marked = inner.withColumn(
        "reject_reason", F.when(late, "repeated in the batch")
    ).drop("match_rule", "match_id")
    rejected = (
        judged.filter(F.col("reject_reason").isNotNull())
        .unionByName(clash.filter(F.col("reject_reason").isNotNull()))
        .unionByName(marked.filter(F.col("reject_reason").isNotNull()))
    )
    accepted = cut_lineage(marked.filter(F.col("reject_reason").isNull()).drop("reject_reason"))
    return accepted, rejected.select("incoming_id", "reject_reason")


def add_from_website(
    companies: DataFrame, batch: DataFrame, as_of: Column, fold: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``batch``: incoming_id, name, website_url. New companies wait for detection."""
    rows = batch.withColumn("name", F.trim(F.coalesce("name", F.lit("")))).withColumn(
        "domain", urls.host_of(urls.normalize_url("website_url"))
    ).withColumn("career_url", F.lit("")).withColumn("career_source_type", F.lit("unknown")
    ).withColumn("ats_identifier", F.lit(""))
    reason = (
        F.when(F.col("name") == "", "name is missing")
        .when(F.col("domain") == "", "no domain in the address")
        .when(urls.is_blocked_host("domain"), "blocked domain")
    )
    accepted, rejected = _judge_new(companies, rows, reason)
    slugged = unique_slugs(
        accepted.withColumn("_base_slug", _base_slug(fold)), companies.select("slug"),
        "incoming_id", "_base_slug",
    )
    created = slugged.select(
        "incoming_id", "name", "slug", "domain", F.lit("main_website").alias("input_type"),
        F.col("website_url").alias("input_url"), "career_url",
        F.lit("pending").alias("detection_status"), F.lit(False).alias("is_verified"),
        as_of.alias("created_at"),
    )
    return created, rejected


def add_from_career_url(
    companies: DataFrame, batch: DataFrame, as_of: Column, default_interval: int = 300,
    fold: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``batch``: incoming_id, name, career_url, scrape_interval_minutes (may be null). Returns
    created companies, their source rows and the rejected rows. Board hosts are no domain."""
    sniffed = batch.withColumn("name", F.trim(F.coalesce("name", F.lit("")))).withColumn(
        "_s", urls.sniff_source("career_url")
    ).withColumn("_host", urls.host_of("career_url"))
    on_board = urls.is_registry_ats_host("_host")
    rows = (
        sniffed.withColumn("_board", on_board)
        .withColumn("input_url", F.col("career_url"))
        .withColumn("career_url", urls.normalize_url("career_url"))
        .withColumn("domain", F.when(~F.col("_board"), F.col("_host")))
        .withColumn("source_type", F.col("_s.source_type"))
        .withColumn("identifier", F.coalesce("_s.identifier", F.lit("")))
        .withColumn("career_source_type", F.col("source_type"))
        .withColumn("ats_identifier", F.when(F.col("_board"), F.col("identifier")).otherwise(""))
    )
    wait = F.col("scrape_interval_minutes")
    reason = (
        F.when(F.col("name") == "", "name is missing")
        .when(wait < rules.MIN_INTERVAL_MINUTES, "interval is too short")
        .when(F.col("_s.blocked"), "blocked domain")
        .when(~F.col("_board") & (F.col("_host") == ""), "no domain in the address")
    )
    accepted, rejected = _judge_new(companies, rows, reason)
    slugged = unique_slugs(
        accepted.withColumn("_base_slug", _base_slug(fold)), companies.select("slug"),
        "incoming_id", "_base_slug",
    )
    interval = F.coalesce("scrape_interval_minutes", F.lit(default_interval))
    created = slugged.select(
        "incoming_id", "name", "slug", "domain", F.lit("direct_career").alias("input_type"),
        "input_url", F.col("input_url").alias("career_url"),
        F.col("source_type").alias("career_source_type"),
        F.col("identifier").alias("ats_identifier"),
        F.lit("skipped").alias("detection_status"), F.lit(True).alias("is_verified"),
        F.lit("unknown").alias("scrape_health"), interval.alias("scrape_interval_minutes"),
        rules.next_scrape_at(as_of, interval, F.col("incoming_id")).alias("next_scrape_at"),
        as_of.alias("created_at"),
    )
    sources = slugged.select(
        "incoming_id", F.col("input_url").alias("url"), F.col("career_url").alias(
            "normalized_url"),
        "source_type", F.col("identifier").alias("ats_identifier"),
        F.lit(True).alias("is_current"), F.lit("direct career url").alias("reason"),
        as_of.alias("set_at"),
    )
    return created, sources, rejected


def _verified_with(url: Column, source: Column, identifier: Column, status: str, as_of: Column,
                   uuid_key: bool) -> dict[str, Column]:
    return {
        "career_url": url, "career_source_type": source, "ats_identifier": identifier,
        "detection_status": F.lit(status), "is_verified": F.lit(True), "verified_at": as_of,
        "scrape_health": F.lit("unknown"), "consecutive_failures": F.lit(0),
        "next_scrape_at": _next(as_of, uuid_key=uuid_key), "career_url_set_at": as_of,
    }


def approve_candidates(
    candidates: DataFrame, companies: DataFrame, decisions: DataFrame, as_of: Column,
    uuid_key: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``decisions``: company_id, normalized_url, at most one per company. The chosen candidate
    is approved, the other waiting ones are rejected, the company gets the URL. Returns
    candidates, companies, new source rows and rejected decisions."""
    key = ["company_id", "normalized_url"]
    firm = companies.select(
        "company_id", "is_verified", F.col("career_url").alias("_now")
    )
    asked = decisions.select(*key).join(
        candidates.select(*key, "status", "url", "guessed_type", "ats_identifier"), key, "left"
    ).join(firm, "company_id", "left")
    other = F.col("is_verified") & (F.col("_now") != "") & (
        urls.normalize_url("_now") != F.col("normalized_url")
    )
    judged = asked.withColumn(
        "reject_reason",
        F.when(F.col("status").isNull(), "unknown candidate")
        .when(F.col("status") != "pending", "already decided")
        .when(other, "verified with another URL"),
    )
    good = judged.filter(F.col("reject_reason").isNull())
    refused = judged.filter(F.col("reject_reason").isNotNull()).select(*key, "reject_reason")
    chosen = good.select("company_id", F.col("normalized_url").alias("chosen"))
    marked = with_hits(candidates, chosen, "company_id", "chosen")
    is_chosen = F.col("normalized_url") == F.col("c_chosen")
    decided = assign(
        marked, F.col(HIT) & (F.col("status") == "pending"),
        {
            "status": F.when(is_chosen, "approved").otherwise("rejected"),
            "decided_at": F.when(is_chosen, as_of).otherwise(
                F.col("decided_at") if "decided_at" in candidates.columns else _empty_time()),
            "reject_reason": F.when(is_chosen, F.lit("")).otherwise("another candidate approved"),
        },
        candidates.columns,
    )
    hits = with_hits(companies, good.select("company_id", "url", "guessed_type",
                                            "ats_identifier"),
                     "company_id", "url", "guessed_type", "ats_identifier")
    state = assign(
        hits, F.col(HIT),
        _verified_with(F.col("c_url"), F.col("c_guessed_type"), F.col("c_ats_identifier"),
                       "verified", as_of, uuid_key),
        companies.columns,
    )
    sources = good.select(
        "company_id", "url", "normalized_url", F.col("guessed_type").alias("source_type"),
        "ats_identifier", as_of.alias("set_at"), F.lit("approved candidate").alias("reason"),
    )
    return decided, state, sources, refused


def reject_candidates(
    candidates: DataFrame, companies: DataFrame, decisions: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """``decisions``: company_id, normalized_url, reason. A company under review without any
    waiting candidate left counts as not found."""
    key = ["company_id", "normalized_url"]
    marked = candidates.join(
        decisions.select(*key, F.col("reason").alias("_reason"), F.lit(True).alias(HIT)), key,
        "left",
    )
    turned = F.coalesce(F.col(HIT), F.lit(False)) & (F.col("status") == "pending")
    decided = assign(
        marked, turned,
        {"status": F.lit("rejected"), "decided_at": as_of, "reject_reason": F.col("_reason")},
        candidates.columns,
    )
    left = decided.groupBy("company_id").agg(
        F.count_if(F.col("status") == "pending").alias("waiting")
    )
    touched = marked.filter(turned).select("company_id").distinct().join(left, "company_id")
    hits = with_hits(companies, touched, "company_id", "waiting")
    empty = F.col(HIT) & (F.col("c_waiting") == 0) & (F.col("detection_status") == "needs_review")
    return decided, assign(
        hits, empty, {"detection_status": F.lit("not_found")}, companies.columns
    )


def set_career_urls(
    companies: DataFrame, changes: DataFrame, as_of: Column, uuid_key: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``changes``: company_id, career_url. Addresses another company uses are rejected."""
    sniffed = changes.select(
        "company_id", F.col("career_url").alias("url"),
        urls.normalize_url("career_url").alias("normalized_url"),
        urls.sniff_source("career_url").alias("_s"),
    )
    owners = companies.filter(~F.col("is_deleted") & (F.col("career_url") != "")).groupBy(
        F.col("career_url").alias("normalized_url")
    ).agg(F.min("company_id").alias("_low"), F.max("company_id").alias("_high"))
    judged = sniffed.join(owners, "normalized_url", "left").withColumn(
        "reject_reason",
        F.when(F.col("_s.blocked"), "blocked domain").when(
            (F.col("_low") != F.col("company_id")) | (F.col("_high") != F.col("company_id")),
            "used by another company",
        ),
    )
    good = judged.filter(F.col("reject_reason").isNull()).select(
        "company_id", "url", "normalized_url", "_s.source_type", "_s.identifier"
    )
    hits = with_hits(companies, good, "company_id", "url", "source_type", "identifier")
    state = assign(
        hits, F.col(HIT),
        _verified_with(F.col("c_url"), F.col("c_source_type"), F.col("c_identifier"), "manual",
                       as_of, uuid_key),
        companies.columns,
    )
    sources = good.select(
        "company_id", "url", "normalized_url", "source_type",
        F.col("identifier").alias("ats_identifier"), as_of.alias("set_at"),
        F.lit("manual override").alias("reason"),
    )
    refused = judged.filter(F.col("reject_reason").isNotNull()).select(
        "company_id", "reject_reason"
    )
    return state, sources, refused


def _apply(companies: DataFrame, keys: DataFrame, values: dict[str, Column]) -> DataFrame:
    marked = with_hits(companies, keys.select("company_id").distinct(), "company_id")
    return assign(marked, F.col(HIT), values, companies.columns)


def request_redetection(
    companies: DataFrame, candidates: DataFrame, keys: DataFrame
) -> tuple[DataFrame, DataFrame]:
    state = _apply(companies, keys, {"detection_status": F.lit("pending")})
    marked = with_hits(candidates, keys.select("company_id").distinct(), "company_id")
    waiting = F.col(HIT) & (F.col("status") == "pending")
    rejected = assign(
        marked, waiting,
        {"status": F.lit("rejected"), "reject_reason": F.lit("redetection requested")},
        candidates.columns,
    )
    return state, rejected


def pause(companies: DataFrame, keys: DataFrame, note: str = "") -> DataFrame:
    values = {
        "is_active": F.lit(False), "scrape_health": F.lit("paused"),
        "next_scrape_at": _empty_time(),
    }
    if note:
        values["notes"] = F.lit(note)
    return _apply(companies, keys, values)


def resume(companies: DataFrame, keys: DataFrame, as_of: Column,
           uuid_key: bool = False) -> DataFrame:
    return _apply(companies, keys, {
        "is_active": F.lit(True), "scrape_health": F.lit("unknown"),
        "consecutive_failures": F.lit(0), "next_scrape_at": _next(as_of, uuid_key=uuid_key),
    })


def set_interval(
    companies: DataFrame, changes: DataFrame, as_of: Column, uuid_key: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``changes``: company_id, minutes. Intervals under the minimum are rejected."""
    good = changes.filter(F.col("minutes") >= rules.MIN_INTERVAL_MINUTES)
    marked = with_hits(companies, good, "company_id", "minutes")
    minutes = F.col("c_minutes").cast("int")
    state = assign(
        marked, F.col(HIT),
        {"scrape_interval_minutes": minutes, "next_scrape_at": _next(as_of, minutes, uuid_key)},
        companies.columns,
    )
    refused = changes.filter(~(F.col("minutes") >= rules.MIN_INTERVAL_MINUTES)).select(
        "company_id", F.lit("interval is too short").alias("reject_reason")
    )
    return state, refused


def reset_failures(companies: DataFrame, keys: DataFrame) -> DataFrame:
    kept = F.when(F.col("scrape_health") == "paused", "paused").otherwise("unknown")
    return _apply(companies, keys, {
        "consecutive_failures": F.lit(0), "last_failure_reason": F.lit(""),
        "scrape_health": kept,
    })


def unverify(companies: DataFrame, keys: DataFrame) -> DataFrame:
    nobody = F.lit(None)
    return _apply(companies, keys, {
        "is_verified": F.lit(False), "verified_by": nobody, "verified_at": _empty_time(),
    })


def edit_companies(companies: DataFrame, edits: DataFrame, fold: bool = True) -> DataFrame:
    """Edits as rows ``(company_id, field, value)``; other fields than the profile ones are
    ignored. A new name gets a new slug."""
    fields = [f for f in PROFILE_COLUMNS if f in companies.columns]
    wide = edits.filter(F.col("field").isin(*fields)).groupBy("company_id").agg(
        *[F.max(F.when(F.col("field") == f, F.struct("value"))).alias(f"e_{f}") for f in fields]
    )
    renamed = wide.filter(F.col("e_name").isNotNull()).select(
        "company_id", F.col("e_name.value").alias("name")
    ).withColumn("_base_slug", _base_slug(fold))
    slugs = unique_slugs(renamed, companies.select("slug"), "company_id", "_base_slug").select(
        "company_id", F.col("slug").alias("new_slug")
    )
    full = wide.join(slugs, "company_id", "left")
    marked = with_hits(companies, full, "company_id", *[c for c in full.columns
                                                        if c != "company_id"])
    values = {
        f: F.when(F.col(f"c_e_{f}").isNotNull(), F.col(f"c_e_{f}")["value"]).otherwise(F.col(f))
        for f in fields
    }
    values["slug"] = F.coalesce("c_new_slug", "slug")
    return assign(marked, F.col(HIT), values, companies.columns)


def archive_companies(
    companies: DataFrame, jobs: DataFrame, keys: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """Soft-delete companies and unpublish all their jobs."""
    state = _apply(companies, keys, {"is_deleted": F.lit(True), "deleted_at": as_of})
    theirs = jobs.join(keys.select("company_id"), "company_id", "left_semi").filter(
        F.col("is_published") & ~F.col("is_deleted")
    )
    return state, set_published(jobs, theirs, False, as_of)


def unarchive_companies(companies: DataFrame, keys: DataFrame) -> DataFrame:
    return _apply(companies, keys, {"is_deleted": F.lit(False), "deleted_at": _empty_time()})


def backfill_ats_identity(companies: DataFrame) -> DataFrame:
    """Companies that keep a board host as domain get the board identity instead."""
    on_board = urls.is_registry_ats_host(F.coalesce("domain", F.lit("")))
    found = urls.sniff_source("career_url")
    marked = companies.withColumn("_board", on_board).withColumn("_found", found)
    return assign(
        marked, F.col("_board"),
        {
            "domain": F.lit(None).cast("string"),
            "career_source_type": F.coalesce("_found.source_type", "career_source_type"),
            "ats_identifier": F.coalesce("_found.identifier", "ats_identifier"),
        },
        companies.columns,
    )


def unverify_fixtures(
    companies: DataFrame, users: DataFrame, protected: tuple[str, ...] = (),
    suffixes: tuple[str, ...] = FIXTURE_DOMAIN_SUFFIXES,
) -> tuple[DataFrame, DataFrame]:
    """Unverify fixture companies and switch off fixture users."""
    firms = companies.filter(is_fixture_company(F.col("domain"), F.col("name"), suffixes))
    people = is_fixture_email(F.col("email"), protected)
    return unverify(companies, firms), users.withColumn(
        "is_active", F.col("is_active") & ~people
    )

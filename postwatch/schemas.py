"""Column contracts of the canonical tables as DDL, and the allowed values of code columns."""

from __future__ import annotations

from pyspark.sql.types import StructType

TABLES = {
    "company": (
        "company_id string, name string, slug string, domain string, industry string, "
        "input_type string, input_url string, career_url string, career_source_type string, "
        "ats_identifier string, detection_status string, detection_attempts int, "
        "last_detection_at timestamp_ntz, is_verified boolean, verified_by string, "
        "verified_at timestamp_ntz, is_active boolean, is_deleted boolean, "
        "deleted_at timestamp_ntz, scrape_health string, scrape_interval_minutes int, "
        "next_scrape_at timestamp_ntz, last_scraped_at timestamp_ntz, "
        "last_successful_scrape_at timestamp_ntz, last_jobs_seen int, consecutive_failures int, "
        "total_scrapes bigint, total_failures bigint, last_failure_reason string, notes string, "
        "logo_url string, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "company_source": (
        "source_id string, company_id string, url string, normalized_url string, "
        "source_type string, ats_identifier string, is_current boolean, set_at timestamp_ntz, "
        "retired_at timestamp_ntz, reason string"
    ),
    "career_candidate": (
        "company_id string, normalized_url string, url string, score int, "
        "score_reasons array<struct<rule:string,points:int,detail:string>>, origin string, "
        "discovered_via string, page_title string, http_status int, "
        "sample_job_titles array<string>, guessed_type string, ats_identifier string, "
        "status string, decided_at timestamp_ntz, reject_reason string"
    ),
    "job": (
        "job_id string, company_id string, source_job_id string, source_url string, "
        "normalized_source_url string, apply_url string, content_hash string, "
        "parser_version string, title string, title_normalized string, slug string, "
        "description string, description_html string, description_html_sanitized string, "
        "location_raw string, city string, state string, country string, work_mode string, "
        "job_type string, experience_level string, salary_min decimal(12,2), "
        "salary_max decimal(12,2), salary_currency string, salary_period string, "
        "department string, skills array<string>, posted_at timestamp_ntz, "
        "deadline_at timestamp_ntz, status string, missing_count int, "
        "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, closed_at timestamp_ntz, "
        "reopened_count int, is_published boolean, published_at timestamp_ntz, "
        "needs_review boolean, review_reason string, reviewed_at timestamp_ntz, "
        "manually_edited_fields array<string>, is_manual_status boolean, duplicate_of string, "
        "extraction_confidence int, report_count bigint, save_count bigint, is_deleted boolean, "
        "deleted_at timestamp_ntz"
    ),
    "job_status_event": (
        "job_id string, from_status string, to_status string, missing_count int, "
        "trigger string, created_at timestamp_ntz"
    ),
    "scrape_run": (
        "run_id string, company_id string, finished_at timestamp_ntz, status string, "
        "jobs_found int, jobs_added int, jobs_updated int, jobs_unchanged int, "
        "jobs_missing int, jobs_reopened int, verdict string, verdict_reason string, notes string"
    ),
    "source_fetch_state": (
        "url string, url_hash string, etag string, last_modified string, body_hash string, "
        "hit_count bigint, miss_count bigint, last_fetched_at timestamp_ntz"
    ),
    "exam_cycle": (
        "cycle_id string, exam_id string, cycle_year int, cycle_label string, status string, "
        "notification_date date, application_start date, application_end date, "
        "fee_last_date date, correction_window_start date, correction_window_end date, "
        "result_date date, extraction_confidence int, verified_by_human boolean, "
        "is_published boolean, official_notification_url string, created_at timestamp_ntz"
    ),
    "audit_log": (
        "object_id string, action string, actor_label string, source string, "
        "before map<string,string>, after map<string,string>, changed_fields array<string>, "
        "created_at timestamp_ntz"
    ),
}


def table_schema(name: str) -> StructType:
    """Declared schema of a canonical table, for reading files without inference."""
    return StructType.fromDDL(TABLES[name])


# Allowed values of every code column.
DOMAINS = {
    "job.status": ("open", "possibly_closed", "likely_closed", "closed", "draft"),
    "job.job_type": (
        "full_time", "part_time", "internship", "contract", "temporary", "freelance", "unknown",
    ),
    "job.work_mode": ("onsite", "remote", "hybrid", "unknown"),
    "job.experience_level": ("fresher", "entry", "mid", "senior", "lead", "unknown"),
    "report.reason": (
        "expired", "broken_link", "wrong_details", "duplicate", "spam", "other",
    ),
    "report.status": ("open", "reviewing", "resolved", "rejected"),
    "company.career_source_type": (
        "own_career_page", "greenhouse", "lever", "ashby", "smartrecruiters", "workday",
        "unknown",
    ),
    "company.detection_status": (
        "pending", "running", "needs_review", "verified", "not_found", "manual", "skipped",
        "failed", "candidates_found", "no_candidates", "success", "partial", "superseded",
    ),
    "company.scrape_health": ("unknown", "healthy", "degraded", "failing", "paused"),
    "candidate.status": ("pending", "approved", "rejected"),
    "exam.level": ("national", "state"),
    "exam.category": (
        "civil_services", "banking", "railway", "ssc", "teaching", "defence", "engineering",
        "medical", "law", "state_psc", "other",
    ),
    "cycle.status": (
        "announced", "notification_out", "applications_open", "applications_closed",
        "admit_card_out", "exam_conducted", "result_out", "cancelled", "postponed",
    ),
}

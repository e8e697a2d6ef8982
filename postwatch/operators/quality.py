"""Data-quality rules: every check returns its violating rows as (rule, key, detail)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import is_registry_ats_host
from ..schemas import DOMAINS
from .filters import is_fixture_email
from .joins import with_verifier

MAX_FAILURES = 50
MIN_INTERVAL = 30


def _text(*columns: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def check_unique(
    df: DataFrame, keys: Sequence[str], rule: str, where: Column | None = None
) -> DataFrame:
    """Key values that occur more than once."""
    rows = df if where is None else df.filter(where)
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return counted.select(
        F.lit(rule).alias("rule"), _text(*keys).alias("key"),
        F.col("_n").cast("string").alias("detail"),
    )


def check_rows(df: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """Rows for which a rule does not hold; several rules are read in one scan. An unknown
    (null) test passes, as in a database check."""
    broken = F.array_compact(
        F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()])
    )
    return df.select(F.explode(broken).alias("rule"), _text(*key).alias("key")).withColumn(
        "detail", F.lit("")
    )


def check_orphans(child: DataFrame, parent: DataFrame, key: str, rule: str) -> DataFrame:
    lost = child.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")
    return lost.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"),
        F.col("_n").cast("string").alias("detail"),
    )


def check_enums(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Values outside the allowed ones, with their number; ``columns`` maps column → domain."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(d).alias("domain"),
                               F.col(c).alias("value")) for c, d in columns.items()])
    allowed = F.create_map(
        *[p for d in set(columns.values())
          for p in (F.lit(d), F.array(*[F.lit(v) for v in DOMAINS[d]]))]
    )
    values = df.select(F.explode(pairs).alias("p")).select("p.*")
    odd = values.filter(
        F.col("value").isNotNull() & ~F.array_contains(F.element_at(allowed, F.col("domain")),
                                                       F.col("value"))
    )
    return odd.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n")).select(
        F.concat(F.lit("enum_"), F.col("column")).alias("rule"), F.col("value").alias("key"),
        F.col("_n").cast("string").alias("detail"),
    )


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def check_job_unique(jobs: DataFrame) -> DataFrame:
    live = ~F.col("is_deleted")
    return union([
        check_unique(jobs, ["company_id", "source_job_id"], "job_source_id",
                     live & (F.col("source_job_id") != "")),
        check_unique(jobs, ["company_id", "title_normalized", "normalized_source_url"],
                     "job_title_url", live),
    ])


def check_job_rows(jobs: DataFrame) -> DataFrame:
    return check_rows(jobs, ["job_id"], {
        "missing_count_max": F.col("missing_count") <= 3,
        "closed_needs_time": (F.col("status") != "closed") | F.col("closed_at").isNotNull(),
        "salary_range": F.col("salary_max") >= F.col("salary_min"),
        "confidence_range": F.col("extraction_confidence") <= 100,
    })


def check_companies(companies: DataFrame) -> DataFrame:
    live = ~F.col("is_deleted")
    return union([
        check_unique(companies, ["domain"], "company_domain",
                     live & F.col("domain").isNotNull()),
        check_unique(companies, ["career_url"], "company_career_url",
                     live & (F.col("career_url") != "")),
        check_unique(companies, ["career_source_type", "ats_identifier"], "company_board",
                     live & (F.col("ats_identifier") != "")),
        check_rows(companies, ["company_id"], {
            "interval_min": F.col("scrape_interval_minutes") >= MIN_INTERVAL,
            "verified_needs_url": ~F.col("is_verified") | (F.col("career_url") != ""),
            "failures_max": F.col("consecutive_failures") <= MAX_FAILURES,
        }),
    ])


def check_sources(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    return union([
        check_unique(sources, ["company_id"], "one_current_source", F.col("is_current")),
        check_unique(candidates, ["company_id"], "one_approved_candidate",
                     F.col("status") == "approved"),
        check_unique(candidates, ["company_id", "normalized_url"], "candidate_url"),
        check_rows(candidates, ["company_id", "normalized_url"], {
            "candidate_score": F.col("score").between(0, 100),
        }),
    ])


def check_cycles(cycles: DataFrame) -> DataFrame:
    return union([
        check_unique(cycles, ["exam_id", "cycle_year", "cycle_label"], "cycle_triple"),
        check_rows(cycles, ["cycle_id"], {
            "cycle_confidence": F.col("extraction_confidence").between(0, 100),
            "published_needs_check": ~F.col("is_published") | F.col("verified_by_human"),
        }),
    ])


def check_child_unique(
    stages: DataFrame, saved_exams: DataFrame, saved_jobs: DataFrame, reports: DataFrame
) -> DataFrame:
    return union([
        check_unique(stages, ["cycle_id", "stage_order"], "stage_order"),
        check_unique(saved_exams, ["user_id", "exam_id"], "saved_exam"),
        check_unique(saved_jobs, ["user_id", "job_id"], "saved_job"),
        check_unique(reports, ["job_id", "user_id"], "one_open_report",
                     F.col("status") == "open"),
    ])


def check_users(users: DataFrame) -> DataFrame:
    lowered = users.withColumn("email", F.lower("email"))
    return union([
        check_unique(lowered, ["email"], "user_email"),
        check_rows(users, ["user_id"], {
            "user_phone": (F.col("phone") == "") | F.col("phone").rlike(r"^\+[1-9]\d{1,14}$"),
            "user_experience": F.col("experience_years") >= 0,
        }),
    ])


def check_ats_domains(companies: DataFrame) -> DataFrame:
    return check_rows(companies, ["company_id"], {
        "board_as_domain": ~is_registry_ats_host(F.coalesce("domain", F.lit(""))),
    })


def _bad_provenance(protected: Sequence[str]) -> Column:
    return (
        F.col("verifier_email").isNull() | ~F.col("verifier_active")
        | is_fixture_email(F.col("verifier_email"))
    )


def public_surface_audit(
    companies: DataFrame, jobs: DataFrame, users: DataFrame, protected: Sequence[str] = ()
) -> DataFrame:
    """Verified companies with a missing, inactive or fixture verifier, their published open
    jobs, and fixture users that are still active."""
    verified = companies.filter(F.col("is_verified") & ~F.col("is_deleted"))
    flagged = with_verifier(verified, users).filter(_bad_provenance(protected))
    shown = jobs.filter(
        F.col("is_published") & (F.col("status") == "open") & ~F.col("is_deleted")
    ).join(flagged.select("company_id"), "company_id", "left_semi")
    active = users.filter(F.col("is_active") & is_fixture_email(F.col("email"), protected))

    def rows(df: DataFrame, kind: str, key: str) -> DataFrame:
        return df.select(F.lit(kind).alias("violation"), F.col(key).cast("string").alias("key"))

    return union([
        rows(flagged, "bad_provenance", "company_id"),
        rows(shown, "job_of_bad_company", "job_id"),
        rows(active, "active_fixture_user", "user_id"),
    ])


def audit_summary(companies: DataFrame, users: DataFrame) -> DataFrame:
    """Verified companies, those with a bad verifier, and the clean rest."""
    verified = companies.filter(F.col("is_verified") & ~F.col("is_deleted"))
    judged = with_verifier(verified, users)
    bad = F.coalesce(_bad_provenance(()), F.lit(True))
    return judged.agg(
        F.count(F.lit(1)).alias("verified"), F.count_if(bad).alias("violations"),
        F.count_if(~bad).alias("clean"),
    )

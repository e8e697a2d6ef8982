"""Source health: outcome of runs, back-off and revisit intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .history import recent_trusted
from .merge import HIT, assign, with_hits
from .ordered import time_chunk, with_running_sum

REASON_CHARS = 2000


def _run_summary(runs: DataFrame) -> DataFrame:
    """Per company: counts, last run, failures before the first and after the last success, and
    the longest series of failures between two successes."""
    failed = ~F.col("success")
    key = F.struct("finished_at", "run_id")
    base = runs.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(failed).alias("failed_runs"),
        F.max_by(F.struct("success", "finished_at", "failure_reason"), key).alias("last"),
        F.max(F.when(~failed, F.col("finished_at"))).alias("last_success_at"),
        F.max_by(
            "jobs_seen", F.when(~failed & F.col("trusted"), key)
        ).alias("last_seen_count"),
    )
    numbered = with_running_sum(
        runs, ["company_id"], ["finished_at", "run_id"], F.when(failed, 0).otherwise(1),
        "_series", time_chunk("finished_at", "day"),
    )
    series = numbered.filter(failed).groupBy("company_id", "_series").agg(
        F.count(F.lit(1)).alias("_length")
    )
    wins = runs.groupBy("company_id").agg(F.count_if(~failed).alias("_wins"))
    streaks = series.join(wins, "company_id").groupBy("company_id").agg(
        F.max(F.when(F.col("_series") == 0, F.col("_length"))).alias("leading"),
        F.max(F.when(F.col("_series") == F.col("_wins"), F.col("_length"))).alias("trailing"),
        F.max(F.when(F.col("_series") > 0, F.col("_length"))).alias("longest"),
    )
    return base.join(streaks, "company_id", "left").fillna(
        0, subset=["leading", "trailing", "longest"]
    )


def record_outcomes(
    companies: DataFrame, runs: DataFrame, mode: str = "full", uuid_key: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Health state of every company after a batch of runs, and one row per transition.

    ``runs``: run_id, company_id, finished_at, success, trusted, jobs_seen, failure_reason. The
    batch may hold many runs per company; they are applied in time order. ``mode='light'`` is the
    plain counter without pausing and back-off.
    """
    summary = _run_summary(runs)
    names = [c for c in summary.columns if c != "company_id"]
    marked = with_hits(companies, summary, "company_id", *names)
    old = F.col("consecutive_failures")
    won = F.col("c_last_success_at").isNotNull()
    failures = (F.when(won, F.col("c_trailing")).otherwise(old + F.col("c_failed_runs"))).cast(
        "int")
    end, success = F.col("c_last.finished_at"), F.col("c_last.success")
    worst = F.greatest(
        F.when(F.col("c_leading") > 0, old + F.col("c_leading")).otherwise(0),
        F.col("c_longest"),
    )
    marked = marked.withColumn("_failures", failures).withColumn("_worst", worst)
    n = F.col("_failures")
    if mode == "light":
        label = (
            F.when(n == 0, "healthy").when(n >= 5, "failing").when(n >= 2, "degraded")
            .when(won, "healthy").otherwise(F.col("scrape_health"))
        )
        values = {
            "consecutive_failures": n, "scrape_health": label, "last_scraped_at": end,
            "next_scrape_at": end + rules.minutes(F.col("scrape_interval_minutes")),
        }
    else:
        paused = n >= rules.PAUSE_AFTER_FAILURES
        values = {
            "consecutive_failures": n,
            "scrape_health": rules.health_for(n),
            "is_active": F.col("is_active") & (F.col("_worst") < rules.PAUSE_AFTER_FAILURES),
            "next_scrape_at": F.when(
                ~paused,
                rules.next_scrape_at(
                    end, F.col("scrape_interval_minutes"), F.col("company_id"),
                    F.when(success, 1).otherwise(rules.backoff_factor(n)), uuid_key,
                ),
            ),
            "last_failure_reason": F.when(success, "").otherwise(
                F.substring("c_last.failure_reason", 1, REASON_CHARS)
            ),
            "last_scraped_at": end,
        }
    optional = {
        "last_successful_scrape_at": lambda: F.coalesce(
            "c_last_success_at", "last_successful_scrape_at"),
        "last_jobs_seen": lambda: F.coalesce("c_last_seen_count", "last_jobs_seen"),
        "total_scrapes": lambda: F.col("total_scrapes") + F.col("c_runs"),
        "total_failures": lambda: F.col("total_failures") + F.col("c_failed_runs"),
    }
    values |= {c: build() for c, build in optional.items() if c in companies.columns}
    applied = assign(marked, F.col(HIT), values, companies.columns)
    active = values.get("is_active", F.col("is_active"))
    moved = (
        (values["scrape_health"] != F.col("scrape_health")) | (active != F.col("is_active"))
        | values["next_scrape_at"].isNull()
    )
    transitions = marked.filter(F.col(HIT) & moved).select(
        "company_id", F.col("scrape_health").alias("from_health"),
        values["scrape_health"].alias("to_health"), active.alias("is_active"),
        n.alias("consecutive_failures"), end.alias("at"),
    )
    return applied, transitions


def apply_intervals(
    companies: DataFrame, runs: DataFrame, as_of: Column, uuid_key: bool = False
) -> DataFrame:
    """New revisit interval from the three newest trusted runs, where it changes."""
    recent = recent_trusted(runs)
    marked = with_hits(companies, recent, "company_id", "recent")
    interval = rules.adaptive_interval(F.col("scrape_interval_minutes"), F.col("c_recent")).cast(
        "int"
    )
    marked = marked.withColumn("_interval", interval)
    moved = F.col(HIT) & (F.col("_interval") != F.col("scrape_interval_minutes"))
    return assign(
        marked, moved,
        {
            "scrape_interval_minutes": F.col("_interval"),
            "next_scrape_at": rules.next_scrape_at(
                as_of, F.col("_interval"), F.col("company_id"), uuid_key=uuid_key
            ),
        },
        companies.columns,
    )

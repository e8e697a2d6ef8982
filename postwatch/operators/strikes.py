"""Ageing of postings that are no longer listed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .merge import assign
from .ordered import time_chunk, with_running_sum

MAX_STRIKES = 3
LISTED = ("open", "possibly_closed", "likely_closed")

# Status after each strike.
LADDER = ("possibly_closed", "likely_closed", "closed")


def ladder_status(strikes: Column) -> Column:
    steps = F.array(*[F.lit(s) for s in ("open", *LADDER)])
    return F.element_at(steps, (strikes + 1).cast("int"))


@dataclass(frozen=True)
class StrikeResult:
    jobs: DataFrame
    events: DataFrame
    struck: DataFrame


def apply_strikes(jobs: DataFrame, seen: DataFrame, as_of: Column) -> StrikeResult:
    """One strike for every listed job its company no longer shows.

    ``seen`` holds (company_id, job_id) of one round. A company without any seen job gets no
    strikes at all: an empty result is more likely a broken source.
    """
    shown = seen.select("job_id").distinct().withColumn("_seen", F.lit(True))
    active = seen.select("company_id").distinct().withColumn("_active", F.lit(True))
    marked = jobs.join(shown, "job_id", "left").join(active, "company_id", "left")
    struck = (
        F.col("_seen").isNull() & F.col("_active").isNotNull() & ~F.col("is_deleted")
        & F.col("status").isin(*LISTED) & ~F.col("is_manual_status")
    )
    marked = marked.withColumn("_struck", struck).withColumn(
        "_n", F.least(F.col("missing_count") + 1, F.lit(MAX_STRIKES))
    ).withColumn("_to", ladder_status(F.col("_n")))
    state = assign(
        marked, F.col("_struck"),
        {
            "status": F.col("_to"), "missing_count": F.col("_n"),
            "closed_at": F.when(F.col("_to") == "closed", as_of).otherwise(F.col("closed_at")),
        },
        jobs.columns,
    )
    struck_rows = marked.filter(F.col("_struck")).select(
        "job_id", "company_id", F.col("status").alias("from_status"),
        F.col("_to").alias("to_status"), F.col("_n").alias("missing_count"),
        F.lit("ladder").alias("trigger"), as_of.alias("created_at"),
    )
    return StrikeResult(state, struck_rows.filter("from_status <> to_status"), struck_rows)


def strike_counts(jobs: DataFrame, result: StrikeResult) -> DataFrame:
    """Struck jobs per company and resulting status."""
    before = jobs.select("job_id", F.col("missing_count").alias("_before"),
                         F.col("status").alias("_status"))
    joined = result.jobs.join(before, "job_id")
    struck = joined.filter(
        (F.col("missing_count") != F.col("_before")) | (F.col("status") != F.col("_status"))
    )
    return struck.groupBy("company_id", "status").agg(F.count(F.lit(1)).alias("jobs"))


def replay(jobs: DataFrame, runs: DataFrame, sightings: DataFrame) -> DataFrame:
    """Strikes of every job after a whole history of runs, without walking through the runs.

    A run counts if it is trusted, was not skipped as unmodified and showed at least one job. A
    job's strikes are the counting runs of its company after the job was last seen: the
    company's total minus the running count at that moment, at most three. Jobs and runs are
    never paired with each other.
    """
    shown = sightings.select("run_id").distinct().withColumn("_shown", F.lit(True))
    # what is told of a run is one flag before it moves
    told = runs.select("run_id", "company_id", "finished_at", (
        (F.col("verdict") == "trusted") & (F.coalesce("notes", F.lit("")) != "not_modified")
    ).alias("_told"))
    # used three times below: written once, so that runs and sightings meet once
    counted = written(told.join(shown, "run_id", "left").select(
        "run_id", "company_id", "finished_at",
        F.when(F.col("_told") & F.col("_shown"), 1).otherwise(0).alias("_counts")), "runs")
    numbered = with_running_sum(
        counted, ["company_id"], ["finished_at", "run_id"], F.col("_counts"), "_upto",
        time_chunk("finished_at", "month"),
    ).select("run_id", "company_id", "finished_at", "_upto")
    totals = counted.groupBy("company_id").agg(F.sum("_counts").alias("_total"))
    # a later run has a count at least as high, so the highest count belongs to the last sighting
    last_seen = sightings.join(numbered.select("run_id", "finished_at", "_upto"), "run_id").groupBy(
        "job_id"
    ).agg(F.max("_upto").alias("_seen_at"), F.max("finished_at").alias("last_seen_at"))
    rows = jobs.join(last_seen, "job_id", "left").join(totals, "company_id", "left")
    missed = F.coalesce("_total", F.lit(0)) - F.coalesce("_seen_at", F.lit(0))
    strikes = F.least(missed, F.lit(MAX_STRIKES)).cast("int")
    return rows.select(
        "job_id", "company_id", "last_seen_at", strikes.alias("missing_count"),
        ladder_status(strikes).alias("status"),
    )

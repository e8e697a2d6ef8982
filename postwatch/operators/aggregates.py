"""Counts, facets and dashboards. All aggregate map-side before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .filters import is_due, is_live, live_jobs
from .joins import with_company
from .ordered import top_per_key

TOP_FACETS = 20


def facet(jobs: DataFrame, column: str) -> DataFrame:
    return live_jobs(jobs).groupBy(column).agg(F.count(F.lit(1)).alias("jobs"))


def facet_company(jobs: DataFrame, companies: DataFrame, top: int = TOP_FACETS) -> DataFrame:
    """Companies with most live jobs. Counts first, so only one row per company is joined."""
    counts = facet(jobs, "company_id")
    named = with_company(counts, companies)
    return named.select("company_slug", "company_name", "jobs").orderBy(
        F.col("jobs").desc(), "company_slug"
    ).limit(top)


def facet_department(jobs: DataFrame, top: int = TOP_FACETS) -> DataFrame:
    counts = facet(jobs.filter(F.col("department") != ""), "department")
    return counts.orderBy(F.col("jobs").desc(), "department").limit(top)


def job_facets(jobs: DataFrame, companies: DataFrame, top: int = TOP_FACETS) -> DataFrame:
    """All four facets from one pass over the live jobs (grouping sets)."""
    dims = ("work_mode", "job_type", "company_id", "department")
    live = live_jobs(jobs).select(*dims)
    sets = live.groupingSets([[F.col(d)] for d in dims], *dims).agg(
        F.count(F.lit(1)).alias("jobs"), F.grouping_id().alias("_set")
    )
    # the set that holds only column i has all the other bits raised
    code = {d: 0b1111 ^ (1 << (len(dims) - 1 - i)) for i, d in enumerate(dims)}
    facet_name = F.lit(None).cast("string")
    for name, number in code.items():
        facet_name = F.when(F.col("_set") == number, name).otherwise(facet_name)
    slugs = companies.select("company_id", F.col("slug").alias("_slug"))
    labelled = sets.withColumn("facet", facet_name).join(slugs, "company_id", "left")
    value = (
        F.when(F.col("facet") == "work_mode", F.col("work_mode"))
        .when(F.col("facet") == "job_type", F.col("job_type"))
        .when(F.col("facet") == "department", F.col("department"))
        .otherwise(F.col("_slug"))
    )
    rows = labelled.select("facet", value.alias("value"), "jobs").filter(
        ~((F.col("facet") == "department") & (F.col("value") == ""))
        & F.col("value").isNotNull()
    )
    rows = cut_lineage(rows)  # counts only; otherwise both uses below would scan the jobs
    ranked = top_per_key(rows, ["facet"], [F.col("jobs").desc(), F.col("value")], top)
    whole = rows.filter(F.col("facet").isin("work_mode", "job_type"))
    return ranked.filter(F.col("facet").isin("company_id", "department")).unionByName(
        whole
    ).withColumn("facet", F.replace("facet", F.lit("company_id"), F.lit("company")))


def count_by_enum(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Counts for every allowed value, zero where none occurs."""
    spark = df.sparkSession
    values = spark.range(1).select(
        F.explode(F.array(*[F.lit(v) for v in domain])).alias(column)
    )
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("total"))
    return values.join(counts, column, "left").select(
        column, F.coalesce("total", F.lit(0)).alias("total")
    )


def _counts_onto(companies: DataFrame, jobs: DataFrame, **tests: Column) -> DataFrame:
    counted = jobs.groupBy("company_id").agg(
        *[F.count_if(test).alias(name) for name, test in tests.items()]
    )
    joined = companies.join(counted, "company_id", "left")
    return joined.fillna(0, subset=list(tests))


def with_job_counts(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Open and total jobs; deleted jobs count as well."""
    return _counts_onto(
        companies, jobs, open_jobs=F.col("status") == "open", total_jobs=F.lit(True)
    )


def with_public_job_counts(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    return _counts_onto(companies, jobs, open_jobs_count=is_live())


def ops_dashboard(companies: DataFrame, as_of: Column) -> DataFrame:
    """One row of totals over the alive companies."""
    status = F.col("detection_status")
    return companies.filter(~F.col("is_deleted")).agg(
        F.count(F.lit(1)).alias("companies"),
        F.count_if("is_verified").alias("verified"),
        F.count_if(status == "pending").alias("pending"),
        F.count_if(status == "needs_review").alias("needs_review"),
        F.count_if(is_due(as_of)).alias("due_now"),
        F.min(F.when(is_due(as_of), F.col("next_scrape_at"))).alias("next_scrape_at"),
    )


def jobs_by_status(jobs: DataFrame) -> DataFrame:
    """Alive jobs per status, the dashboard's second block."""
    return jobs.filter(~F.col("is_deleted")).groupBy("status").agg(
        F.count(F.lit(1)).alias("jobs"))


def latest_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.col("finished_at").desc(), "run_id").limit(n)


def unchanged_rate(runs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Share of unchanged fetches over the last days, a dash when there was none."""
    recent = runs.filter(F.col("finished_at") >= as_of - F.make_dt_interval(F.lit(days)))
    counted = recent.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("notes") == "not_modified").alias("same")
    )
    return counted.select(
        "runs", "same",
        F.when(F.col("runs") == 0, "-").otherwise(
            F.concat_ws("/", F.col("same").cast("string"), F.col("runs").cast("string"))
        ).alias("label"),
        F.when(F.col("runs") > 0, F.round(F.col("same") * 100 / F.col("runs"), 4)).alias("rate"),
    )


def review_count(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count_if(F.col("needs_review") & ~F.col("is_deleted")).alias("review_count")
    )


def reports_to_review(jobs: DataFrame, reports: DataFrame, at_least: int = 3) -> DataFrame:
    """Published jobs with enough open reports."""
    counted = (
        reports.filter(F.col("status") == "open").groupBy("job_id")
        .agg(F.count(F.lit(1)).alias("open_reports")).filter(F.col("open_reports") >= at_least)
    )
    return jobs.filter("is_published").join(counted, "job_id").withColumn(
        "review_reason", F.lit("user reports")
    )


OUTCOMES = ("created", "updated", "unchanged", "reopened")


def run_tally(outcomes: DataFrame, key: str) -> DataFrame:
    return outcomes.groupBy(key).agg(
        F.count(F.lit(1)).alias("jobs_found"),
        *[F.count_if(F.col("outcome") == o).alias(f"jobs_{o}") for o in OUTCOMES],
    )


def detection_summary(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("company_id").agg(
        F.max("score").alias("best_score"), F.count(F.lit(1)).alias("candidates_found")
    )


def date_hierarchy(df: DataFrame, column: str) -> DataFrame:
    """Counts by year, month and day at once (rollup)."""
    parts = df.filter(F.col(column).isNotNull()).select(
        F.year(column).alias("y"), F.month(column).alias("m"), F.day(column).alias("d")
    )
    return parts.rollup("y", "m", "d").agg(F.count(F.lit(1)).alias("total")).filter(
        F.col("y").isNotNull()
    )


def recount(jobs: DataFrame, saved: DataFrame, reports: DataFrame) -> DataFrame:
    """Save and report counters recomputed from the facts."""
    saves = saved.groupBy("job_id").agg(F.count_distinct("user_id").alias("save_count"))
    noted = reports.groupBy("job_id").agg(F.count(F.lit(1)).alias("report_count"))
    joined = jobs.join(saves, "job_id", "left").join(noted, "job_id", "left")
    return joined.fillna(0, subset=["save_count", "report_count"])


def health_totals(runs: DataFrame) -> DataFrame:
    return runs.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("total_scrapes"),
        F.count_if(F.col("status") == "failed").alias("total_failures"),
    )

"""One-off passes over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.sanitize import sanitize_html


def backfill_slugs(jobs: DataFrame, companies: DataFrame, fold: bool = True) -> DataFrame:
    """Slugs for jobs that have none."""
    named = companies.select("company_id", F.col("name").alias("_company"))
    city = F.col("city") if "city" in jobs.columns else F.lit("")
    made = texts.job_slug(F.col("title"), F.col("_company"), city, F.col("job_id"), fold)
    joined = jobs.join(named, "company_id", "left")
    return joined.withColumn("slug", F.coalesce("slug", made)).select(*jobs.columns)


def backfill_sanitized(
    jobs: DataFrame, force: bool = False, dry_run: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Clean markup where it is missing (or everywhere with ``force``), and the counts."""
    due = F.col("description_html") != ""
    if not force:
        due = due & (F.coalesce("description_html_sanitized", F.lit("")) == "")
    cleaned = jobs.withColumn("_due", due).withColumn(
        "_clean", F.when(F.col("_due"), sanitize_html("description_html"))
    )
    moved = F.col("_due") & (
        F.col("_clean") != F.coalesce("description_html_sanitized", F.lit(""))
    )
    counts = cleaned.agg(
        F.count_if("_due").alias("scanned"), F.count_if(moved).alias("updated"),
        F.count_if(F.col("_due") & ~moved).alias("unchanged"),
    )
    if dry_run:
        return jobs, counts
    state = cleaned.withColumn(
        "description_html_sanitized",
        F.when(moved, F.col("_clean")).otherwise(F.col("description_html_sanitized")),
    ).select(*jobs.columns)
    return state, counts

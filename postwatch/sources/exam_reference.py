"""Nested exam reference documents → flat tables, merged so that loading twice changes nothing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.texts import slugify
from ..operators.merge import merge

SCHEMA = (
    "slug string, name string, short_name string, conducting_body string, body_type string, "
    "state string, website string, category string, level string, description string, "
    "official_url string, typical_month int, "
    "cycles array<struct<year int, cycle_label string, status string, notification_date date, "
    "application_start date, application_end date, fee_last_date date, "
    "correction_window_start date, correction_window_end date, result_date date, "
    "vacancy_count int, official_notification_url string, extraction_confidence int, "
    "stages array<struct<stage_order int, name string, mode string, date_start date, "
    "date_end date, is_date_tentative boolean, admit_card_date date, result_date date, "
    "duration_minutes int, total_marks int>>>>, "
    "eligibility struct<min_age int, max_age int, age_as_on_date date, "
    "age_relaxation map<string,int>, min_qualification string, "
    "allow_final_year_appearing boolean>"
)

KEYS = {
    "body": ["body_slug"], "exam": ["slug"], "cycle": ["slug", "year", "cycle_label"],
    "stage": ["slug", "year", "cycle_label", "stage_order"], "eligibility": ["slug"],
}



def parse_exam_reference(documents: DataFrame, only: str | None = None) -> dict[str, DataFrame]:
    """Flat tables of all levels. ``only`` keeps one exam."""
    doc = documents.select(F.from_json("body", SCHEMA).alias("d")).select("d.*").filter(
        F.col("slug").isNotNull()
    )
    if only is not None:
        doc = doc.filter(F.col("slug") == only)
    body_slug = slugify("conducting_body", fold=False)
    bodies = doc.select(
        body_slug.alias("body_slug"), F.col("conducting_body").alias("name"),
        F.coalesce("body_type", F.lit("central")).alias("body_type"),
        F.coalesce("state", F.lit("")).alias("state"),
        F.coalesce("website", F.lit("")).alias("website"), F.col("slug").alias("_doc"),
    )
    first = bodies.groupBy("body_slug").agg(
        F.min_by(F.struct("name", "body_type", "state", "website"), "_doc").alias("b")
    ).select("body_slug", "b.*")
    exams = doc.select(
        "slug", "name", F.coalesce("short_name", F.lit("")).alias("short_name"),
        body_slug.alias("body_slug"), "category", "level",
        F.coalesce("official_url", F.lit("")).alias("official_url"), "typical_month",
    )
    cycles = doc.select("slug", F.explode("cycles").alias("c")).select("slug", "c.*").withColumn(
        "cycle_label", F.coalesce("cycle_label", F.col("year").cast("string"))
    ).withColumn("status", F.coalesce("status", F.lit("announced"))).withColumn(
        "extraction_confidence", F.coalesce("extraction_confidence", F.lit(100))
    )
    stages = cycles.select("slug", "year", "cycle_label", F.explode("stages").alias("s")).select(
        "slug", "year", "cycle_label", "s.*"
    ).withColumn("mode", F.coalesce("mode", F.lit("online_cbt"))).withColumn(
        "is_date_tentative", F.coalesce("is_date_tentative", F.lit(False))
    )
    eligibility = doc.select("slug", "eligibility.*").withColumn(
        "allow_final_year_appearing", F.coalesce("allow_final_year_appearing", F.lit(False))
    )
    # new facts are never published before a person has checked them
    unchecked = cycles.drop("stages").withColumn("verified_by_human", F.lit(False)).withColumn(
        "is_published", F.lit(False)
    )
    return {"body": first, "exam": exams, "cycle": unchecked, "stage": stages,
            "eligibility": eligibility}


def load_exam_reference(
    documents: DataFrame, current: Mapping[str, DataFrame], only: str | None = None
) -> dict[str, DataFrame]:
    """Merge the documents into the current tables. Bodies are only created; the other levels
    are created or updated. Each result carries ``merge_outcome``."""
    parsed = parse_exam_reference(documents, only)
    result = {}
    for name, rows in parsed.items():
        if name not in current:
            result[name] = rows.withColumn("merge_outcome", F.lit("inserted"))
            continue
        columns = [c for c in rows.columns if c not in KEYS[name]
                   and c in current[name].columns]
        result[name] = merge(
            current[name], rows, KEYS[name], columns, insert_only=name == "body"
        )
    return result

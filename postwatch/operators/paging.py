"""Orders, pages and counts. NULL placement is always spelled out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100

JOB_ORDERS = ("posted_at", "-posted_at", "created_at", "-created_at", "title")
COMPANY_ORDERS = ("name", "-name", "open_jobs_count", "-open_jobs_count")
EXAM_ORDERS = ("name", "-name", "created_at", "-created_at")


def _store_order(name: str) -> Column:
    """NULL placement of the source database: last when ascending, first when descending."""
    if name.startswith("-"):
        return F.col(name[1:]).desc_nulls_first()
    return F.col(name).asc_nulls_last()


def _checked(spec: str, allowed: tuple[str, ...]) -> list[str]:
    names = [item.strip() for item in spec.split(",") if item.strip()]
    unknown = [name for name in names if name not in allowed]
    if unknown:
        raise ValueError(f"unknown ordering: {', '.join(unknown)}")
    return names


def job_order(spec: str = "") -> list[Column]:
    """Sort columns of a job list. An explicit ``-posted_at`` leads and puts undated jobs last."""
    names = _checked(spec, JOB_ORDERS)
    if not names:
        return [_store_order("-posted_at"), F.col("job_id").asc()]
    lead = [F.col("posted_at").desc_nulls_last()] if "-posted_at" in names else []
    rest = [_store_order(name) for name in names if name != "-posted_at"]
    return [*lead, *rest, F.col("job_id").asc()]


def order_jobs(df: DataFrame, spec: str = "") -> DataFrame:
    return df.orderBy(*job_order(spec))


def company_order(spec: str = "") -> list[Column]:
    names = _checked(spec, COMPANY_ORDERS) or ["name"]
    return [*[_store_order(name) for name in names], F.col("company_id").asc()]


def order_companies(df: DataFrame, spec: str = "") -> DataFrame:
    return df.orderBy(*company_order(spec))


def order_exams(df: DataFrame, spec: str = "") -> DataFrame:
    names = _checked(spec, EXAM_ORDERS) or ["name"]
    return df.orderBy(*[_store_order(name) for name in names], "exam_id")


# Default order of each table.
DEFAULT_ORDERS = {
    "job": ("-posted_at", "-first_seen_at"),
    "company": ("name",),
    "candidate": ("-score",),
    "exam": ("-created_at",),
    "stage": ("stage_order",),
    "date_change": ("-changed_at",),
    "event": ("-created_at",),
}


def default_order(df: DataFrame, table: str, key: str) -> DataFrame:
    return df.orderBy(*[_store_order(name) for name in DEFAULT_ORDERS[table]], key)


def paginate(
    df: DataFrame, order: list[Column], page: int = 1, size: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    """One page; Spark keeps only the leading rows of every task instead of sorting all."""
    if not 1 <= size <= MAX_PAGE_SIZE or page < 1:
        raise ValueError(f"pages count from 1 and have 1 to {MAX_PAGE_SIZE} rows")
    return df.orderBy(*order).limit(page * size).offset((page - 1) * size)


def total_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))

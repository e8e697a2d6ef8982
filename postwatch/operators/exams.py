"""Exam cycles: eligibility, date changes, nested reference documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

# Date columns whose changes are recorded.
TRACKED_DATES = (
    "notification_date", "application_start", "application_end", "fee_last_date",
    "correction_window_start", "correction_window_end", "result_date",
)


def eligibility_checks(
    pairs: DataFrame, users: DataFrame, eligibility: DataFrame, on: Column
) -> DataFrame:
    """Age, age limit and verdict for every given (user, exam) pair."""
    joined = pairs.join(users, "user_id").join(eligibility, "exam_id")
    limit = rules.effective_max_age(
        F.col("max_age"), F.col("age_relaxation"), F.col("category"), F.col("is_pwbd"),
        F.col("is_ex_serviceman"), F.col("service_years"),
    )
    aged = joined.withColumn("age", rules.age_years("date_of_birth", on)).withColumn(
        "age_limit", limit
    )
    fits = (
        F.coalesce(F.col("age") >= F.col("min_age"), F.lit(True))
        & F.coalesce(F.col("age") <= F.col("age_limit"), F.lit(True))
        & (F.col("allow_final_year") | ~F.col("is_final_year"))
    )
    return aged.withColumn("eligible", fits)


def update_cycles(
    cycles: DataFrame, changes: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply at most one change row per cycle: new state, date-change rows, rejected changes.

    ``changes`` has ``cycle_id`` and, per changeable column, a value column and a flag
    ``set_<column>`` (a null value can be meant). Publishing needs a human check; taking the
    check back unpublishes.
    """
    fields = [c for c in changes.columns if f"set_{c}" in changes.columns]
    new = changes.select(
        "cycle_id", *[F.col(c).alias(f"new_{c}") for c in fields],
        *[F.col(f"set_{c}") for c in fields],
    )
    joined = cycles.join(new.withColumn("_hit", F.lit(True)), "cycle_id", "left")

    def wanted(name: str) -> Column:
        if name not in fields:
            return F.col(name)
        return F.when(F.coalesce(f"set_{name}", F.lit(False)), F.col(f"new_{name}")).otherwise(
            F.col(name)
        )

    def asked(name: str, value: bool) -> Column:
        if name not in fields:
            return F.lit(False)
        return F.coalesce(F.col(f"set_{name}") & (F.col(f"new_{name}") == F.lit(value)),
                          F.lit(False))

    hit = F.coalesce("_hit", F.lit(False))
    rejected = hit & asked("is_published", True) & ~wanted("verified_by_human")
    marked = joined.withColumn("_rejected", rejected)
    applies = hit & ~F.col("_rejected")
    dropped = asked("verified_by_human", False) & F.col("is_published")

    def final(name: str) -> Column:
        value = wanted(name)
        if name == "is_published":
            value = F.when(dropped, F.lit(False)).otherwise(value)
        return F.when(applies, value).otherwise(F.col(name))

    state = marked.select(*[final(c).alias(c) for c in cycles.columns])
    tracked = [c for c in TRACKED_DATES if c in fields]
    pairs = F.array(
        *[F.struct(
            F.lit(c).alias("field_name"),
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias("old_value"),
            F.coalesce(final(c).cast("string"), F.lit("")).alias("new_value"),
        ) for c in tracked]
    )
    moved = F.filter(pairs, lambda p: p["old_value"] != p["new_value"])
    events = marked.filter(applies).select(
        "cycle_id", F.explode(moved).alias("change")
    ).select("cycle_id", "change.*", as_of.alias("changed_at"))
    refused = marked.filter("_rejected").select(
        "cycle_id", F.lit("publishing needs a human check").alias("reason")
    )
    return state, events, refused

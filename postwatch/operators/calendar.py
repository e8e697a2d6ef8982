"""Exam calendar: dates of cycles and stages as a flat list of events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import blank_to_null

DEFAULT_DAYS = 90

# Date column -> event type.
CYCLE_EVENTS = {
    "notification_date": "notification", "application_start": "application_start",
    "application_end": "application_end", "fee_last_date": "fee_last_date",
    "correction_window_start": "correction_start", "correction_window_end": "correction_end",
    "result_date": "result",
}
STAGE_EVENTS = {
    "date_start": "stage_exam", "admit_card_date": "admit_card", "result_date": "stage_result",
}


def _dated(df: DataFrame, events: Mapping[str, str], start: Column, end: Column) -> DataFrame:
    """One row per date inside the range; rows without any are dropped before they multiply."""
    pairs = F.array(
        *[F.struct(F.col(c).alias("date"), F.lit(t).alias("event_type"))
          for c, t in events.items()]
    )
    inside = F.filter(pairs, lambda pair: pair["date"].between(start, end))
    return df.withColumn("_pair", F.explode(inside)).select("*", "_pair.*").drop(
        "_pair", *events
    )


def exam_calendar(
    exams: DataFrame, cycles: DataFrame, stages: DataFrame, start: Column,
    end: Column | None = None,
) -> DataFrame:
    """Events of published cycles between two dates (90 days by default)."""
    end = F.date_add(start, DEFAULT_DAYS) if end is None else end
    heads = ("cycle_id", "exam_id", "cycle_label", "official_notification_url")
    published = cycles.filter("is_published")
    of_cycles = _dated(published.select(*heads, *CYCLE_EVENTS), CYCLE_EVENTS, start, end).select(
        *heads, "date", "event_type", F.lit(None).cast("string").alias("stage_name"),
        F.lit(False).alias("is_tentative"),
    )
    of_stages = (
        _dated(
            stages.select("cycle_id", "stage_name", "is_date_tentative", *STAGE_EVENTS),
            STAGE_EVENTS, start, end,
        )
        .join(published.select(*heads), "cycle_id")
        .select(*heads, "date", "event_type", "stage_name",
                F.col("is_date_tentative").alias("is_tentative"))
    )
    named = of_cycles.unionByName(of_stages).join(
        exams.select("exam_id", F.col("name").alias("exam_name"), "exam_slug", "official_url"),
        "exam_id",
    )
    return named.select(
        "date", "event_type", "exam_name", "exam_slug", "cycle_label", "stage_name",
        "is_tentative",
        F.coalesce(blank_to_null(F.col("official_notification_url")), F.col("official_url"))
        .alias("official_url"),
    )

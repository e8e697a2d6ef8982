"""Time-ordered questions over runs, events and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import (
    first_per_key, number_chunk, time_chunk, top_per_key, with_last_known, with_neighbour,
    with_ordered_index, with_running_sum,
)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in document order."""
    return first_per_key(df, keys, order)


def cap_per_group(df: DataFrame, keys: list[str], n: int, order: list[Column]) -> DataFrame:
    return top_per_key(df, keys, order, n)


def with_baseline(runs: DataFrame, skip_deferred: bool = True) -> DataFrame:
    """Jobs found by the successful run before each run, 0 where there was none."""
    counted = (F.col("status") == "success") & F.col("finished_at").isNotNull()
    if skip_deferred:
        counted = counted & (F.coalesce("notes", F.lit("")) != "deferred_to_browser")
    known = with_last_known(
        runs, ["company_id"], ["finished_at", "run_id"],
        F.when(counted, F.col("jobs_found")), "baseline", time_chunk("finished_at", "day"),
    )
    return known.withColumn("baseline", F.coalesce("baseline", F.lit(0)))


def recent_trusted(runs: DataFrame, n: int = 3) -> DataFrame:
    """The newest ``n`` trusted runs per company as an array, newest first."""
    trusted = runs.filter((F.col("verdict") == "trusted") & F.col("finished_at").isNotNull())
    newest = top_per_key(
        trusted, ["company_id"], [F.col("finished_at").desc(), F.col("run_id").desc()], n, "_nth"
    )
    # n rows per company at most, so the list is bounded
    rows = F.collect_list(
        F.struct("_nth", F.col("jobs_added").alias("added"), F.col("jobs_missing").alias("missing"))
    )
    return newest.groupBy("company_id").agg(F.array_sort(rows).alias("recent"))


def status_timeline(events: DataFrame, ties: list[str]) -> DataFrame:
    """Status before each event and the seconds spent in it."""
    both = events.withColumn("_prev", F.struct("to_status", "created_at"))
    stepped = with_neighbour(
        both, ["job_id"], ["created_at", *ties], "_prev", "_before",
        time_chunk("created_at", "month"),
    )
    return stepped.withColumn("from_status", F.coalesce("_before.to_status", F.lit(""))).withColumn(
        "dwell_seconds", F.timestamp_diff("SECOND", F.col("_before.created_at"),
                                          F.col("created_at"))
    ).drop("_prev", "_before")


def failure_streaks(runs: DataFrame) -> DataFrame:
    """Every unbroken series of failed runs: first and last run and its length. The number of
    successes before a run names its series, so only counts cross the chunks."""
    failed = F.col("status") == "failed"
    numbered = with_running_sum(
        runs, ["company_id"], ["finished_at", "run_id"], F.when(failed, 0).otherwise(1),
        "_series", time_chunk("finished_at", "day"),
    )
    return numbered.filter(failed).groupBy("company_id", "_series").agg(
        F.min("finished_at").alias("first_failure"), F.max("finished_at").alias("last_failure"),
        F.count(F.lit(1)).alias("failures"),
    ).drop("_series")


def current_failures(runs: DataFrame) -> DataFrame:
    """Failed runs after the last success of a company: two aggregates and one join."""
    failed = F.col("status") == "failed"
    key = F.struct("finished_at", "run_id")
    last_good = runs.groupBy("company_id").agg(F.max(F.when(~failed, key)).alias("_good"))
    since = runs.filter(failed).join(last_good, "company_id").filter(
        F.col("_good").isNull() | (key > F.col("_good"))
    )
    return since.groupBy("company_id").agg(F.count(F.lit(1)).alias("consecutive_failures"))


def source_history(changes: DataFrame) -> DataFrame:
    """Validity of every source of a company: a newer source retires the one before."""
    stepped = with_neighbour(
        changes, ["company_id"], ["set_at", "source_id"], "set_at", "retired_at",
        time_chunk("set_at", "month"), following=True,
    )
    return stepped.withColumn("is_current", F.col("retired_at").isNull())


def rate_audit(requests: DataFrame, per_minute: int, ts: str = "ts",
               domain: str = "domain") -> DataFrame:
    """Requests per domain and fixed minute, and how many exceed the budget."""
    return requests.groupBy(domain, F.date_trunc("minute", ts).cast("timestamp_ntz").alias(
        "minute")).agg(F.count(F.lit(1)).alias("requests")).withColumn(
        "over_limit", F.greatest(F.col("requests") - per_minute, F.lit(0))
    )


def request_turns(
    requests: DataFrame, per_minute: int | None, key: str, ts: str = "ts", domain: str = "domain"
) -> DataFrame:
    """Every request with its turn in the fixed minute of its domain and whether that is over the
    budget; without a positive budget none is. Equal times go by ``key``.

    The minute is numbered second by second, so a domain that gets very many requests in one
    minute is spread over tasks.
    """
    minute = F.date_trunc("minute", ts).cast("timestamp_ntz")
    turns = with_running_sum(
        requests.withColumn("minute", minute), [domain, "minute"], [ts, key], F.lit(1), "turn",
        time_chunk(ts, "second"),
    )
    limited = per_minute is not None and per_minute > 0
    return turns.withColumn("over_limit", F.col("turn") > per_minute if limited else F.lit(False))


def unique_slugs(df: DataFrame, existing: DataFrame, key: str, base: str) -> DataFrame:
    """Slugs with -1, -2 … where the base is taken, first come (by ``key``) first served.

    The n-th new row of a base gets the n-th number no existing slug has. If r used numbers lie
    below it, that number is n + r; r is an as-of lookup of n among the used numbers, each placed
    at the count of free numbers before it. Neither side is ever paired with the other.
    """
    taken = existing.select(F.col("slug").alias("_slug")).distinct()
    number = F.regexp_extract("_slug", r"-([1-9]\d{0,8})$", 1).try_cast("int")
    used = taken.select(F.col("_slug").alias("_base"), F.lit(0).alias("_n")).unionByName(
        taken.filter(number.isNotNull()).select(
            F.regexp_replace("_slug", r"-\d+$", "").alias("_base"), number.alias("_n")
        )
    )
    gaps = with_running_sum(used, ["_base"], ["_n"], F.lit(1), "_r", number_chunk("_n")).select(
        "_base", (F.col("_n") - F.col("_r") + 1).alias("_pos"), F.lit(0).alias("_kind"),
        F.col("_r").alias("_order"), "_r",
    )
    indexed = with_ordered_index(
        df.select(key, F.col(base).alias("_base")), ["_base", key], "_index"
    )
    first = indexed.groupBy("_base").agg(F.min("_index").alias("_first"))
    rows = indexed.join(first, "_base").select(
        "_base", (F.col("_index") - F.col("_first")).alias("_pos"), F.lit(1).alias("_kind"),
        F.col("_index").alias("_order"), F.lit(None).cast("long").alias("_r"), key,
    )
    placed = with_last_known(
        gaps.unionByName(rows, allowMissingColumns=True), ["_base"],
        ["_pos", "_kind", "_order"], F.col("_r"), "_below", number_chunk("_pos"),
    ).filter(F.col("_kind") == 1)
    at = F.col("_pos") + F.coalesce("_below", F.lit(0))
    suffix = F.concat(F.lit("-"), at.cast("string"))
    cut = F.substring(F.col("_base"), F.lit(1), F.lit(280) - F.length(suffix))
    slug = F.when(at == 0, F.col("_base")).otherwise(F.concat(cut, suffix))
    return df.join(placed.select(key, slug.alias("slug")), key)

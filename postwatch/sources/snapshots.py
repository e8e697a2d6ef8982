"""Fetched bodies against the last known state; quarantine and retention of bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETENTION_DAYS = 14


def url_hash(url: Column | str) -> Column:
    return F.sha2(F.col(url) if isinstance(url, str) else url, 256)


def diff_snapshots(state: DataFrame, snapshot: DataFrame, as_of: Column) -> DataFrame:
    """Per fetched URL: ``new``, ``changed`` or ``not_modified``, with updated counters.

    ``state`` has url_hash, body_hash, hit_count and miss_count; ``snapshot`` has url, body and
    optionally ``http_status`` (304 means unchanged without a body).
    """
    fetched = snapshot.select(
        "url", url_hash("url").alias("url_hash"), F.sha2("body", 256).alias("_new"),
        (F.col("http_status") if "http_status" in snapshot.columns else F.lit(200)).alias(
            "_status"
        ),
    )
    known = state.select("url_hash", "body_hash", "hit_count", "miss_count")
    joined = fetched.join(known, "url_hash", "left")
    seen = F.col("hit_count").isNotNull()
    same = (F.col("_status") == 304) | (
        (F.coalesce("body_hash", F.lit("")) != "") & (F.col("body_hash") == F.col("_new"))
    )
    outcome = F.when(~seen, "new").when(same, "not_modified").otherwise("changed")
    return joined.select(
        "url", "url_hash",
        F.when(seen & same, F.col("body_hash")).otherwise(F.col("_new")).alias("body_hash"),
        (F.coalesce("hit_count", F.lit(0)) + F.when(outcome == "not_modified", 1).otherwise(0))
        .alias("hit_count"),
        (F.coalesce("miss_count", F.lit(0)) + F.when(outcome == "changed", 1).otherwise(0))
        .alias("miss_count"),
        as_of.alias("last_fetched_at"), outcome.alias("outcome"),
    )


def clear_fetch_state(state: DataFrame, bad_urls: DataFrame) -> DataFrame:
    """Blank the validators of addresses whose run failed, so the next fetch is a full one."""
    bad = bad_urls.select(url_hash("url").alias("url_hash")).distinct().withColumn(
        "_bad", F.lit(True)
    )
    marked = state.join(bad, "url_hash", "left")
    blank = ["etag", "last_modified", "body_hash"]
    for name in [c for c in blank if c in state.columns]:
        marked = marked.withColumn(name, F.when(F.col("_bad"), "").otherwise(F.col(name)))
    return marked.drop("_bad")


def quarantine(runs: DataFrame, bodies: DataFrame, cap: int | None = None) -> DataFrame:
    """Bodies of runs nobody should trust, with their size. They are kept whole; with ``cap`` they
    are cut at so many bytes and flagged."""
    bad = runs.filter(F.col("verdict").isin("untrusted", "quarantined")).select(
        "run_id", "company_id", "verdict"
    )
    raw = F.encode("body", "utf-8")
    size = F.octet_length("body")
    kept = bodies.filter(F.col("body") != "").join(bad, "run_id")
    return kept.select(
        "run_id", "company_id", "url", "verdict",
        (raw if cap is None else F.substring(raw, 1, cap)).alias("content"),
        size.alias("byte_size"), (F.lit(False) if cap is None else size > cap).alias("truncated"),
    )


def write_quarantine(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("compression", "zstd").partitionBy("verdict").parquet(path)


def purge(df: DataFrame, as_of: Column, days: int = RETENTION_DAYS,
          column: str = "created_at") -> DataFrame:
    """Rows young enough to keep."""
    return df.filter(F.col(column) >= as_of - F.make_dt_interval(F.lit(days)))

"""Field-level differences between two versions of a table, as audit rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_map(df: DataFrame, columns: Sequence[str]) -> Column:
    pairs = [part for c in columns for part in (F.lit(c), F.col(c).cast("string"))]
    return F.create_map(*pairs)


def audit_diff(
    before: DataFrame, after: DataFrame, keys: Sequence[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows whose values differ (or that appear or vanish) with the sorted changed fields."""
    fields = [c for c in (columns or before.columns) if c not in keys]
    old = before.select(*keys, _as_map(before, fields).alias("before"))
    new = after.select(*keys, _as_map(after, fields).alias("after"))
    empty = F.create_map().cast("map<string,string>")
    both = old.join(new, list(keys), "full_outer").select(
        *keys, F.coalesce("before", empty).alias("before"), F.coalesce("after", empty).alias(
            "after")
    )
    moved = F.filter(
        F.array_sort(F.array(*[F.lit(f) for f in fields])),
        lambda f: ~F.try_element_at(F.col("before"), f).eqNullSafe(
            F.try_element_at(F.col("after"), f)
        ),
    )
    return both.withColumn("changed_fields", moved).filter(F.size("changed_fields") > 0)


def audit_rows(
    before: DataFrame, after: DataFrame, keys: Sequence[str], action: str, as_of: Column,
    actor: str = "", source: str = "SYSTEM", columns: Sequence[str] | None = None,
) -> DataFrame:
    """Audit log rows for every changed row."""
    return audit_diff(before, after, keys, columns).select(
        F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("object_id"),
        F.lit(action).alias("action"), F.lit(actor).alias("actor_label"),
        F.lit(source).alias("source"), "before", "after", "changed_fields",
        as_of.alias("created_at"),
    )


def append_audit(rows: DataFrame, path: str) -> None:
    """Append-only sink, one folder per day."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy(
        "day"
    ).parquet(path)

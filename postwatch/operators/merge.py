"""Keyed merge of a state table with a table of changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import any_of

HIT = "_hit"


def merge(
    state: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str],
    protect: str | None = None, insert_only: bool = False,
) -> DataFrame:
    """State after an upsert, with ``merge_outcome``: inserted, updated, unchanged, retained.

    ``protect`` names an array column of the state whose entries keep their stored value;
    ``insert_only`` never changes rows that exist. Keys must be unique on both sides.
    """
    old = state.withColumn("_old", F.lit(True))
    new = changes.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_new")
    )
    both = old.join(new, list(keys), "full_outer")
    present, incoming = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def open_to(name: str) -> Column:
        if protect is None:
            return F.lit(True)
        return ~F.coalesce(F.array_contains(protect, name), F.lit(False))

    moved = any_of([open_to(c) & ~F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in columns])
    writes = incoming & (~present | (moved if not insert_only else F.lit(False)))
    outcome = (
        F.when(~incoming, "retained").when(~present, "inserted").when(writes, "updated")
        .otherwise("unchanged")
    )
    values = [
        F.when(incoming & (~present | (open_to(c) & F.lit(not insert_only))),
               F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        if c in columns else F.col(c)
        for c in state.columns
    ]
    return both.select(*values, outcome.alias("merge_outcome"))


def with_hits(state: DataFrame, changes: DataFrame, key: str, *columns: str) -> DataFrame:
    """State with a flag for the keys that occur in ``changes`` and its columns as ``c_<name>``.
    The key must be unique in ``changes``."""
    marked = changes.select(
        key, F.lit(True).alias(HIT), *[F.col(c).alias(f"c_{c}") for c in columns]
    )
    return state.join(marked, key, "left").withColumn(HIT, F.coalesce(HIT, F.lit(False)))


def assign(df: DataFrame, when: Column, values: Mapping[str, Column], columns: Sequence[str]):
    """Set the given columns where ``when`` holds; columns the table does not carry are left
    out, helper columns are dropped."""
    result = [
        F.when(when, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in columns
    ]
    return df.select(*result)


def soft_delete(df: DataFrame, keys: DataFrame, key: str, as_of: Column) -> DataFrame:
    marked = with_hits(df, keys.select(key).distinct(), key)
    gone = F.col(HIT) & ~F.col("is_deleted")
    return assign(marked, gone, {"is_deleted": F.lit(True), "deleted_at": as_of}, df.columns)


def restore(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    marked = with_hits(df, keys.select(key).distinct(), key)
    back = {"is_deleted": F.lit(False), "deleted_at": F.lit(None).cast("timestamp_ntz")}
    return assign(marked, F.col(HIT), back, df.columns)


def hard_delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")

"""Ordered computations that stay parallel when one key holds a large share of the rows.

A plain window sorts all rows of a key in one task. The functions below cut every key into chunks
of time or number, work inside the chunks in parallel, and pass only one summary row per
(key, chunk) on to the other chunks. The results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written

CHUNK = "_chunk"


def time_chunk(ts: str, unit: str) -> Column:
    return F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")


def number_chunk(column: str, width: int = 65536) -> Column:
    return F.floor(F.col(column) / width)


def _earlier(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def _inside(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def _joined(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows are already partitioned by (key, chunk), so only the small carry table moves."""
    return rows.join(carry, [*keys, CHUNK], "left")


def with_neighbour(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
    chunk: Column, following: bool = False, whole: int | None = None,
) -> DataFrame:
    """Value of the row before (``lag``), or after (``lead``), per key in the given order.

    Keys of at most ``whole`` rows stay in one chunk, so that only the few larger ones (no more
    than rows / ``whole``, known to every task) have edges to pass on. Null keys are keys too.
    """
    rows = df.withColumn(CHUNK, chunk)
    if whole is not None:
        large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(
            F.col("_n") > whole).select(F.struct(*keys).alias("_key"))
        marked = rows.withColumn("_key", F.struct(*keys)).join(
            F.broadcast(large.withColumn("_large", F.lit(True))), "_key", "left").drop("_key")
        rows = marked.withColumn(CHUNK, F.when(F.col("_large"), F.col(CHUNK)).otherwise(-1))
    step, edge = (F.lead, F.min_by) if following else (F.lag, F.max_by)
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    passing = rows if whole is None else rows.filter("_large")
    edges = passing.groupBy(*keys, CHUNK).agg(
        edge(F.struct(value), F.struct(*order)).alias("_edge")
    )
    carry = edges.select(*keys, CHUNK, step("_edge").over(across).alias("_carried"))
    local = rows.withColumn("_local", step(F.struct(value)).over(_inside(keys, order)))
    if whole is None:
        met = _joined(local, carry, keys)
    else:  # one row per chunk of at most rows / whole keys
        at = F.struct(*keys, CHUNK)
        met = local.withColumn("_at", at).join(
            F.broadcast(carry.select(at.alias("_at"), "_carried")), "_at", "left"
        ).drop("_at", "_large")
    return met.withColumn(
        out, F.coalesce(F.col("_local"), F.col("_carried"))[value]
    ).drop("_local", "_carried", CHUNK)


def with_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
    chunk: Column, inclusive: bool = True,
) -> DataFrame:
    """Sum of ``value`` over the rows of the key up to (and with) the current one."""
    rows = df.withColumn(CHUNK, chunk).withColumn("_value", value)
    inside = _inside(keys, order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    totals = rows.groupBy(*keys, CHUNK).agg(F.sum("_value").alias("_total"))
    carry = totals.select(*keys, CHUNK, F.sum("_total").over(_earlier(keys)).alias("_carried"))
    local = rows.withColumn("_local", F.sum("_value").over(inside))
    zero = F.lit(0)
    return _joined(local, carry, keys).withColumn(
        out, F.coalesce(F.col("_local"), zero) + F.coalesce(F.col("_carried"), zero)
    ).drop("_local", "_carried", "_value", CHUNK)


def with_last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
    chunk: Column,
) -> DataFrame:
    """Newest non-null ``value`` among the earlier rows of the key (an as-of lookup)."""
    rows = df.withColumn(CHUNK, chunk).withColumn("_value", value)
    inside = _inside(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("_value").isNotNull(), F.struct(*order))
    tails = rows.groupBy(*keys, CHUNK).agg(F.max_by("_value", known).alias("_tail"))
    carry = tails.select(
        *keys, CHUNK, F.last("_tail", ignorenulls=True).over(_earlier(keys)).alias("_carried")
    )
    local = rows.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    return _joined(local, carry, keys).withColumn(
        out, F.coalesce("_local", "_carried")
    ).drop("_local", "_carried", "_value", CHUNK)


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], newest: bool = False
) -> DataFrame:
    """One whole row per key: the smallest by ``order`` (largest with ``newest``). An aggregate
    with a map-side part, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if newest else F.min_by
    row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows per key. Spark limits every map task to ``n`` rows per key before
    the shuffle, so a hot key stays small."""
    name = rank or "_rank"
    ranked = df.withColumn(
        name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def with_ordered_index(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Position of every row (from 0) in the total order of ``order`` columns.

    Range partitioning spreads even one dominant prefix; the sorted rows are written so that
    the partition numbers are the same in both uses; only one count per partition is summed up.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    laid = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid = written(
        laid.withColumn("_part", F.spark_partition_id())
        .withColumn("_nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    # one row per shuffle partition, so this side is bounded by that setting
    return laid.join(F.broadcast(starts), "_part").withColumn(
        out, F.col("_start") + F.col("_nth")
    ).drop("_part", "_nth", "_start")

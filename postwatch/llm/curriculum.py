"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1, linear between its points. The
integral of a schedule is the share the source asks for; shares are turned into targets in words,
no target above ``max_epochs`` times its source. A source's cumulative demand at time t is its goal
times the part of the integral up to t. Copies of documents queue within their source; the copy
that begins at word u of the queue is due when cumulative demand reaches u, which is the inverse of
the integral. Sorting all copies by that time interleaves the sources as scheduled.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, doc_key, fingerprint, stage

Schedule = Sequence[tuple[float, float]]

#: Schedules that sources repeat in code point order; they integrate to 5, 2 and 1.
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 7.0), (1.0, 3.0)),  # early material that fades
    ((0.0, 1.0), (0.5, 3.0), (1.0, 1.0)),  # strongest in the middle
    ((0.0, 0.5), (1.0, 1.5)),  # grows to the end
)
MAX_EPOCHS = 3
#: Pieces of a source's queue that are ordered on their own: hexadecimal digits of the key.
BUCKET_DIGITS = 3


def integral(schedule: Schedule) -> float:
    """Area under the schedule."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def segments(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """(area before, start, weight at start, slope) of every linear piece, area scaled to 1."""
    whole, area, out = integral(schedule), 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        out.append((area / whole, t0, w0 / whole, (w1 - w0) / (t1 - t0) / whole))
        area += (t1 - t0) * (w0 + w1) / 2
    return out


def due_time(u: Column, schedule: Schedule) -> Column:
    """Time at which the part ``u`` (0 to 1) of the schedule's area is reached."""
    out = None
    for area, start, weight, slope in segments(schedule):
        rest = F.greatest(u - area, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(weight * weight) + 2 * slope * rest, F.lit(0.0)))
        time = F.when(rest > 0, start + 2 * rest / (weight + root)).otherwise(start)
        out = time if out is None else F.when(u >= area, time).otherwise(out)
    return out


def source_targets(
    sizes: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """source, rank, source_size, target and goal (target in whole words) from (source, size).

    Sources are ranked by code point, null last, and repeat ``schedules``. Where a target would
    exceed ``max_epochs`` times its source, it stops there and the others share the rest by weight:
    sources are taken in the order in which they fill up, and the first that does not fill up at
    the level of those before it sets the level of all behind it, the highest of such levels. The windows run over one row per
    source.
    """
    weights = F.array(*(F.lit(float(integral(s))) for s in schedules))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source", "source_size",
        (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank"))
    ranked = totals.withColumn("weight", F.get(weights, F.col("rank") % len(schedules)))
    cap = F.col("source_size") * max_epochs
    by_fill = Window.orderBy("fill", "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    behind = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = (
        ranked.withColumns({"cap": cap, "fill": cap / F.col("weight")})
        .withColumn("level", (
            F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
        ) / F.sum("weight").over(behind))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(
            everything))
        .withColumn("target", F.least(
            F.col("cap").cast("double"), F.coalesce(F.col("level"), F.col("fill"))
            * F.col("weight")))
    )
    return filled.select("source", "rank", "source_size", "target",
                         F.round("target").cast("long").alias("goal"))


def mix(
    docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """doc_id, fp, size, source_size, target, taken and copies(epoch, position, words) per row.

    Size is the number of words (null text: 0). A source's queue is ordered by the MD5 of doc_id,
    then size, so that reruns agree; it is gone through as often as its goal needs, the last time
    up to the document that meets the goal. Documents are taken whole: that one is taken if at
    least half of it lies before the goal. ``taken`` is the sum over the copies, which come in order
    of epoch. Rows of equal doc_id and size are
    interchangeable; null sources are one source, null doc_ids one key; a source without words,
    and a mix of no words, has targets of 0 and no copies. Only doc_id, text and source are read.

    The text is read once, for its size. A source of any size is spread over the buckets of the
    key: running sums are taken within (source, bucket), over one row per bucket across buckets.
    """
    sized = stage(docs.select(
        "doc_id", "source", fingerprint("text", "source").alias("fp"),
        F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias(
            "size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key")), "mix-sizes")
    sized = sized.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(buckets.withColumnRenamed("words", "size"), schedules, max_epochs)
    earlier = Window.partitionBy("b_source").orderBy("b_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = buckets.select(
        F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "words").select(
        "b_source", "b_bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    plan = offsets.join(
        targets, F.col("b_source").eqNullSafe(F.col("source"))).drop("source")
    within = Window.partitionBy("source", "bucket").orderBy("key", "size", "fp").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(plan, F.col("source").eqNullSafe(F.col("b_source"))
              & (F.col("bucket") == F.col("b_bucket")))
        .withColumn("before", F.col("offset") + F.col("inside"))
        .withColumn("epochs", F.coalesce(F.expr("goal div nullif(source_size, 0)"), F.lit(0)))
        .withColumn("rest", F.coalesce(F.expr("goal % nullif(source_size, 0)"), F.lit(0)))
        .withColumn("last", F.when(2 * (F.col("rest") - F.col("before")) >= F.col("size"),
                                   F.col("size")).otherwise(F.lit(0).cast("long")))
    )

    def position(epoch: Column) -> Column:
        begin = epoch * F.col("source_size") + F.col("before")
        u = F.least(F.lit(1.0), begin / F.nullif(F.col("goal"), F.lit(0)))
        out = due_time(u, schedules[0])
        for at in range(1, len(schedules)):
            out = F.when(F.col("rank") % len(schedules) == at, due_time(u, schedules[at])
                         ).otherwise(out)
        return out

    copies = F.filter(F.transform(
        F.sequence(F.lit(0), F.lit(max_epochs)), lambda epoch: F.struct(
            epoch.alias("epoch"), position(epoch).alias("position"),
            F.when(epoch < F.col("epochs"), F.col("size"))
            .when(epoch == F.col("epochs"), F.col("last")).otherwise(0).alias("words"))),
        lambda copy: copy["words"] > 0)
    return placed.withColumn("copies", copies).select(
        "doc_id", "fp", "size", "source_size", "target",
        (F.least("epochs", F.lit(max_epochs)) * F.col("size") + F.col("last")).alias("taken"),
        "copies")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Rows range-sorted by the position of their first copy; rows without copies come first."""
    first = F.get("copies", F.lit(0))["position"]
    return mixed.withColumn("position", first).repartitionByRange("position", "doc_id"
                                                                  ).sortWithinPartitions(
        "position", "doc_id")


def training_stream(docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """The documents as they are trained on: one row per copy with all columns of ``docs``, range-
    sorted by position.

    A document that the mix does not take is left out; texts are whole. Nulls and empty tables: see
    ``mix``; columns of any name pass through.
    """
    copies = mix(docs, schedules).where(F.size("copies") > 0).groupBy(
        doc_key().alias("id"), "fp").agg(F.flatten(F.collect_list("copies")).alias("copies"))
    # rows that repeat (doc_id, text, source) share their copies: one of them carries all
    one = F.row_number().over(Window.partitionBy("id", "fp").orderBy("fp"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), doc_key().alias("id"),
                       fingerprint("text", "source").alias("fp"))
    return (
        rows.join(copies, ["id", "fp"]).withColumn("nth", one).where("nth = 1")
        .select("row", F.explode("copies").alias("copy"))
        .select("row", F.col("copy.position").alias("at"), F.col("row.doc_id").alias("id"))
        .repartitionByRange("at", "id").sortWithinPartitions("at", "id").select("row.*")
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)
         AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END
        AS weight, 3 * source_size AS cap FROM s),
f AS (SELECT *, cap / weight AS fill FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fill, rank
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(weight) OVER (ORDER BY fill, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        AS lev FROM f),
m AS (SELECT *, least(cap::DOUBLE, coalesce(
          max(CASE WHEN lev <= fill THEN lev END) OVER (), fill) * weight) AS target FROM l),
g AS (SELECT *, CAST(round(target) AS BIGINT) AS goal FROM m),
o AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, source_size, target, CAST(coalesce(goal // nullif(source_size, 0), 0) * size
       + CASE WHEN 2 * (coalesce(goal % nullif(source_size, 0), 0) - before) >= size THEN size
         ELSE 0 END AS BIGINT) AS taken
FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source
"""

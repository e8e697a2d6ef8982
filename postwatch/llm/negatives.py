"""Hard negatives by exact scores from subset-sum tables (the method of the Four Russians).

Entries become whole numbers in two's complement. Eight dimensions make a group: an anchor's group
gets a table of its 256 subset sums, a candidate's group one byte per bit plane. The byte picks the
sum of the anchor's entries whose candidate bit is set, so a plane's product is one lookup per group,
and planes are combined by shifts and adds, the sign plane with a minus: the full integer score.

Anchors meet candidates in units of bounded size (a block of either), each a task of its own that
returns the best few per anchor. Positives need candidates of the anchor's label only; negatives
then need the positives' scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .vectors import SCALE, extent, matrix, slices, usable, whole

#: Dimensions of a group, rows of a unit by side, and anchors whose tables are held at a time.
GROUP, CANDIDATES, ANCHORS, TABLES = 8, 4096, 2048, 64


def bit_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes: bit i of a byte is the plane's bit of the group's dimension i;
    the sign plane comes first."""
    shifts = np.arange(planes - 1, -1, -1, dtype=np.int64)
    bits = (values[:, None, :] >> shifts[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def from_planes(packed: np.ndarray) -> np.ndarray:
    """The whole numbers of bit planes, padded to full groups."""
    bits = np.unpackbits(packed, axis=2, bitorder="little").astype(np.int64)
    out = -bits[:, 0]
    for plane in range(1, bits.shape[1]):
        out = 2 * out + bits[:, plane]
    return out


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): sums of an anchor's entries over every subset of a group."""
    rows, width = anchors.shape
    grouped = anchors.astype(kind).reshape(rows, width // GROUP, GROUP)
    tables = np.zeros((width // GROUP, 1 << GROUP, rows), kind)
    for i in range(GROUP):  # subsets whose highest member is i
        tables[:, 1 << i:2 << i] = tables[:, :1 << i] + grouped[:, :, i].T[:, None, :]
    return tables


def scores(packed: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(candidates, anchors): exact products from bit planes and subset sums."""
    out = None
    for plane in range(packed.shape[1]):
        total = tables[0].take(packed[:, plane, 0], axis=0)
        for group in range(1, packed.shape[2]):
            total += tables[group].take(packed[:, plane, group], axis=0)
        if out is None:
            out = -total
        else:
            out += out
            out += total
    return out


def _unpacked(table: pa.Table, planes: int) -> np.ndarray:
    raw = b"".join(table.column("planes").to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(table.num_rows, planes, -1)


def _scored(candidates: pa.Table, anchors: pa.Table, planes: int, kind: type):
    """For TABLES anchors at a time: their places and the scores of the candidates."""
    packed, own = _unpacked(candidates, planes), from_planes(_unpacked(anchors, planes))
    for start in range(0, len(own), TABLES):
        block = slice(start, min(start + TABLES, len(own)))
        yield range(block.start, block.stop), scores(packed, subset_sums(own[block], kind))


def _by_id(table: pa.Table) -> pa.Table:
    """In ascending vec_id, so that the first of equal scores is the one that counts."""
    return table.take(pa.array(np.argsort(table.column("vec_id").to_numpy(), kind="stable")))


def _best(column: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest allowed scores, first places first among equals."""
    places = np.flatnonzero(allowed)
    if len(places) > k:
        own = column[places]
        edge = np.partition(own, len(own) - k)[len(own) - k]
        above = places[own > edge]
        places = np.r_[above, places[own == edge][:k - len(above)]]
    return places[np.lexsort((places, -column[places].astype(np.int64)))]


def _positives(key, anchors: pa.Table, candidates: pa.Table, k: int, planes: int, kind: type):
    """The best ``k`` candidates of this unit for every anchor of it; labels agree."""
    rows: list[tuple] = []
    if anchors.num_rows and candidates.num_rows:
        candidates = _by_id(candidates)
        ids, at = candidates.column("vec_id").to_numpy(), anchors.column("row").to_pylist()
        own = anchors.column("vec_id").to_numpy()
        for places, table in _scored(candidates, anchors, planes, kind):
            for column, a in zip(table.T, places, strict=True):
                rows += [(at[a], int(own[a]), int(ids[c]), int(column[c]))
                         for c in _best(column, ids != own[a], k)]
    return pa.table({name: pa.array([r[i] for r in rows], pa.int64())
                     for i, name in enumerate(("row", "anchor_id", "positive_id", "score"))})


def _negatives(key, anchors: pa.Table, candidates: pa.Table, k: int, low: int, high: int,
               planes: int, kind: type):
    """The best ``k`` candidates of other labels in range, for every positive of every anchor."""
    rows: list[tuple] = []
    if anchors.num_rows and candidates.num_rows:
        candidates = _by_id(candidates)
        ids, labels = (candidates.column(c).to_numpy() for c in ("vec_id", "label"))
        at, own, positives = (anchors.column(c).to_pylist() for c in ("row", "label", "positives"))
        for places, table in _scored(candidates, anchors, planes, kind):
            for column, a in zip(table.T, places, strict=True):
                other = labels != own[a]
                for positive in positives[a]:
                    floor = -((-low * positive["score"]) // 100)
                    edge = high * positive["score"] // 100
                    for c in _best(column, other & (column >= floor) & (column <= edge), k):
                        rows.append((at[a], positive["rank"], int(ids[c]), int(column[c])))
    return pa.table({name: pa.array([r[i] for r in rows], pa.int64())
                     for i, name in enumerate(("row", "place", "negative_id", "score"))})


def _coded(rows: DataFrame, width: int, planes: int) -> DataFrame:
    """(row, vec_id, label, planes) of usable rows, staged; ``row`` tells repeated rows apart."""
    full = -(-width // GROUP) * GROUP

    def code(batches):
        for batch in batches:
            for part in slices(batch, full * planes):
                packed = bit_planes(whole(matrix(part.column(2), full)), planes)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1),
                    pa.array([row.tobytes() for row in packed], pa.binary())],
                    ["vec_id", "label", "planes"])

    return stage(rows.select("vec_id", "label", "embedding").mapInArrow(
        code, "vec_id long, label long, planes binary").withColumn(
        "row", F.monotonically_increasing_id()), "negatives-rows")


def _parts(count: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / size)).cast("int")


def mine(
    embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by ``every``; an anchor's positives are its first
    ``positives`` other rows of its label by score, ties by smaller vec_id. For each anchor and
    positive come the first ``negatives`` rows of other labels whose score is from ``low`` to
    ``high`` percent of the positive's (fewer or none if there are no more). Scores are inner
    products of floor(256 * x), exact; ValueError if one could leave the range of a long.

    Rows with a null vec_id, label or vector, or with null or non-finite components, take no part;
    shorter vectors continue with zeros. Rows of one vec_id are never each other's candidates, but
    count one by one for others, and each of them is an anchor. An empty table gives no rows. Other
    columns are not looked at.
    """
    valid = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        "embedding").where(usable() & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    width, most = extent(valid)
    width = max(1, width)
    bound = int(SCALE * most) + 1
    planes, widest = bound.bit_length() + 1, 2 * width * bound * bound
    if widest >= 2 ** 63:
        raise ValueError("scores of these vectors do not fit a long")
    kind = np.int32 if widest < 2 ** 31 else np.int64
    rows = _coded(valid, width, planes)
    anchors = rows.where(F.col("vec_id") % every == 0).select(
        *(F.col(c).alias(c) for c in rows.columns))  # columns of its own: it meets ``rows`` again
    sizes = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("a")).select(
        "label", _parts(F.col("n"), CANDIDATES).alias("chunks"),
        _parts(F.col("a"), ANCHORS).alias("blocks"))

    def units(side: DataFrame, own: str, other: str, at: str, across: str) -> DataFrame:
        """Rows dealt to their part of ``own`` and repeated for every part of ``other``."""
        return side.withColumn(at, F.pmod(
            F.xxhash64("row"), F.col(own)).cast("int")).withColumn(
            across, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    sized = stage(sizes, "negatives-labels")
    asked = units(anchors.join(sized, "label"), "blocks", "chunks", "block", "chunk")
    offered = units(rows.join(sized, "label"), "chunks", "blocks", "chunk", "block")
    keys = ["label", "chunk", "block"]
    near = asked.select(*keys, "row", "vec_id", "planes").groupBy(*keys).cogroup(
        offered.select(*keys, "vec_id", "planes").groupBy(*keys)).applyInArrow(
        lambda key, a, c: _positives(key, a, c, positives, planes, kind),
        "row long, anchor_id long, positive_id long, score long")
    first = Window.partitionBy("row").orderBy(F.col("score").desc(), "positive_id")
    chosen = stage(near.withColumn("rank", F.row_number().over(first)).where(
        F.col("rank") <= positives), "negatives-positives")

    chunks = max(1, -(-rows.count() // CANDIDATES))
    blocks = max(1, -(-anchors.count() // ANCHORS))
    held = chosen.groupBy("row").agg(F.collect_list(F.struct(
        F.col("rank").cast("long").alias("rank"), "score")).alias("positives"))
    parts = {"chunks": F.lit(chunks), "blocks": F.lit(blocks)}
    asked = units(anchors.join(held, "row").withColumns(parts), "blocks", "chunks", "block", "chunk")
    offered = units(rows.withColumns(parts), "chunks", "blocks", "chunk", "block")
    keys = ["chunk", "block"]
    found = asked.select(*keys, "row", "label", "planes", "positives").groupBy(*keys).cogroup(
        offered.select(*keys, "vec_id", "label", "planes").groupBy(*keys)).applyInArrow(
        lambda key, a, c: _negatives(key, a, c, negatives, low, high, planes, kind),
        "row long, place long, negative_id long, score long")
    best = Window.partitionBy("row", "place").orderBy(F.col("score").desc(), "negative_id")
    ranked = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= negatives)
    return ranked.join(chosen.select(
        "row", F.col("rank").cast("long").alias("place"), "anchor_id", "positive_id",
        F.col("score").alias("positive_score")), ["row", "place"]).select(
        "anchor_id", "positive_id", F.col("n").alias("rank"), "negative_id", "positive_score",
        F.col("score").alias("negative_score"))


ORACLE_SQL = r"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS
             DOUBLE)) AS BIGINT)) AS v FROM (
    SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
    FROM embeddings)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_sum(
        list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
    ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
  ORDER BY s.score DESC, s.vec_id) <= 3
"""

"""Exact top-k inner-product search with a dual-tree over cover trees.

Vectors are dealt to cells by their nearest pivot and cells to blocks of bounded size; each block of
data and each block of queries gets a cover tree. Two nodes with centres c, d and covering radii r,
s hold no product above c.d + |c| s + |d| r + r s. A pair of nodes is pruned when that bound is
below the worst k-th score of the queries under the query node. Whole blocks are pruned the same
way before any vector is moved: a first search in the block next to each query sets the k-th scores.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SCALE = 256
#: Vectors from which pivots are chosen (by hash of vec_id), pivots, and rows of a block.
SAMPLE, PIVOTS, BLOCK, QUERY_BLOCK = 2048, 64, 4096, 512
#: Query blocks that meet a data block at once.
TOGETHER = 64
#: Points of a leaf; smaller children are bundled into one leaf of their parent.
LEAF, SMALL = 48, 12


@dataclass
class Node:
    """Points (places in the block), a centre and the radius that covers them."""

    points: np.ndarray
    center: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)

    @property
    def norm(self) -> float:
        return float(np.linalg.norm(self.center))


def cover_tree(vectors: np.ndarray, leaf: int = LEAF) -> Node:
    """Cover tree of float rows: children cover half the radius of their parent and their centres
    lie further apart than that; the root's centre is the mean."""
    def build(points: np.ndarray, center: np.ndarray) -> Node:
        away = np.linalg.norm(vectors[points] - center, axis=1)
        node = Node(points, center, float(away.max(initial=0.0)))
        if len(points) <= leaf or node.radius == 0:
            return node
        half, rest, single = node.radius / 2, points[np.argsort(away, kind="stable")], []
        while len(rest):
            own = vectors[rest[0]]
            near = np.linalg.norm(vectors[rest] - own, axis=1) <= half
            if near.sum() < SMALL:
                single.append(rest[near])
            elif near.all() and not node.children and not single:
                return node  # cannot be split by distance
            else:
                node.children.append(build(rest[near], own))
            rest = rest[~near]
        if single:
            bundle = np.concatenate(single)
            if not node.children:
                return node
            away = np.linalg.norm(vectors[bundle] - center, axis=1)
            node.children.append(Node(bundle, center, float(away.max(initial=0.0))))
        return node

    return build(np.arange(len(vectors)), vectors.mean(axis=0))


class Search:
    """Best ``k`` of the data of one block for the queries of one block."""

    def __init__(self, queries, query_ids, floor, data, data_ids, k: int):
        self.queries, self.query_ids = queries, query_ids
        self.data, self.data_ids, self.k = data, data_ids, k
        self.kth = floor.copy()  # known lower bounds of the k-th scores
        self.scores = [np.zeros(0, np.int64) for _ in query_ids]
        self.ids = [np.zeros(0, np.int64) for _ in query_ids]
        limit = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0))
        self.exact = limit * max(1, queries.shape[1]) < 2.0 ** 52  # float products are exact
        self.ints = None if self.exact else (queries.astype(np.int64), data.astype(np.int64))

    @staticmethod
    def bound(a: Node, b: Node) -> float:
        top = float(a.center @ b.center) + a.norm * b.radius + b.norm * a.radius + (
            a.radius * b.radius)
        return top + 1.0 + 1e-9 * abs(top)  # above any rounding

    def _compare(self, a: Node, b: Node) -> None:
        if self.exact:
            table = self.queries[a.points] @ self.data[b.points].T
        else:
            table = (self.ints[0][a.points] @ self.ints[1][b.points].T)
        for row, q in zip(table, a.points, strict=True):
            good = np.flatnonzero(row >= self.kth[q])
            if not len(good):
                continue
            ids, scores = self.data_ids[b.points[good]], row[good].astype(np.int64)
            other = ids != self.query_ids[q]
            scores = np.concatenate([self.scores[q], scores[other]])
            ids = np.concatenate([self.ids[q], ids[other]])
            best = np.lexsort((ids, -scores))[:self.k]
            self.scores[q], self.ids[q] = scores[best], ids[best]
            if len(best) == self.k:
                self.kth[q] = max(self.kth[q], scores[best[-1]])

    def visit(self, a: Node, b: Node) -> None:
        if self.bound(a, b) < self.kth[a.points].min():
            return
        if not a.children and not b.children:
            self._compare(a, b)
        elif not b.children or (a.children and a.radius > b.radius):
            for child in a.children:
                self.visit(child, b)
        else:
            for child in sorted(b.children, key=lambda c: -self.bound(a, c)):
                self.visit(a, child)


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(rows, -1)


def _pack_block(key, table):
    """One row per block: ids, components, and the centre and radius of its tree's root."""
    order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
    ids = table.column("vec_id").to_numpy()[order]
    vectors = np.stack([np.frombuffer(v.as_py(), "<f8") for v in table.column("vec")])[order]
    center = vectors.mean(axis=0)
    radius = float(np.linalg.norm(vectors - center, axis=1).max())
    return pa.table({
        "cell": pa.array([key[0].as_py()], pa.int32()),
        "chunk": pa.array([key[1].as_py()], pa.int32()),
        "ids": [ids.astype("<i8").tobytes()], "vectors": [vectors.tobytes()],
        "center": [center.tobytes()], "radius": [radius]})


_BLOCK = ("cell int, chunk int, ids binary, vectors binary, center binary, radius double")


def _quantised(batches, width: int, pivots: np.ndarray):
    for batch in batches:
        ids, cells, raws = [], [], []
        for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                  strict=True):
            values = np.array(vector, np.float64)
            out = np.zeros(width)
            out[:len(values)] = np.floor(SCALE * values)
            ids.append(vec_id)
            cells.append(int(np.argmin(((pivots - out) ** 2).sum(axis=1))))
            raws.append(out.astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(cells, pa.int32()), pa.array(raws, pa.binary())],
            ["vec_id", "cell", "vec"])


def _pivots(vectors: np.ndarray) -> np.ndarray:
    """Farthest-first choice from the sample."""
    chosen, away = [0], np.full(len(vectors), np.inf)
    while len(chosen) < min(PIVOTS, len(vectors)):
        away = np.minimum(away, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
        if not away.max():
            break
        chosen.append(int(away.argmax()))
    return vectors[chosen]


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows dealt to blocks of about ``size``: cells in chunks by hash."""
    counts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("chunks"))
    return stage(rows.join(counts, "cell").withColumn("chunk", F.pmod(
        F.xxhash64("vec_id"), F.col("chunks")).cast("int")).groupBy("cell", "chunk").applyInArrow(
        _pack_block, _BLOCK), name)


def _search_rows(batches, k: int, width: int):
    """Rows of a data block with its query blocks: the best of each query in that block."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, raw, asked = (batch.column(c)[i].as_py() for c in range(3))
            ids = np.frombuffer(ids, "<i8")
            data = _matrix(raw, len(ids))
            tree = cover_tree(data)
            out = ([], [], [], [])
            for block in asked:
                own = np.frombuffer(block["ids"], "<i8")
                queries = _matrix(block["vectors"], len(own))
                floor = np.frombuffer(block["floor"], "<f8") if block["floor"] else np.full(
                    len(own), -np.inf)
                search = Search(queries, own, floor, data, ids, k)
                search.visit(cover_tree(queries, leaf=16), tree)
                for q, query in enumerate(own):
                    out[0].append(np.full(len(search.ids[q]), query))
                    out[1].append(search.ids[q])
                    out[2].append(search.scores[q])
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c), pa.int64()) for c in out[:3]],
                    ["query_id", "vec_id", "score"])


def _near_pairs(batches):
    """Pairs of blocks whose bound reaches the worst k-th score of the query block."""
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
            a, b = (np.frombuffer(row[c], "<f8") for c in ("q_center", "d_center"))
            floor = row["floor"]
            keep.append(floor is None or Search.bound(
                Node(np.zeros(0), a, row["q_radius"]), Node(np.zeros(0), b, row["d_radius"])
            ) >= np.frombuffer(floor, "<f8").min())
        names = ["q_cell", "q_chunk", "d_cell", "d_chunk"]
        yield batch.filter(pa.array(keep, pa.bool_())).select(names)


def _floors(key, table):
    """The k-th scores of a query block, in order of its ids, -inf where fewer were found."""
    ids = np.frombuffer(table.column("ids")[0].as_py(), "<i8")
    kth = {q: s for q, s in zip(table.column("query_id").to_pylist(),
                                table.column("kth").to_pylist(), strict=True) if q is not None}
    floor = np.array([kth.get(int(q), -np.inf) for q in ids], "<f8")
    return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()),
                     "chunk": pa.array([key[1].as_py()], pa.int32()),
                     "floor": pa.array([floor.tobytes()], pa.binary())})


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of every row whose vec_id is
    divisible by ``every``, ties to the smaller vec_id.

    Components become floor(256 * x); the score is their inner product. Vectors that are null or
    hold null or non-finite components, and rows without vec_id, take no part; shorter vectors
    count as zero behind their end; of rows that repeat a vec_id the smallest vector counts. Fewer
    candidates than ``k`` give all; an empty table gives no rows. Other columns are not looked at.

    The pivots come from a bounded sample; they only shape the blocks. All rows are indexed and the
    search is exact. A cell of any size is cut into blocks, so equal vectors are spread.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.where(
        "vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite).groupBy(
        F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).agg(
        F.collect_list("embedding")).first()[0]  # SAMPLE vectors at most
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    points = np.zeros((max(1, len(sample)), width))
    for at, vector in enumerate(sample):
        points[at, :len(vector)] = np.floor(SCALE * np.array(vector, np.float64))
    pivots = _pivots(points)
    coded = stage(rows.mapInArrow(
        lambda batches: _quantised(batches, width, pivots),
        "vec_id long, cell int, vec binary"), "search-rows")
    data = _blocks(coded, BLOCK, "search-data")
    queries = _blocks(coded.where(F.col("vec_id") % every == 0), QUERY_BLOCK, "search-queries")
    found = "query_id long, vec_id long, score long"

    def search(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """Search the given (q_cell, q_chunk, d_cell, d_chunk) pairs of blocks."""
        q = asked.select(F.col("cell").alias("q_cell"), F.col("chunk").alias("q_chunk"), F.struct(
            "ids", "vectors", "floor").alias("asked"))
        met = pairs.join(q, ["q_cell", "q_chunk"]).groupBy(
            F.col("d_cell").alias("cell"), F.col("d_chunk").alias("chunk"),
            F.pmod(F.xxhash64("q_cell", "q_chunk"), F.lit(groups)).alias("group")).agg(
            F.collect_list("asked").alias("asked"))  # about TOGETHER query blocks
        return met.join(data.select("cell", "chunk", "ids", "vectors"), ["cell", "chunk"]).select(
            "ids", "vectors", "asked").mapInArrow(
            lambda batches: _search_rows(batches, k, width), found)

    groups = max(1, -(-queries.count() // TOGETHER))
    none = queries.withColumn("floor", F.lit(None).cast("binary"))
    own = queries.select(F.col("cell").alias("q_cell"), F.col("chunk").alias("q_chunk"),
                         F.col("cell").alias("d_cell"), F.lit(0).alias("d_chunk"))
    kth = search(own, none).groupBy("query_id").agg(
        F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    homes = coded.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"),
                                                             "cell")
    placed = kth.join(homes, "query_id").join(_chunk_counts(coded, every), "cell").withColumn(
        "chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
    floors = queries.select("cell", "chunk", "ids").join(
        placed.select("cell", "chunk", "query_id", "kth"), ["cell", "chunk"], "left").groupBy(
        "cell", "chunk").applyInArrow(_floors, "cell int, chunk int, floor binary")
    asked = stage(queries.join(floors, ["cell", "chunk"]), "search-floors")
    shards = F.pmod(F.xxhash64("cell", "chunk"), F.lit(groups))
    q_meta = asked.select(
        F.col("cell").alias("q_cell"), F.col("chunk").alias("q_chunk"),
        F.col("center").alias("q_center"), F.col("radius").alias("q_radius"), "floor",
        shards.alias("shard"))
    d_meta = data.select(
        F.col("cell").alias("d_cell"), F.col("chunk").alias("d_chunk"),
        F.col("center").alias("d_center"), F.col("radius").alias("d_radius"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("shard"))
    pairs = q_meta.join(d_meta, "shard").drop("shard").mapInArrow(
        _near_pairs, "q_cell int, q_chunk int, d_cell int, d_chunk int")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return search(pairs, asked).withColumn("rank", F.row_number().over(best)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _chunk_counts(coded: DataFrame, every: int) -> DataFrame:
    return coded.where(F.col("vec_id") % every == 0).groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("chunks"))


ORACLE_SQL = r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE))
             AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding,
             lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(
        list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

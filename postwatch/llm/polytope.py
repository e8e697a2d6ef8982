"""Near duplicates among embeddings by cross-polytope hashing with multiprobe buckets.

A vector is turned by a pseudo-random rotation (three rounds of random signs and a fast Hadamard
transform); its hash is the nearest of the 2D signed axes. Codes of a few rotations make a bucket,
several independent tables make up for near vectors that fall apart, and every vector also visits
the buckets that it missed by least. A pair is a candidate where one of the two has its own bucket
and the other owns or visits it; candidates are verified by their cosine.

Equal vectors are one vector from the start. Buckets are worked on in tiles of bounded size, of
which a large bucket has many; a tile gives numbers of links and the edges of a spanning forest,
so that no row is made for a pair. A pair that meets in several buckets counts in one of them, the
one of the smallest key.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forest, stage
from .jaccard import components
from .vectors import extent, matrix, slices, usable

#: Buckets visited beside a vector's own, next axes of a rotation that probes are built from.
PROBES, NEXT = 4, 3
#: Share of pairs exactly at the threshold that may be missed by all tables together.
MISS = 1e-5
#: Random pairs by which a table's share is measured.
TRIALS = 2000
#: Vectors of one side of a tile; tiles of so few rows are compared together.
TILE, SMALL = 1024, 16
#: Cosines this near to the threshold are worked out again from the vectors themselves.
BORDER = 1e-9


@dataclass(frozen=True)
class Hashing:
    """Random signs (tables, rotations, 3, D) of a family of hash tables."""

    signs: np.ndarray
    probes: int

    @staticmethod
    def draw(width: int, tables: int, rotations: int, probes: int = PROBES, seed: int = 7):
        size = 1 << max(1, (width - 1).bit_length())
        signs = np.random.default_rng(seed).integers(0, 2, (tables, rotations, 3, size)) * 2.0 - 1
        return Hashing(signs, probes)

    @property
    def posted(self) -> int:
        """Buckets of one vector in one table; the first is its own."""
        return 1 + self.probes

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, tables, posted) bucket codes of unit rows, without the table in them."""
        tables, rotations, _, size = self.signs.shape
        padded = np.zeros((len(vectors), size))
        padded[:, :vectors.shape[1]] = vectors
        out = np.empty((len(vectors), tables, self.posted), np.uint64)
        for t in range(tables):
            best, gaps = [], []
            for r in range(rotations):
                turned = padded
                for signs in self.signs[t, r]:
                    turned = hadamard(turned * signs)
                top = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :NEXT + 1]
                value = np.take_along_axis(turned, top, axis=1)
                best.append(2 * top + (value < 0))
                gaps.append(np.abs(value[:, :1]) - np.abs(value))
            choices = np.indices((best[0].shape[1],) * rotations).reshape(rotations, -1)
            cost = sum(g[:, c] ** 2 for g, c in zip(gaps, choices, strict=True))
            cost[:, 0] = -1  # the own bucket comes first
            order = np.argsort(cost, axis=1, kind="stable")[:, :self.posted]
            code = np.zeros(order.shape, np.uint64)
            for b, c in zip(best, choices, strict=True):
                code = code * np.uint64(2 * size) + np.take_along_axis(
                    b, c[order], axis=1).astype(np.uint64)
            out[:, t, :code.shape[1]] = code
            out[:, t, code.shape[1]:] = code[:, :1]  # fewer buckets than probes
        return out


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, scaled to keep lengths."""
    n, size = rows.shape
    out, half = rows, 1
    while half < size:
        pairs = out.reshape(n, size // (2 * half), 2, half)
        out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]],
                             axis=2).reshape(n, size)
        half *= 2
    return out / math.sqrt(size)


def plan_tables(width: int, rows: int, threshold: float) -> Hashing:
    """Rotations so that random vectors of ``rows`` spread over as many buckets, and tables so that
    a pair exactly at the threshold is missed with probability MISS, measured on random pairs."""
    size = 1 << max(1, (width - 1).bit_length())
    rotations = max(1, math.ceil(math.log(max(2, rows)) / math.log(2 * size)))
    if width < 2:
        return Hashing.draw(width, 1, 1)
    draw, trial = np.random.default_rng(11), 8
    a = unit(draw.standard_normal((TRIALS, width)))
    b = draw.standard_normal((TRIALS, width))
    b = unit(b - a * (a * b).sum(axis=1, keepdims=True))
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold ** 2)) * b
    family = Hashing.draw(width, trial, rotations)
    one, two = family.codes(a), family.codes(b)
    met = (one[:, :, :1] == two).any(axis=2) | (two[:, :, :1] == one).any(axis=2)
    share = min(1 - 1e-6, max(float(met.mean()), 1 / TRIALS))
    return Hashing.draw(width, max(1, math.ceil(math.log(MISS) / math.log(1 - share))), rotations)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, safe for any finite size; zero rows stay zero."""
    most = np.abs(rows).max(axis=1, keepdims=True, initial=0)
    scaled = rows / np.where(most > 0, most, 1)
    length = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return scaled / np.where(length > 0, length, 1)


def _mixed(values: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers (the splitmix64 finaliser)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def bucket_keys(hashing: Hashing, vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """(rows, tables * posted) keys of label, table and code, own buckets first in each table."""
    codes = hashing.codes(vectors)
    table = _mixed(np.arange(1, codes.shape[1] + 1, dtype=np.uint64))[None, :, None]
    own = _mixed(labels.astype(np.int64).view(np.uint64) + np.uint64(1))[:, None, None]
    return _mixed(_mixed(codes + table) ^ own).reshape(len(codes), -1).view(np.int64)


def _read(batch: pa.RecordBatch, column: str, kind: str, rows: int) -> np.ndarray:
    raw = b"".join(batch.column(batch.schema.get_field_index(column)).to_pylist())
    return np.frombuffer(raw, kind).reshape(rows, -1)


def _above(cosine: np.ndarray, units: np.ndarray, a: np.ndarray, b: np.ndarray,
           threshold: float) -> np.ndarray:
    """Whether each cosine reaches the threshold; those at the border are worked out exactly."""
    keep = cosine >= threshold
    for at in np.flatnonzero(np.abs(cosine - threshold) <= BORDER):
        x, y = units[a[at]], units[b[at]]
        keep[at] = math.fsum(x * y) >= threshold * math.sqrt(math.fsum(x * x) * math.fsum(y * y))
    return keep


def _near(vectors: np.ndarray, one: np.ndarray, two: np.ndarray, threshold: float):
    """(i, j) of pairs between the places ``one`` and ``two`` (i < j where they are the same) with
    enough cosine."""
    left, right = unit(vectors[one]), unit(vectors[two])
    cosine = left @ right.T
    a, b = np.nonzero(cosine >= threshold - BORDER)
    if one is two:
        a, b = a[a < b], b[a < b]
    keep = _above(cosine[a, b], np.concatenate([left, right]), a, b + len(one), threshold)
    return one[a[keep]], two[b[keep]]


def _first_key(a: np.ndarray, b: np.ndarray, posted: int) -> np.ndarray:
    """The smallest key in which the rows of ``a`` and ``b`` (rows, tables * posted) meet."""
    one, two = (x.reshape(len(x), x.shape[1] // posted, posted) for x in (a, b))
    none = np.iinfo(np.int64).max
    least = np.full(len(a), none)
    for own, other in ((one, two), (two, one)):
        hit = (own[:, :, :1] == other).any(axis=2)
        least = np.minimum(least, np.where(hit, own[:, :, 0], none).min(axis=1, initial=none))
    return least


def _pairs(tile: np.ndarray, chunk: np.ndarray, vectors: np.ndarray, threshold: float):
    """Places (i, j) of all near pairs within tiles; rows of a tile follow each other. Pairs of one
    chunk belong to the tile of that chunk alone."""
    begin = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]).any(axis=1)])
    size = np.diff(np.r_[begin, len(tile)])
    number = np.repeat(np.arange(len(begin)), size)
    inner = tile[:, 1] == tile[:, 2]
    found = []
    for at in np.flatnonzero(size > SMALL):
        places = np.arange(begin[at], begin[at] + size[at])
        one = places[chunk[places] == tile[begin[at], 1]]
        two = one if inner[begin[at]] else places[chunk[places] == tile[begin[at], 2]]
        found.append(_near(vectors, one, two, threshold))
    few = np.flatnonzero((size <= SMALL)[number])
    units = unit(vectors[few])
    for shift in range(1, SMALL):  # tiles of few rows, all at once
        a = np.arange(max(0, len(few) - shift))
        a = a[(number[few[a]] == number[few[a + shift]]) & (
            inner[few[a]] | (chunk[few[a]] != chunk[few[a + shift]]))]
        if not len(a):
            break
        cosine = np.einsum("ij,ij->i", units[a], units[a + shift])
        keep = _above(cosine, units, a, a + shift, threshold)
        found.append((few[a[keep]], few[a[keep] + shift]))
    return [np.concatenate([f[i] for f in found]) if found else np.zeros(0, int) for i in (0, 1)]


def _verify(batches, threshold: float, posted: int, kind: str):
    """Links of the tiles (key, one, two) that follow each other in sorted rows: (id, links) for
    every linked vector, and (id, other) for the edges of a forest."""
    def close(tile, chunk, ids, labels, copies, keys, raw) -> pa.RecordBatch:
        a, b = _pairs(tile, chunk, raw.astype(np.float64), threshold)
        mine = (labels[a] == labels[b]) & (_first_key(keys[a], keys[b], posted) == tile[a, 0])
        a, b = a[mine], b[mine]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        some, edges = np.flatnonzero(links), forest(len(ids), a, b)
        return pa.RecordBatch.from_pydict({
            "id": pa.array(np.r_[ids[some], ids[edges[:, 0]]], pa.int64()),
            "links": pa.array(links[some].tolist() + [None] * len(edges), pa.int64()),
            "other": pa.array([None] * len(some) + ids[edges[:, 1]].tolist(), pa.int64())})

    held = None
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        columns = [np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)]
        columns += [batch.column(batch.schema.get_field_index(n)).to_numpy()
                    for n in ("chunk", "id", "label", "copies")]
        columns += [_read(batch, "keys", "<i8", rows), _read(batch, "raw", kind, rows)]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        tile = columns[0]
        last = int(np.flatnonzero((tile != tile[-1]).any(axis=1)).max(initial=-1)) + 1
        held = [c[last:] for c in columns]  # the tile that may go on
        if last:
            yield close(*(c[:last] for c in columns))
    if held is not None:
        yield close(*held)


def _distinct(valid: DataFrame, width: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """Rows as (vec_id, label, digest), null where a vector is zero, and vectors, each once by
    label, as (id, label, digest, low, copies, raw)."""
    def code(batches):
        for batch in batches:
            for part in slices(batch, width):
                own = matrix(part.column(2), width).astype(kind) + np.array(0, kind)  # no -0.0
                raws = [row.tobytes() if row.any() else None for row in own]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1),
                    pa.array([raw and hashlib.blake2b(raw, digest_size=16).digest() for raw in raws],
                             pa.binary()),
                    pa.array(raws, pa.binary())], ["vec_id", "label", "digest", "raw"])

    ids, labels = (valid.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    rows = stage(valid.mapInArrow(
        code, f"vec_id {ids}, label {labels}, digest binary, raw binary"), "polytope-rows")
    sets = rows.where("digest IS NOT NULL").groupBy("label", "digest").agg(
        F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"),
        F.min("raw").alias("raw")).withColumn("id", F.monotonically_increasing_id())
    return rows.drop("raw"), stage(sets, "polytope-sets")


def _found(sets: DataFrame, hashing: Hashing, width: int, kind: str, threshold: float) -> DataFrame:
    """Numbers of links and forest edges of all tiles, as (id, links, other)."""
    posted = hashing.posted

    def post(batches):
        for batch in batches:
            for part in slices(batch, hashing.signs.shape[3] * hashing.posted):
                vectors = unit(_read(part, "raw", kind, part.num_rows).astype(np.float64))
                keys = bucket_keys(hashing, vectors, part.column(1).to_numpy())
                tables = keys.reshape(len(keys), -1, posted)
                again = (tables == tables[:, :, :1]) & (np.arange(posted) > 0)
                yield pa.RecordBatch.from_arrays([
                    *(part.column(i) for i in range(4)),
                    pa.array([row.tobytes() for row in keys], pa.binary()),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()),
                        pa.array(keys.reshape(-1), mask=again.reshape(-1)))],
                    ["id", "label", "copies", "raw", "keys", "all"])

    keyed = stage(sets.select("id", F.col("label").cast("long").alias("label"), "copies", "raw")
                  .mapInArrow(post, "id long, label long, copies long, raw binary, keys binary, "
                                    "all array<long>"), "polytope-keys")
    postings = keyed.select("id", F.posexplode("all").alias("at", "key")).select(
        "id", "key", (F.col("at") % posted == 0).alias("home")).where("key IS NOT NULL")
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    buckets = postings.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes")).where(
        "n > 1 AND homes > 0").select("key", chunks.alias("chunks"))
    met = stage(postings.select("id", "key").join(buckets, "key"), "polytope-met")
    tiles = met.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn(
        "with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "key", F.least("chunk", "with").alias("one"), F.greatest("chunk", "with").alias("two"),
        "chunk", "id")
    return tiles.join(keyed.drop("all"), "id").select(
        "key", "one", "two", "chunk", "id", "label", "copies", "keys", "raw").repartition(
        "key", "one", "two").sortWithinPartitions("key", "one", "two").mapInArrow(
        lambda batches: _verify(batches, threshold, posted, kind),
        "id long, links long, other long")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: rows of one label link when their cosine,
    in double precision, is at least ``threshold``.

    ``n_links`` counts other rows linked directly (equal vectors and repeated rows are linked),
    ``component_id`` is the smallest vec_id reachable by links, itself included, and ``kept`` says
    whether that is the row's own. Rows with a null label, and vectors that are null, zero or hold
    null or non-finite components, link with nothing; shorter vectors continue with zeros; a null
    vec_id counts as larger than any. An empty table gives no rows. Other columns are not looked at.

    No link below the threshold is returned. A pair at the threshold is missed with probability
    MISS (vectors in random position); nearer pairs far less often, equal directions never.
    """
    takes_part = usable() & F.col("label").isNotNull()
    table = embeddings.select("vec_id", "label", "embedding")
    valid = table.where(takes_part)
    width, _ = extent(valid)
    kind = "<f4" if table.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    alone = table.where(~takes_part).select("vec_id")
    if width:
        rows, sets = _distinct(valid, width, kind)
        most = sets.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        found = stage(_found(sets, plan_tables(width, most, threshold), width, kind, threshold),
                      "polytope-found")
        partners = found.where("links IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links"))
        grouped = components(found.where("other IS NOT NULL").select(
            F.col("id").alias("a"), F.col("other").alias("b")), "polytope-labels")
        joined = stage(sets.select("id", "label", "digest", "low", "copies").join(
            grouped, "id", "left").join(partners, "id", "left"), "polytope-joined")
        lowest = joined.where("component IS NOT NULL").groupBy("component").agg(
            F.min("low").alias("lowest"))
        named = joined.join(lowest, "component", "left").select(
            "label", "digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("lowest")).alias(
                "component_id"))
        linked = rows.where("digest IS NOT NULL").join(named, ["label", "digest"]).select(
            "vec_id", "n_links", "component_id")
        alone = alone.union(rows.where("digest IS NULL").select("vec_id"))
    else:
        alone, linked = table.select("vec_id"), None
    out = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                       F.col("vec_id").alias("component_id"))
    out = out.union(linked) if linked is not None else out
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM e),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND a.size > 0 AND b.size > 0
  AND list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) >= 0.98 * a.size * b.size),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(low.low, e.vec_id)) AS
  component_id, e.vec_id = least(e.vec_id, coalesce(low.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

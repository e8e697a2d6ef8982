"""Whitening of embeddings by their leading components, found by a Jacobi-Davidson iteration.

The covariance V of the fit list (each distinct vector once, as whole numbers) is never built: every
product with V is one Spark job over packed blocks of the fit list, ``X.T @ (X @ block)`` of centred
rows, summed by dimension. A search space of a few vectors grows by corrections t of the leading
Ritz pairs (theta, u) with residuals r, from (I - QQ')(V - theta I)(I - QQ') t = -r, where Q holds
the locked and the current Ritz vectors. Inner MINRES solves these roughly; the corrections of a
round advance together, so that one job multiplies a block and not a vector. Pairs whose residual
has reached double precision are locked, in order, and the space is kept orthogonal to them.

What reaches the driver are sums by dimension and blocks of a few vectors of that length, however
many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .vectors import SCALE, extent, matrix, slices, usable, whole

#: Bytes of a packed block of the fit list.
BLOCK_BYTES = 1 << 20
#: Ritz pairs corrected beyond those wanted, vectors of the search space, and steps of MINRES.
GUARD, SPACE, INNER = 4, 56, 4
#: Residual, in units of the largest eigenvalue, at which a pair is locked.
CONVERGED = 2.0 ** -46
#: The same when rounding of the sums keeps residuals from falling further, and rounds without gain.
NOISE, PATIENCE = 2.0 ** -34, 4
ROUNDS = 300


@dataclass
class Whitening:
    """Components as columns of ``vectors``, by falling eigenvalue, and what they were fitted on."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    identity_error: float
    products: int


def minres(b: np.ndarray, steps: int, shrink: float) -> Generator[np.ndarray, np.ndarray]:
    """MINRES for a symmetric operator that the caller applies: yields vectors, is sent their
    images, returns the solution once the residual has shrunk so far or the steps are used up."""
    x, beta = np.zeros_like(b), 0.0
    size = float(np.linalg.norm(b))
    if not size:
        return x
    before, v, left = np.zeros_like(b), b / size, size
    w_before, w = np.zeros_like(b), np.zeros_like(b)
    c_before, c, s_before, s = 1.0, 1.0, 0.0, 0.0
    for _ in range(steps):
        image = yield v
        alpha = float(v @ image)
        image = image - alpha * v - beta * before
        after = float(np.linalg.norm(image))
        delta = c * alpha - c_before * s * beta
        rho = float(np.hypot(delta, after))
        if not rho:
            break
        w_before, w = w, (v - s_before * beta * w_before - (
            s * alpha + c_before * c * beta) * w) / rho
        c_before, s_before = c, s
        c, s = delta / rho, after / rho
        x = x + c * left * w
        left = -s * left
        if abs(left) <= shrink * size or after <= 1e-14 * abs(alpha):
            break
        before, v, beta = v, image / after, after
    return x


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal columns for the part of ``block`` outside the columns of ``against``."""
    done: list[np.ndarray] = []
    for column in block.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        column = column / size
        for _ in range(3):
            for other in against:
                column = column - other @ (other.T @ column)
            for other in done:
                column = column - other * (other @ column)
        size = np.linalg.norm(column)
        if size > 1e-8:
            column = column / size
            for other in (*against, *([np.stack(done, axis=1)] if done else [])):
                column = column - other @ (other.T @ column)
            done.append(column / np.linalg.norm(column))
    return np.stack(done, axis=1) if done else np.zeros((len(block), 0))


def _corrections(
    apply: Callable, vectors: np.ndarray, residuals: np.ndarray, shifts: np.ndarray,
    against: np.ndarray, shrink: float
) -> np.ndarray:
    """Rough solutions of the projected correction equations, all advanced by the same products."""
    def project(block):
        return block - against @ (against.T @ block)

    running, out = {}, np.zeros_like(vectors)
    for j in range(vectors.shape[1]):
        solver = minres(-project(residuals[:, j]), INNER, shrink)
        try:
            running[j] = (solver, next(solver))
        except StopIteration as end:
            out[:, j] = end.value
    while running:
        order = sorted(running)
        block = project(np.stack([running[j][1] for j in order], axis=1))
        images = project(apply(block) - block * shifts[order])
        for at, j in enumerate(order):
            try:
                running[j] = (running[j][0], running[j][0].send(images[:, at]))
            except StopIteration as end:
                out[:, j] = end.value
                del running[j]
    return out


def jacobi_davidson(
    apply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, start: np.ndarray
) -> tuple[np.ndarray, np.ndarray, float]:
    """Largest eigenvalues, falling, their unit vectors as columns, and the largest residual in
    units of the largest eigenvalue. ``apply`` multiplies a block of columns."""
    wanted, draw = min(wanted, width), np.random.default_rng(1)
    locked = np.zeros((width, 0))
    space = _orthonormal(np.concatenate(
        [start, draw.standard_normal((width, wanted + GUARD))], axis=1))[:, :wanted + GUARD]
    images, best, waited, top = apply(space), np.inf, 0, 0.0
    for _ in range(ROUNDS):
        small = space.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        space, images = space @ turn, images @ turn
        top = max(top, float(values[0]) if len(values) else 0.0, np.finfo(float).tiny)
        block = min(wanted - locked.shape[1] + GUARD, space.shape[1])
        residuals = images[:, :block] - space[:, :block] * values[:block]
        sizes = np.linalg.norm(residuals, axis=0) / top
        complete = locked.shape[1] + space.shape[1] >= width
        waited, best = (0, sizes[0]) if sizes[0] < best / 2 else (waited + 1, best)
        limit = NOISE if complete or waited >= PATIENCE else CONVERGED
        ready = 0
        while ready < min(block, wanted - locked.shape[1]) and sizes[ready] <= limit:
            ready += 1
        if ready:
            locked = np.concatenate([locked, space[:, :ready]], axis=1)
            space, images, best, waited = space[:, ready:], images[:, ready:], np.inf, 0
            if locked.shape[1] == wanted:
                break
            values, residuals, block = values[ready:], residuals[:, ready:], block - ready
            sizes = sizes[ready:]
        if space.shape[1] + block > SPACE:
            space, images = (x[:, :wanted + 2 * GUARD] for x in (space, images))
        held = np.concatenate([locked, space[:, :block]], axis=1)
        grown = _corrections(apply, space[:, :block], residuals, values[:block], held,
                             min(0.1, max(1e-3, float(sizes.max(initial=0)) ** 0.5)))
        grown = _orthonormal(grown, locked, space)
        if not grown.shape[1] and not complete:
            grown = _orthonormal(draw.standard_normal((width, 1)), locked, space)
        if grown.shape[1]:
            space = np.concatenate([space, grown], axis=1)
            images = np.concatenate([images, apply(grown)], axis=1)
        elif complete:
            images = apply(space)
    else:
        raise ArithmeticError("the residuals did not reach double precision")
    images = apply(locked)
    small = locked.T @ images
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = locked @ turn
    residual = np.linalg.norm(images @ turn - vectors * values, axis=0).max(initial=0) / top
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return np.maximum(values, 0.0), vectors * signs, float(residual)


def _kind(most: float) -> str:
    """The smallest integer type that holds every entry."""
    edge = SCALE * most + 1
    return "<i2" if edge < 2 ** 15 else "<i4" if edge < 2 ** 31 else "<i8"


def _fit_blocks(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """Each distinct whole-number vector once, packed into blocks of about BLOCK_BYTES."""
    def code(batches):
        for batch in batches:
            for part in slices(batch, width):
                own = whole(matrix(part.column(0), width)).astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.tobytes() for row in own], pa.binary())], ["x"])

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.append(raw)
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b"".join(held)], pa.binary())], ["block"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["block"])

    return stage(rows.select("embedding").mapInArrow(code, "x binary").distinct().mapInArrow(
        pack, "block binary"), "whitening-fit")


class FitList:
    """Sums over the packed fit list, each by one Spark job."""

    def __init__(self, blocks: DataFrame, width: int, kind: str):
        self.blocks, self.width, self.kind, self.products = blocks, width, kind, 0
        self.n, self.sums = self._moments()
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(width)

    def _moments(self) -> tuple[int, list[int]]:
        """Rows and exact sums by dimension."""
        width, kind = self.width, self.kind

        def run(batches):
            n, total = 0, [0] * width
            for batch in batches:
                for raw in batch.column(0):
                    x = np.frombuffer(raw.as_buffer(), kind).reshape(-1, width)
                    n += len(x)
                    own = x.astype(object).sum(axis=0) if kind == "<i8" else x.sum(
                        axis=0, dtype=np.int64)
                    total = [a + int(b) for a, b in zip(total, own, strict=True)]
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()),
                     pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))],
                    ["at", "n", "total"])

        found = self.blocks.mapInArrow(run, "at int, n long, total decimal(38,0)").groupBy(
            "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        by = {r.at: r for r in found}  # one row per dimension
        return (by[0].n, [int(by[i].total) for i in range(width)]) if by else (0, [0] * width)

    def _summed(self, step: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]):
        """The sum over all blocks of ``step(centred rows)``, an array of ``shape``."""
        width, kind, mean = self.width, self.kind, self.mean

        def run(batches):
            total, seen = np.zeros(shape), False
            for batch in batches:
                for raw in batch.column(0):
                    total += step(np.frombuffer(raw.as_buffer(), kind).reshape(-1, width) - mean)
                    seen = True
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(total.size), pa.int32()), pa.array(total.reshape(-1))],
                    ["at", "part"])

        found = self.blocks.mapInArrow(run, "at int, part double").groupBy("at").agg(
            F.sum("part").alias("part")).toArrow()
        out = np.zeros(int(np.prod(shape)))
        out[found.column("at").to_numpy()] = found.column("part").to_numpy()
        return out.reshape(shape)

    def spread(self) -> np.ndarray:
        """Variance of every dimension."""
        return self._summed(lambda x: (x * x).sum(axis=0), (self.width,)) / max(1, self.n)

    def apply(self, block: np.ndarray) -> np.ndarray:
        """The covariance times ``block``."""
        self.products += 1
        return self._summed(lambda x: x.T @ (x @ block), block.shape) / self.n

    def covariance_of(self, projection: np.ndarray) -> np.ndarray:
        """Covariance of the projected fit list, centred before it is multiplied."""
        k = projection.shape[1]
        offset = self._summed(lambda x: (x @ projection).sum(axis=0), (k,)) / self.n

        def step(x):
            y = x @ projection - offset
            return y.T @ y

        return self._summed(step, (k, k)) / self.n


def _usable_rows(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("vec_id", "embedding").where(usable())


def fit(embeddings: DataFrame, components: int = 4) -> Whitening:
    """The leading ``components`` of the fit list: each distinct vector, as whole numbers, once.

    Eigenvalues that are zero up to rounding stay, as zero. Nulls, widths and empty tables: see
    ``whiten``.
    """
    rows = _usable_rows(embeddings)
    width, most = extent(rows)
    kind = _kind(most)
    none = np.zeros(0), np.zeros((width, 0))
    if not width:
        return Whitening(0, [], 0.0, *none, 0.0, 0.0, 0)
    fitted = FitList(_fit_blocks(rows, width, kind), width, kind)
    if not fitted.n:
        return Whitening(0, [0] * width, 0.0, *none, 0.0, 0.0, 0)
    spread = fitted.spread()
    trace = float(spread.sum())
    axes = np.argsort(-spread, kind="stable")[:min(components + GUARD, width)]
    values, vectors, residual = jacobi_davidson(
        fitted.apply, width, components, np.eye(width)[:, axes]) if trace > 0 else (
        np.zeros(min(components, width)), np.eye(width)[:, :components], 0.0)
    values = np.where(values > 1e-13 * trace, values, 0.0)
    real, error = values > 0, 0.0
    if real.any():
        error = float(np.abs(fitted.covariance_of(vectors[:, real] / np.sqrt(values[real])) - np.eye(
            int(real.sum()))).max())
    return Whitening(fitted.n, fitted.sums, trace, values, vectors, residual, error,
                     fitted.products)


def transform(embeddings: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row
    and component of ``model``; ``deviation`` as an exact decimal(38,0)."""
    width, n = len(model.sums), model.n
    sums = np.array(model.sums, dtype=object)
    mean = np.array([s / n for s in model.sums]) if n else np.zeros(width)
    real = model.values > 0
    scaled = model.vectors / np.sqrt(np.where(real, model.values, 1.0))
    k = scaled.shape[1]
    explained = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
    largest = max((abs(s) for s in model.sums), default=0)

    def deviations(x: np.ndarray) -> list[Decimal | None]:
        edge = n * int(np.abs(x).max(initial=0)) + largest
        if width * edge * edge < 2 ** 62:
            found = ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1)
        else:
            found = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
        return [Decimal(int(v)) if v < 10 ** 38 else None for v in found]

    def run(batches):
        for batch in batches:
            for part in slices(batch, max(width, 4 * k)):
                x = whole(matrix(part.column(1), width))
                made, rows = (x - mean) @ scaled, len(x)
                keep = np.tile(real, rows)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    pa.array(np.full(rows * k, n), pa.int64()),
                    pa.array([d for d in deviations(x) for _ in range(k)], pa.decimal128(38, 0)),
                    pa.array(made.reshape(-1), pa.float64(), mask=~keep),
                    pa.array(explained * rows, pa.float64()),
                    pa.array(np.full(rows * k, model.identity_error), pa.float64()),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained",
                    "identity_error"])

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, "
              "explained double, identity_error double")
    rows = _usable_rows(embeddings)
    return rows.mapInArrow(run, schema) if k else rows.limit(0).mapInArrow(run, schema)


def whiten(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """Every row's coordinates on the leading components of the table, scaled to unit variance.

    Entries become floor(256 * x). Rows whose vector is null or holds null or non-finite entries are
    dropped; a null vec_id stays null, repeated rows are all returned and count once in the fit;
    shorter vectors continue with zeros. With fewer dimensions than ``components`` there are as many
    components as dimensions. ``deviation`` is null beyond 38 digits. A component without variance has eigenvalue 0 and ``whitened`` null;
    without any variance ``explained`` is null too. An empty table, or one of empty vectors, gives
    no rows. Other columns are not looked at.
    """
    return transform(embeddings, fit(embeddings, components))

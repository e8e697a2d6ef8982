"""Whitening, near duplicates and hard negatives of embeddings against plain versions."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from postwatch.llm import negatives, polytope, whitening
from postwatch.llm.queries import QUERIES

SCHEMA = ("vec_id long, embedding array<float>, label int, row long, id long, key string, "
          "component string, n string, score string, x string")
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def is_usable(vector):
    return vector is not None and all(x is not None and np.isfinite(x) for x in vector)


def groups(seed, n, width, centers=6, noise=0.05):
    """Vectors around a few centres, one of which holds a third of them."""
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centers, width))
    of = np.where(np.arange(n) % 3 == 0, 0, draw.integers(0, centers, n))
    return [(i, (middle[of[i]] + noise * draw.normal(size=width)).astype(np.float32).tolist(),
             int(of[i] % 3)) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Clusters, a third copies of one vector, ties, nulls everywhere, repeated rows and ids."""
    out = groups(3, 300, 9) + [(300 + i, groups(3, 300, 9)[4][1], 1) for i in range(150)]
    return out + [
        (1000, None, 1), (1050, [1.0, None] + [0.0] * 7, 1), (1100, [NAN] * 9, 1),
        (1150, [INF] + [0.0] * 8, 1), (1200, [0.0] * 9, 1), (1250, out[0][1], None),
        (None, out[0][1], 0), (50, out[7][1], 1), out[100], out[100], (1300, [1.0, 2.0], 2),
        (1350, [], 2), (1400, [-0.0] * 9, 1)]


def test_minres_solves_an_indefinite_system():
    draw = np.random.default_rng(1)
    a = draw.normal(size=(12, 12))
    a, b = a + a.T, draw.normal(size=12)
    solver = whitening.minres(b, 60, 1e-13)
    v = next(solver)
    with pytest.raises(StopIteration) as end:
        while True:
            v = solver.send(a @ v)
    assert np.allclose(a @ end.value.value, b)


@pytest.mark.parametrize("spectrum", [
    np.linspace(1, 40, 90), np.r_[np.ones(60), 5.0, 5.0, 5.0, 5.0], np.r_[np.zeros(50), 3.0, 2.0],
    10.0 ** np.linspace(-9, 3, 70), np.r_[np.full(80, 1.0), np.full(6, 1.0 + 1e-9)]])
def test_leading_pairs(spectrum):
    width = len(spectrum)
    turn = np.linalg.qr(np.random.default_rng(4).normal(size=(width, width)))[0]
    matrix = turn * spectrum @ turn.T
    values, vectors, residual = whitening.jacobi_davidson(
        lambda block: matrix @ block, width, 4, np.eye(width)[:, :3])
    assert np.allclose(values, np.sort(spectrum)[::-1][:4], rtol=1e-9, atol=1e-12 * spectrum.max())
    assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    assert np.allclose(matrix @ vectors, vectors * values, atol=1e-9 * spectrum.max())
    assert residual < 1e-9


def plain_whitening(rows, width, k=4):
    kept = [(i, np.r_[np.floor(256 * np.array(v, float)), np.zeros(width - len(v))])
            for i, v, _ in rows if is_usable(v)]
    fit = np.unique(np.stack([x for _, x in kept]), axis=0)
    n, sums = len(fit), fit.sum(axis=0).astype(np.int64)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return [(i, n, int(((n * x.astype(np.int64) - sums) ** 2).sum()),
             (x - sums / n) @ vectors / np.sqrt(values)) for i, x in kept], values / np.trace(cov)


def test_whitening_equals_a_dense_solver(spark, rows):
    expected, explained = plain_whitening(rows, 9)
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 4 * len(expected)
    assert got[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened",
                                      "explained", "identity_error"}
    n = expected[0][1]
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-10
    assert Counter((r.vec_id, int(r.deviation)) for r in got if r.component == 1) == Counter(
        (i, d) for i, _, d, _ in expected)
    made = defaultdict(list)
    for r in got:
        assert abs(r.explained - explained[r.component - 1]) < 1e-10
        made[r.component, r.vec_id, int(r.deviation)].append(r.whitened)
    for component in range(1, 5):
        signs = set()
        for i, _, d, w in expected:
            for value in made[component, i, d]:
                want = w[component - 1]
                if abs(want) > 1e-6:
                    signs.add(np.sign(value * want))
                assert abs(abs(value) - abs(want)) < 1e-8
        assert len(signs) == 1


def test_whitening_without_variance_or_rows(spark, rows):
    same = frame(spark, [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1), (None, [0.5, 0.25], 1)])
    got = whitening.whiten(same).collect()
    assert len(got) == 6 and {r.component for r in got} == {1, 2}
    assert {(r.n, r.deviation, r.whitened, r.explained) for r in got} == {(1, 0, None, None)}
    line = frame(spark, [(i, [float(i), 0.0, 0.0], 1) for i in range(40)])
    got = whitening.whiten(line).collect()
    assert {r.whitened is None for r in got if r.component > 1} == {True}
    first = np.array([r.whitened for r in got if r.component == 1])
    assert abs(first.var() - 1) < 1e-12 and got[0].explained == pytest.approx(1.0)
    assert whitening.whiten(frame(spark, rows).where("vec_id > 5000")).count() == 0
    assert whitening.whiten(frame(spark, [(1, [], 1), (2, None, 1)])).count() == 0
    huge = whitening.whiten(frame(spark, [(1, [3e30, 1.0], 1), (2, [-3e30, 2.0], 1)])).collect()
    assert len(huge) == 4 and {r.deviation for r in huge} == {None}


def plain_links(rows, threshold=0.98):
    width = max((len(v) for _, v, _ in rows if v is not None), default=0)
    full = []
    for _, v, label in rows:
        good = label is not None and is_usable(v) and any(v)
        x = np.r_[np.array(v, float), np.zeros(width - len(v))] if good else np.zeros(width)
        full.append(x / (np.linalg.norm(x) or 1))
    full = np.stack(full)
    near = full @ full.T >= threshold - 1e-15
    labels = np.array([-1 if r[2] is None else r[2] for r in rows])
    near &= (labels[:, None] == labels) & ~np.eye(len(rows), dtype=bool)
    component = np.arange(len(rows))
    while True:
        lower = np.where(near, component[None, :], len(rows)).min(axis=1)
        lower = np.minimum(component, lower)
        if (lower == component).all():
            break
        component = lower
    low = {}
    for (i, _, _), c in zip(rows, component, strict=True):
        if i is not None:
            low[c] = min(i, low.get(c, i))
    return Counter((i, int(near[at].sum()), low.get(component[at]), i == low.get(component[at]))
                   for at, (i, _, _) in enumerate(rows))


def test_near_duplicates_equal_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(polytope, "TILE", 40)  # large buckets take many tiles
    got = Counter(tuple(r) for r in polytope.near_duplicates(frame(spark, rows)).collect())
    assert got == plain_links(rows)
    assert any(n > 100 for _, n, _, _ in got)
    bare = polytope.near_duplicates(frame(spark, [(1, None, 1), (2, [], 2), (None, None, None)]))
    assert Counter(map(tuple, bare.collect())) == Counter(
        [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)])
    assert polytope.near_duplicates(frame(spark, rows).where("vec_id > 5000")).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs exactly at the limit in 64 dimensions: the hardest links there are."""
    draw = np.random.default_rng(9)
    out = []
    for i in range(600):
        a, b = draw.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        out += [(2 * i, a.astype(np.float32).tolist(), 0),
                (2 * i + 1, (0.9801 * a + np.sqrt(1 - 0.9801 ** 2) * b).astype(np.float32).tolist(),
                 0)]
    got = polytope.near_duplicates(frame(spark, out)).collect()
    wanted = sum(n * c for (_, n, _, _), c in plain_links(out).items())
    assert wanted >= 1190 and sum(r.n_links for r in got) >= 0.999 * wanted


def test_hadamard_is_a_rotation():
    vectors = np.random.default_rng(2).normal(size=(5, 16))
    turned = polytope.hadamard(vectors)
    assert np.allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(vectors, axis=1))
    assert np.allclose(polytope.hadamard(turned), vectors)


def plain_negatives(rows, every=50, positives=5, negatives=3, low=50, high=95):
    width = max((len(v) for _, v, _ in rows if v is not None), default=0)
    own = [(i, np.r_[np.floor(256 * np.array(v, float)), np.zeros(width - len(v))].astype(np.int64),
            label) for i, v, label in rows if i is not None and label is not None and is_usable(v)]
    out = Counter()
    for i, x, label in own:
        if i % every:
            continue
        scored = sorted((-int(x @ y), j, other == label) for j, y, other in own if j != i)
        for score, j, _ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and -low * score <= -100 * s[0] <= -high * score]
            for rank, (other, k, _) in enumerate(fit[:negatives], 1):
                out[i, j, rank, k, -score, -other] += 1
    return out


@pytest.mark.parametrize("candidates,anchors,tables", [(4096, 2048, 64), (37, 5, 3)])
def test_hard_negatives_equal_brute_force(spark, rows, monkeypatch, candidates, anchors, tables):
    for name, value in (("CANDIDATES", candidates), ("ANCHORS", anchors), ("TABLES", tables)):
        monkeypatch.setattr(negatives, name, value)
    got = Counter(tuple(r) for r in negatives.mine(frame(spark, rows), every=10).collect())
    assert got == plain_negatives(rows, every=10)
    assert sum(got.values()) > 100
    few = [r for r in rows if r[0] in (0, 50, 3, 7)]
    assert Counter(map(tuple, negatives.mine(frame(spark, few)).collect())) == plain_negatives(few)
    assert negatives.mine(frame(spark, rows).where("vec_id > 5000")).count() == 0


def test_tables_give_exact_scores():
    draw = np.random.default_rng(6)
    for top, kind in ((130, np.int32), (2 ** 27, np.int64)):
        a, c = (draw.integers(-top, top + 1, (n, 24)) for n in (7, 50))
        a[0], c[0] = -top, -top
        planes = int(top).bit_length() + 1
        packed = negatives.bit_planes(c, planes)
        assert (negatives.from_planes(packed) == c).all()
        assert (negatives.scores(packed, negatives.subset_sums(a, kind)) == c @ a.T).all()


def test_scores_beyond_a_long_are_refused(spark):
    with pytest.raises(ValueError):
        negatives.mine(frame(spark, [(50, [1e12], 1), (51, [1e12], 1)]))


def test_queries_read_the_embeddings_table(spark, tmp_path):
    rows = groups(8, 260, 8)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    moved = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    got = QUERIES["op13_four_russians_negatives"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == plain_negatives(moved)
    got = QUERIES["op12_polytope_near_duplicates"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == plain_links(rows)
    got = QUERIES["op11_jacobi_davidson_whitening"](spark, str(tmp_path))
    assert dict(got.dtypes)["deviation"] == "bigint" and got.count() == 4 * 260

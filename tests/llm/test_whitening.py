import math

import numpy as np
import pytest

from larkspan.llm import queries, whitening
from larkspan.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component long"


def exact(vectors):
    """Whole numbers, eigenvalues and eigenvectors (rows) of the covariance, deviations: by the definition."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(0)
    y = ((x * n - sums) / n).astype(np.float64)
    e, w = np.linalg.eigh(y.T @ y / n)
    return y, e[::-1], w[:, ::-1].T, ((x * n - sums) ** 2).sum(1)


def held(got, vectors, ids, k=32):
    y, e, w, deviation = exact(vectors)
    rank = min(k, int((e > 1e-9 * e[0]).sum()))
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, rank + 1))
    for c, rows in by.items():
        assert sorted(r.vec_id for r in rows) == sorted(ids)
        rows.sort(key=lambda r: r.vec_id)
        order = np.argsort(ids)
        z = np.array([r.whitened for r in rows])
        want = (y @ w[c - 1] / np.sqrt(e[c - 1]))[order]
        assert np.abs(z - want * np.sign(z @ want)).max() < 1e-7, c
        assert all(r.n == len(vectors) and r.identity_error <= 1e-9 and abs(r.explained / (e[c - 1] / e.sum()) - 1) < 1e-9 for r in rows)
        assert [r.deviation for r in rows] == [int(deviation[i]) for i in order]


@pytest.mark.parametrize("d,n", [(3, 40), (17, 300), (40, 500), (12, 7)])
def test_whitened(spark, d, n):
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((n, d)) * np.geomspace(1, 30, d)).astype(np.float32)
    rows = [(i, v.tolist(), 0, "x", 5) for i, v in enumerate(vectors)]
    bad = [(900, None, 1, "x", 5), (901, [], 1, "x", 5), (902, [float("nan")] * d, 1, "x", 5), (903, [float("inf")] + [0.0] * (d - 1), 1, "x", 5), (904, [None] + [0.0] * (d - 1), 1, "x", 5), (905, [1.0] * (d + 1), 1, "x", 5), (906, [1e20] * d, 1, "x", 5)]
    got = whitening.whitened(spark.createDataFrame(rows + bad, SCHEMA).repartition(4)).collect()
    held(got, vectors, list(range(n)))


def test_few_directions_and_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-50, 50, (60, 4)) / 64
    vectors = np.column_stack([base, base[:, :2], np.ones(60), np.zeros(60)])  # repeated and constant dimensions
    vectors = np.vstack([vectors, np.repeat(vectors[:1], 40, 0)])  # one vector has 41 of 100 rows
    rows = [(i, v.tolist(), 0, "x", 5) for i, v in enumerate(vectors)]
    held(whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect(), vectors, list(range(100)))
    same = spark.createDataFrame([(i, [1.0, 2.0], 0, "x", 5) for i in range(5)], SCHEMA)
    assert whitening.whitened(same).count() == 0 and whitening.whitened(same.limit(0)).count() == 0
    assert whitening.whitened(same.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    two = [(1, [3.0, 0.0], 0, "x", 1), (None, [-3.0, 0.0], 0, "x", 1), (1, [3.0, 0.0], 0, "x", 1)]
    got = whitening.whitened(spark.createDataFrame(two, SCHEMA)).collect()
    assert sorted((r.vec_id is None, r.component, r.n) for r in got) == [(False, 1, 3), (False, 1, 3), (True, 1, 3)]


def test_equal_deviations(spark):
    """Equal eigenvalues end the recursion early; new directions are drawn until all are found."""
    vectors = [s * 2.0 * np.eye(6)[i] for i in range(6) for s in (1, -1)]
    got = whitening.whitened(spark.createDataFrame([(i, v.tolist(), 0, "x", 1) for i, v in enumerate(vectors)], SCHEMA)).collect()
    z = np.zeros((12, 6))
    for r in got:
        z[r.vec_id, r.component - 1] = r.whitened
    assert len(got) == 72 and np.abs(z.T @ z / 12 - np.eye(6)).max() < 1e-12 and all(abs(r.explained - 1 / 6) < 1e-12 for r in got)


def test_large_deviations_are_exact():
    x = np.array([[2**40, 5], [1, 7], [2, 9]], np.int64)
    model = whitening.Model(3, [int(s) for s in x.sum(0)], np.zeros((2, 0)), np.zeros(0), 1.0)
    want = [sum((3 * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(0), strict=True)) for row in x]
    assert model.deviations(x) == [w if w < 1 << 63 else None for w in want] and None in model.deviations(x)
    model = whitening.Model(3, [int(s) for s in (x % 2**20).sum(0)], np.zeros((2, 0)), np.zeros(0), 1.0)
    assert model.deviations(x % 2**20) == [sum((3 * int(a) - s) ** 2 for a, s in zip(row, model.sums, strict=True)) for row in x % 2**20]


def test_left_vectors_are_orthogonal(spark):
    """The recursion itself: Y V = U B with orthonormal U and V."""
    x = np.random.default_rng(8).integers(-300, 300, (200, 10)).astype(np.int64)
    sums = [int(s) for s in x.sum(0)]
    blocks = spark.createDataFrame([(len(p), p.tobytes(), p.sum(0).tolist()) for p in (x[:90], x[90:])], "rows long, data binary, sums array<long>")
    v, b = whitening.bidiagonal(blocks, 200, sums)
    y = whitening.centred(x, 200, sums)
    u = np.linalg.solve(b.T, (y @ v).T).T
    assert np.abs(v.T @ v - np.eye(10)).max() < 1e-13 and np.abs(u.T @ u - np.eye(10)).max() < 1e-12
    assert np.abs(np.triu(b, 2)).max() == 0 and np.abs(np.tril(b, -1)).max() == 0


def test_query_over_whole_table(spark, data):
    sf = f"{data}/sf0.001"
    rows = table(spark, sf, "embeddings").collect()
    held(queries.QUERIES["op11_whitening"](spark, sf).collect(), [r.embedding for r in rows], [r.vec_id for r in rows])

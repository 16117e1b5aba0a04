import math

import numpy as np
import pytest

from loomgraph.llm import queries, whitening

KIND = "vec_id long, embedding array<float>, label int, v int, deviation string"


def brute(rows, top=8):
    """Whitening of (vec_id, vector): n, deviations, components and variances by an eigendecomposition of the covariance."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    dev = [int(t) for t in ((n * x - s) ** 2).sum(axis=1)]
    y = (n * x - s).astype(float) / n
    e, c = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)[:top]
    return n, dev, y, e[order], c[:, order].T, e.sum()


def compare(got, rows, top=8):
    n, dev, y, e, c, trace = brute(rows, top)
    ids = [k for k, _ in rows]
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == n * len(e)
    w = np.array([[by[i, k + 1].whitened for k in range(len(e))] for i in ids])
    want = y @ c.T / np.sqrt(e)
    sign = np.sign((w * want).sum(axis=0))
    assert np.allclose(w, want * sign, rtol=1e-6, atol=1e-7)
    assert [by[i, 1].deviation for i in ids] == dev and {r.n for r in got} == {n}
    for k in range(len(e)):
        assert by[ids[0], k + 1].explained == pytest.approx(e[k] / trace, rel=1e-9)
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def table(spark, rows):
    return spark.createDataFrame([(k, v, 1, 1, "x") for k, v in rows], KIND)


def vectors(n, d, seed=0):
    rnd = np.random.default_rng(seed)
    return rnd.normal(size=(n, d)) * np.geomspace(1, 0.01, d) @ np.linalg.qr(rnd.normal(size=(d, d)))[0]


def test_against_brute_force(spark):
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(vectors(400, 13))]
    odd = [(900, None), (901, [None] + [0.0] * 12), (902, [float("nan")] * 13), (903, [float("inf")] * 13), (904, [1e30] * 13), (905, [1.0, 2.0]), (906, [])]
    got = whitening.whitened(table(spark, rows + odd).repartition(5))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(got.collect(), rows)


def test_many_triangles_and_large_blocks(spark, monkeypatch):
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(vectors(500, 5, 1))]
    df = table(spark, rows).repartition(40)  # over FAN tasks: two levels of stacking
    compare(whitening.whitened(df, 3).collect(), rows, 3)


def test_whole_table(spark):
    """The query, on the given vectors."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    rows = [(k, v) for k, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    compare(queries.op11_whitening(spark, "/root/testdata/sf0.001").collect(), rows)


def test_repeats_ties_and_no_variance(spark):
    same = whitening.whitened(table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 3 and r.identity_error is None for r in same)
    flat = whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert [r.whitened is None for r in sorted(flat, key=lambda r: (r.component, r.vec_id))] == [False] * 3 + [True] * 3
    assert {round(r.explained, 12) for r in flat} == {1.0, 0.0} and flat[0].identity_error < 1e-12
    ties = whitening.whitened(table(spark, [(k, [float(x), float(y)]) for k, (x, y) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)])])).collect()
    assert {r.explained for r in ties} == {0.5} and ties[0].identity_error < 1e-12


def test_empty_tables(spark):
    assert whitening.whitened(table(spark, [(1, [1.0])]).limit(0)).count() == 0
    none = whitening.whitened(table(spark, [(1, None), (2, [])]))
    assert none.count() == 0 and len(none.columns) == 7


def test_jacobi_keeps_small_singular_values():
    """Columns of very different size: relative, not absolute, accuracy."""
    rnd = np.random.default_rng(3)
    q = np.linalg.qr(rnd.normal(size=(30, 6)))[0]
    sizes = np.array([1e8, 1e4, 1.0, 1e-3, 1e-6, 1e-9])
    sd, v = whitening.jacobi(np.linalg.qr(q * sizes, mode="r"))
    assert np.allclose(sd, sizes, rtol=1e-9) and np.allclose(v @ v.T, np.eye(6), atol=1e-14)


def test_exact_beyond_64_bits():
    x = np.array([[1 << 50, 5], [3, -(1 << 50)]])
    s = np.array([(1 << 50) + 3, 5 - (1 << 50)])
    y = whitening.deviations(x, 1 << 13, s)
    assert y.tolist() == [[(1 << 13) * int(a) - int(b) for a, b in zip(r, s)] for r in x]
    assert whitening._square_sums(y) == [None, None] and whitening._square_sums(np.array([[3, 4], [1 << 30, 0]])) == [25, 1 << 60]

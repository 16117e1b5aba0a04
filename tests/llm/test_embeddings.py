import numpy as np
import pytest

from loomgraph.llm import embeddings
from loomgraph.llm.embeddings import buckets, duplicates, encode, estimates, unit


def brute(rows, threshold=0.93):
    ok = [lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    n, cls = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    x, y = cls[i], cls[j]
                    cls = [y if c == x else c for c in cls]
    least = {}
    for (d, _, _), c in zip(rows, cls):
        least[c] = min(d, least.get(c, d))
    return sorted((d, k, least[c], least[c] == d) for (d, _, _), k, c in zip(rows, n, cls))


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(30, 64))
    out = []
    for k in range(260):
        c = centres[k % 30]
        v = c + rnd.normal(size=64) * (0.1 if k % 3 else 1.0)
        out.append((k, v.astype(np.float32).tolist(), None if k % 41 == 0 else k % 2))
    out += [(300, out[1][1], out[1][2]), (301, out[1][1], out[1][2]), (302, [0.0] * 64, 1), (303, [0.0] * 64, 1), (304, None, 1), (305, [], 1), (306, [float("nan")] * 64, 1), (307, [None] + [1.0] * 63, 1), (308, [float("inf")] + [1.0] * 63, 1), (309, [1.0, 2.0], 1), (310, [2.0, 4.0], 1)]
    return out + [(5, out[5][1], out[5][2]), (311, [1e30] * 64, 0), (312, [1e-30] * 64, 0)]


@pytest.mark.parametrize("chunk", [2048, 3])
def test_brute_force(spark, rows, chunk):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n string")
    got = duplicates(df, chunk=chunk)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_empty(spark):
    assert duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    rnd = np.random.default_rng(8)
    a = unit(rnd.normal(size=(400, 64)))
    b = unit(a + rnd.normal(size=a.shape) * 0.12)
    est, error = estimates(*encode(a), b)
    off = est - a @ b.T
    assert abs(off.mean()) < 0.005
    assert (np.abs(off) <= embeddings.SURE * error[:, None]).mean() > 0.9999


def test_recall_at_the_threshold():
    rnd = np.random.default_rng(9)
    a = unit(rnd.normal(size=(1500, 64)))
    side = rnd.normal(size=a.shape)
    side = unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    for cosine, least in ((0.93, 0.9), (0.97, 0.99)):
        b = cosine * a + np.sqrt(1 - cosine**2) * side
        assert (buckets(a) == buckets(b)).any(axis=1).mean() >= least

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import emulator
import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import kernel
from loomgraph.operators.relations import Relation, target_range
from loomgraph.operators.tdjoin import classify, td_join

DAY = 86_400_000_000
KINDS = ["equal", "meets", "before", "overlaps", "none"]


def grid(n, start=0, step=DAY):
    return [start + k * step for k in range(n)]


def fixtures():
    """Micro-series by name: regular, shifted, constant, periodic, short, irregular, repeated starts, one-second, empty."""
    v = [1.0, 2, 4, 3, 5, 9, 7, 8]
    return {
        1: (grid(8), v),
        2: (grid(8, 3 * DAY), [2.0, 1, 5, 3, 3, 8, 1, 9]),
        3: (grid(8, DAY // 2), v),
        4: (grid(6), [5.0] * 6),
        5: (grid(7), [7.0] * 7),
        6: (grid(12), [1.0, 2, 4] * 4),
        7: (grid(2), [1.0, 2]),
        8: (grid(3), [1.0, 3, 2]),
        9: ([0, 3 * DAY, *grid(8, 4 * DAY)], [1.0, 2, 1, 4, 2, 2, 6, 3, 1, 5]),
        10: ([0, 0, DAY, 2 * DAY, 3 * DAY, 4 * DAY], [1.0, 5, 2, 4, 3, 3]),
        11: (grid(14, 0, 1_000_000), [3.0, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7]),
        12: (grid(14, 2_000_000, 1_000_000), [2.0, 7, 1, 8, 2, 8, 1, 8, 2, 8, 4, 5, 9, 0]),
        13: (grid(8, -2 * DAY), [4.0, 1, 2, 8, 5, 7, 1, 3]),
        14: ([], []),
        15: (grid(9, 0, 2 * DAY), [1.0, 4, 2, 8, 5, 7, 6, 6, 2]),
    }


@pytest.fixture(scope="module")
def series(spark):
    rows = [(k, "x", t, [float(x) for x in v]) for k, (t, v) in fixtures().items()] + [(1, "y", grid(3), [1.0, 1.0, 2.0])]
    return spark.createDataFrame(rows, "node_id long, ts_type string, ts array<long>, v array<double>").cache()


@pytest.fixture(scope="module")
def pairs(spark):
    names = [*fixtures(), 99]
    return spark.createDataFrame([(a, b) for a in names for b in names] * 2, "src long, dst long").cache()


@pytest.mark.parametrize(("w", "thresholds"), [(3, (0.85,)), (4, (-1.0, 0.05)), (6, (0.05,))])
@pytest.mark.parametrize("relation", KINDS)
def test_free_join_on_micro_series(pairs, series, relation, w, thresholds):
    f = fixtures()
    for threshold in thresholds:
        got = {(r.src, r.dst): (r.i, r.j, r.dist) for r in td_join(pairs, series, "x", relation, w, threshold).collect()}
        want = {(a, b): r for a in f for b in f if (r := emulator.td(*f[a], *f[b], w, relation, threshold))}
        assert got == want


@pytest.mark.parametrize("relation", KINDS)
def test_pinned_join(spark, series, relation):
    f, w = fixtures(), 4
    asked = [(a, b, p) for a in f for b in f for p in (-1, 0, 1, 3, 4, 9)]
    df = spark.createDataFrame(asked, "src long, dst long, pin int").where("pin >= 0")
    got = {(r.src, r.dst, r.pin): (r.i, r.j, r.dist) for r in td_join(df, series, "x", relation, w, 0.1).collect()}
    assert got == {(a, b, p): r for a, b, p in asked if p >= 0 and (r := emulator.td(*f[a], *f[b], w, relation, 0.1, p))}


@pytest.mark.parametrize("relation", KINDS)
@pytest.mark.parametrize("method", ["stamp", "stomp"])
def test_baselines(pairs, series, relation, method):
    f, w = fixtures(), 4
    got = {(r.src, r.dst): (r.i, r.j, r.dist) for r in td_join(pairs, series, "x", relation, w, 0.99, method).collect()}
    assert got == {(a, b): r for a in f for b in f if (r := emulator.stamp(*f[a], *f[b], w, relation))}


def test_random_series_with_ties(spark):
    rnd = random.Random(6)
    f = {}
    for k in range(24):
        n, step = rnd.randint(5, 30), rnd.choice([DAY, DAY, 2 * DAY])
        f[k] = (grid(n, rnd.randint(-4, 4) * DAY, step), [float(rnd.randint(0, 3)) for _ in range(n)])
    s = spark.createDataFrame([(k, "x", t, v) for k, (t, v) in f.items()], "node_id long, ts_type string, ts array<long>, v array<double>")
    p = spark.createDataFrame([(a, b) for a in f for b in f], "src long, dst long")
    for relation in KINDS:
        got = {(r.src, r.dst): (r.i, r.j, r.dist) for r in td_join(p, s, "x", relation, 5, 0.3).collect()}
        assert got == {(a, b): r for a in f for b in f if (r := emulator.td(*f[a], *f[b], 5, relation, 0.3))}


def test_window_of_two_and_too_long_match_nothing(pairs, series):
    for w in (1, 2, 15):
        assert td_join(pairs, series, "x", "none", w, -1.0).count() == 0


def test_names(pairs, series):
    assert td_join(pairs, series, "x", "EQUAL", 3).count() == td_join(pairs, series, "x", "equal", 3).count()
    assert td_join(pairs, series, "x", None, 3).count() == td_join(pairs, series, "x", "none", 3).count()
    for bad in ({"relation": "after"}, {"method": "other"}, {"w": 0}):
        with pytest.raises(ValueError):
            td_join(pairs, series, "x", **({"relation": "equal", "w": 3} | bad))


def test_a_higher_threshold_keeps_the_row_or_drops_it(pairs, series):
    low = {(r.src, r.dst): r for r in td_join(pairs, series, "x", "overlaps", 4, 0.0).collect()}
    for r in td_join(pairs, series, "x", "overlaps", 4, 0.7).collect():
        assert low[r.src, r.dst] == r


def test_missing_values_and_types(spark, series):
    odd = spark.createDataFrame([(1, "x", grid(5), [1.0, None, 2.0, 3.0, 9.0]), (2, "x", grid(5), [float("nan"), 1.0, 2.0, 3.0, 9.0])], series.schema)
    got = td_join(spark.createDataFrame([(1, 2), (2, 1), (1, 1)], "src long, dst long"), odd, "x", "equal", 3, -1.0).collect()
    assert {(r.src, r.dst, r.i, r.j) for r in got} == {(1, 2, 2, 2), (2, 1, 2, 2), (1, 1, 2, 2)}


def test_string_keys(spark, series):
    s = series.withColumn("node_id", F.col("node_id").cast("string"))
    got = td_join(spark.createDataFrame([("1", "2")], "src string, dst string"), s, "x", "equal", 3).first()
    assert (got.src, got.dst) == ("1", "2")


def test_classify_sorts_every_window_pair_once(pairs, series):
    f, w = fixtures(), 4
    got = {}
    for r in classify(pairs, series, "x", w).collect():
        got.setdefault((r.src, r.dst), {})[r.relation] = r.n
    for a, (ta, _) in f.items():
        for b, (tb, _) in f.items():
            want = {}
            for i in range(len(ta) - w + 1):
                for j in range(len(tb) - w + 1):
                    sa, ea, sb, eb = ta[i], ta[i + w - 1], tb[j], tb[j + w - 1]
                    k = "equal" if (sa, ea) == (sb, eb) else "meets" if sb == ea + 1_000_000 else "overlaps" if sa < eb and ea > sb else "before" if ea < sb else None
                    if k:
                        want[k] = want.get(k, 0) + 1
            assert got.get((a, b), {}) == want


def test_target_range():
    assert target_range(Relation.EQUAL, 2, -3, 4, 9) is None
    assert target_range(Relation.BEFORE, 0, -9, 4, 5) == (0, 4)
    assert target_range(Relation.OVERLAPS, 0, 0, 4, 9) == (1, 2)
    assert target_range(Relation.NONE, 5, 0, 4, 3) == (0, 2)
    assert target_range(Relation.MEETS, 0, 6, 4, 5) is None


@pytest.mark.parametrize("relation", KINDS)
def test_tiles_change_nothing(monkeypatch, relation):
    """With a working array of a few windows, joins and classes are the same."""
    rnd = np.random.default_rng(5)
    a, b = rnd.integers(0, 4, (3, 40)).astype(float), rnd.integers(0, 4, (3, 33)).astype(float)
    ta, tb = np.arange(40) * DAY, np.sort(rnd.integers(-3, 36, 33)) * DAY
    def run():
        best = kernel.grid_join(a, b, 5, Relation.of(relation), 2, 0.3)
        return best.dist.tolist(), best.i.tolist(), best.j.tolist(), [kernel.profile_join(x, ta, y, tb, 5, Relation.of(relation)) for x, y in zip(a, b)], [kernel.classified(x, ta, y, tb, 5) for x, y in zip(a, b)]

    want = run()
    for room in (1, 70, 500):
        monkeypatch.setattr(kernel, "ROOM", room)
        assert run() == want


def test_memory_does_not_grow_with_the_square_of_the_length():
    import tracemalloc

    rnd = np.random.default_rng(6)
    a, b = rnd.random((2, 1, 20_000))
    tracemalloc.start()
    best = kernel.grid_join(a, b, 8, Relation.BEFORE, 0, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert best.i[0] >= 0 and peak < 300e6


def test_blocks_grow_in_number_with_series_not_in_size(spark, monkeypatch):
    from loomgraph.operators import tdjoin

    rows = [(k, "x", [p * DAY for p in range(20)], [float((k * p * p + p) % 11) for p in range(20)]) for k in range(50)]
    many = spark.createDataFrame(rows, "node_id long, ts_type string, ts array<long>, v array<double>")
    asked = spark.createDataFrame([(a, b) for a in range(50) for b in range(50)], "src long, dst long")
    want = sorted(map(tuple, td_join(asked, many, "x", "before", 4, 0.2, blocks=0).drop("pin").collect()))
    sizes = []
    own = tdjoin.in_blocks
    monkeypatch.setattr(tdjoin, "in_blocks", lambda pairs, series, p: (sizes.append(p), own(pairs, series, p))[1])
    for room, least, rows_of_blocks in ((16 << 20, 3, 3), (16 * 20 * 5, 3, 10), (16 * 20 * 5, 12, 12)):
        monkeypatch.setattr(tdjoin, "BLOCK_BYTES", room)
        assert sorted(map(tuple, td_join(asked, many, "x", "before", 4, 0.2, blocks=least).drop("pin").collect())) == want
        assert sizes.pop() == rows_of_blocks

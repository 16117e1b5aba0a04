import time
import tracemalloc

import numpy as np
import pytest

from loomgraph.operators import kernel, search, tdjoin
from loomgraph.operators.relations import Relation
from loomgraph.operators.search import Windows, by_diagonals, by_fft, pruned
from loomgraph.operators.tdjoin import td_join

DAY = 86_400_000_000


def shapes(n, seed):
    rnd = np.random.default_rng(seed)
    yield rnd.normal(size=n)
    yield np.cumsum(rnd.normal(size=n))
    yield rnd.integers(0, 3, n).astype(float)
    yield np.tile([1.0, 2, 4, 3], n // 4 + 1)[:n]
    yield np.arange(n) * 1e5 + rnd.normal(size=n)
    gaps = rnd.normal(size=n)
    gaps[n // 3 : n // 3 + 20], gaps[n // 2], gaps[n // 2 + 9] = 5, np.nan, np.inf
    yield gaps
    yield np.ones(n)
    yield rnd.normal(size=n) * 1e-3 + 1e7


def dense(a, b, m, relation, offset, threshold):
    """The matrix product over all windows."""
    best = kernel.Best(1)
    za, zb = kernel.z_windows(a[None], m), kernel.z_windows(b[None], m)
    i, j = np.arange(za.shape[1])[:, None], np.arange(zb.shape[1])[None]
    kernel._matrix(za, zb, ((j >= i + m + offset) | (relation is Relation.NONE))[None], threshold, best, 0)
    return (int(best.i[0]), int(best.j[0]), float(best.dist[0])) if np.isfinite(best.dist[0]) else None


@pytest.mark.parametrize("m", [3, 8, 30])
def test_all_ways_find_the_same(m, monkeypatch):
    n_a, n_b = 160, 133
    monkeypatch.setattr(search, "SEGMENT", 50)
    monkeypatch.setattr(search, "ROOM", 3000)
    share_open = iter([1.0, search.OPEN_SHARE] * 10_000)  # in turn, with bounds alone and with FFTs where they leave much open
    ta, tb = np.arange(n_a) * DAY, (np.arange(n_b) + 5) * DAY
    for a in shapes(n_a, 0):
        for b in shapes(n_b, 1):
            wa, wb = Windows(a, m), Windows(b, m)
            for relation, offset, threshold in ((Relation.BEFORE, 0, 0.5), (Relation.BEFORE, -7, -1.0), (Relation.BEFORE, 40, 0.0), (Relation.NONE, 0, 0.95), (Relation.NONE, 0, 0.0)):
                monkeypatch.setattr(search, "OPEN_SHARE", next(share_open))
                got, share = pruned(wa, wb, m + offset if relation is Relation.BEFORE else None, threshold)
                assert got == dense(a, b, m, relation, offset, threshold) and 0 <= share <= 1
            times = ta[: n_a - m + 1], ta[m - 1 :], tb[: n_b - m + 1], tb[m - 1 :]
            for name in ("before", "overlaps"):
                allowed = lambda *t: kernel.related(name, *t)  # noqa: B023, E731
                best = kernel.Best(1)
                kernel._matrix(kernel.z_windows(a[None], m), kernel.z_windows(b[None], m), allowed(times[0][:, None], times[1][:, None], times[2][None], times[3][None])[None], None, best, 0)
                want = (int(best.i[0]), int(best.j[0]), float(best.dist[0])) if np.isfinite(best.dist[0]) else None
                assert by_fft(wa, wb, times, allowed) == want
                assert by_diagonals(wa, wb, times, allowed) == want
                assert by_diagonals(wa, wb, times, allowed, between=lambda *t: kernel.related_between(name, *t)) == want  # noqa: B023
                parts = [r for k in range(3) if (r := by_diagonals(wa, wb, times, allowed, None, k, 3)) is not None]
                assert min(parts, key=lambda r: (r[2], -r[0], r[1]), default=None) == want


def test_bounds_prune_smooth_series():
    rnd, t = np.random.default_rng(2), np.arange(6000)
    a, b = (np.sin(t / 90 + p) + 0.3 * np.sin(t / 31 + 2 * p) + rnd.normal(size=6000) * 0.002 for p in (0.3, 1.1))
    got, share = pruned(Windows(a, 40), Windows(b, 40), 40, 0.0)
    assert got == by_fft(Windows(a, 40), Windows(b, 40), (t[:5961],) * 2 + (t[:5961],) * 2, lambda sa, ea, sb, eb: sb >= sa + 40) and share < 0.05


def test_long_series_in_little_time_and_memory():
    rnd = np.random.default_rng(6)
    a, b = rnd.random((2, 20_000))
    t = np.arange(20_000) * DAY
    for run in (lambda: kernel.grid_join(a[None], b[None], 30, Relation.BEFORE, 0, 0.0), lambda: kernel.profile_join(a, t, b, t, 30, Relation.BEFORE, "stomp"), lambda: kernel.profile_join(a, t, b, t, 30, Relation.BEFORE)):
        began = time.process_time()
        run()
        assert time.process_time() - began < 30
    tracemalloc.start()
    long = rnd.random((2, 1, 200_000))
    kernel.grid_join(*long, 70, Relation.OVERLAPS, 0, 0.9)
    kernel.grid_join(*long, 70, Relation.EQUAL, 3, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6


@pytest.mark.parametrize("relation", [Relation.EQUAL, Relation.MEETS, Relation.OVERLAPS])
def test_long_narrow_joins_in_parts(monkeypatch, relation):
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(0, 3, (2, 2, 90)).astype(float)
    want = [kernel.grid_join(a, b, 6, relation, k, 0.2) for k in (-4, 0, 11)]
    monkeypatch.setattr(kernel, "ROOM", 100)
    got = [kernel.grid_join(a, b, 6, relation, k, 0.2) for k in (-4, 0, 11)]
    assert [(g.i.tolist(), g.j.tolist(), g.dist.tolist()) for g in got] == [(w.i.tolist(), w.j.tolist(), w.dist.tolist()) for w in want]


@pytest.mark.parametrize("name", ["before", "overlaps"])
def test_ranges_of_times_tell_of_all_times_in_them(name):
    rnd = np.random.default_rng(4)
    seen = set()
    for _ in range(3000):
        t = [rnd.integers(0, 12) + np.sort(rnd.integers(0, 1 + rnd.integers(0, 4), 3)) for _ in range(4)]
        told = kernel.related_between(name, *((x[0], x[-1]) for x in t))
        every = kernel.related(name, t[0][:, None, None, None], t[1][:, None, None], t[2][:, None], t[3])
        assert told is None or (every.all() if told else not every.any())
        seen.add(told)
    assert seen == {True, False, None}


@pytest.fixture(scope="module")
def graph(spark):
    rnd = np.random.default_rng(8)
    s = [(k, "x", [int(t) * DAY for t in range(k % 3, k % 3 + 20 + k % 2)], [float(x) for x in rnd.integers(0, 5, 20 + k % 2)]) for k in range(40)]
    pairs = [(a, b) for a in range(42) for b in range(41) if a == 0 or (a * 7 + b) % 3 == 0] * 2
    return spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame(s, "node_id long, ts_type string, ts array<long>, v array<double>")


def rows(df):
    return sorted(map(tuple, df.select("src", "dst", "pin", "i", "j", "dist").collect()), key=str)


@pytest.mark.parametrize(("relation", "method"), [("overlaps", "td"), ("before", "td"), ("equal", "stamp"), ("before", "stamp")])
def test_blocks_change_nothing(graph, relation, method):
    pairs, series = graph
    want = rows(td_join(pairs, series, "x", relation, 5, 0.2, method, 0))
    for p in (1, 3, 7):
        assert rows(td_join(pairs, series, "x", relation, 5, 0.2, method, p)) == want
    pinned = pairs.selectExpr("src", "dst", "cast(src % 4 AS int) AS pin")
    assert rows(td_join(pinned, series, "x", relation, 5, 0.2, method, 3)) == rows(td_join(pinned, series, "x", relation, 5, 0.2, method, 0))
    assert td_join(pairs.limit(0), series, "x", relation, 5, 0.2, method, 2).count() == 0


def test_series_move_once_for_each_block(spark, graph):
    """Copies grow with the rows of blocks, not with the pairs; a hub's pairs lie in several blocks; series are read once."""
    _, series = graph
    every = spark.range(40).withColumnRenamed("id", "src").join(spark.range(40).withColumnRenamed("id", "dst"))
    dealt, sent = tdjoin.in_blocks(every, series, 4)
    assert sent.count() <= 40 * 4 * 2 and dealt.count() == 1600
    assert dealt.where("src = 0").select("block").distinct().count() > 1
    from loomgraph.session import staged

    plan = td_join(every, staged(series, "moved"), "x", "equal", 5, blocks=4)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and plan.count("moved-") == 1


def test_large_tables_are_dealt_to_blocks(graph, monkeypatch):
    from loomgraph.session import staged

    pairs, series = graph
    stored = staged(series, "stored")
    assert tdjoin.block_rows(stored) == 0
    monkeypatch.setattr(tdjoin, "BLOCKED_BYTES", 0)
    assert tdjoin.block_rows(stored) >= tdjoin.LEAST_BLOCKS and tdjoin.block_rows(series) == 0
    assert "CoGroups" in td_join(pairs, stored, "x", "equal", 5)._jdf.queryExecution().executedPlan().toString()
    assert rows(td_join(pairs, stored, "x", "equal", 5)) == rows(td_join(pairs, series, "x", "equal", 5))


@pytest.mark.parametrize("relation", ["before", "overlaps", "meets"])
def test_long_pairs_are_shared(graph, monkeypatch, relation):
    pairs, series = graph
    want = rows(td_join(pairs, series, "x", relation, 5, 0.2, "stomp"))
    monkeypatch.setattr(tdjoin, "SHARE_PAIRS", 260)  # some pairs are over it, some are not
    got = td_join(pairs, series, "x", relation, 5, 0.2, "stomp")
    assert rows(got) == want
    monkeypatch.setattr(tdjoin, "SHARE_PAIRS", 60)
    assert rows(td_join(pairs, series, "x", relation, 5, 0.2, "stomp")) == want

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import emulator
from pyspark.sql import functions as F

from loomgraph.operators import pattern
from loomgraph.operators.metrics import WalkMetrics
from loomgraph.operators.pattern import Edge, Node
from loomgraph.operators.walk import count_matches, count_walks, temporal_walk, virtual_edges
from loomgraph.plans.model import HybridGraph, checked_series, from_lists, from_points

DAY = 86_400_000_000
EDGES = [(1, 1, 2, "A"), (2, 1, 2, "A"), (3, 2, 3, "B"), (4, 3, 1, "A"), (5, 2, 2, "A"), (6, 3, 4, "C")]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(1, "P", "x", 1.0), (2, "P", "y", 2.0), (3, "Q", "x", 2.1), (4, "Q", None, None)], "node_id long, label string, region string, lat double")
    edges = spark.createDataFrame(EDGES, "edge_id long, src long, dst long, type string")
    values = {1: [1, 2, 4, 3, 5, 9, 7, 8, 2, 2], 2: [2, 1, 3, 3, 6, 8, 7, 9, 1, 4], 3: [5, 1, 4, 4, 4, 2, 8, 1, 6, 3]}
    rows = [(k, "x", [(i + k) * DAY for i in range(10)], [float(x) for x in v]) for k, v in values.items()]
    return HybridGraph(nodes, edges, spark.createDataFrame(rows, "node_id long, ts_type string, ts array<long>, v array<double>"))


def paths(df):
    return sorted((tuple(r.nodes), tuple(r.edge_ids)) for r in df.collect())


def brute(n, edges=EDGES):
    out = [((a, b), (e,)) for e, a, b, _ in edges]
    for _ in range(n - 1):
        out = [(p + (b,), q + (e,)) for p, q in out for e, a, b, _ in edges if a == p[-1] and e not in q]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_hops_never_repeat_an_edge(graph, n):
    assert paths(pattern.hops(graph, Node(), Edge(), n)) == brute(n)


def test_directions(graph):
    both = [*EDGES, *[(e, b, a, t) for e, a, b, t in EDGES if a != b]]
    assert paths(pattern.match(graph, Node(), (Edge((), "any"), Node()))) == brute(1, both)
    assert paths(pattern.match(graph, Node(), (Edge((), "in"), Node()))) == sorted(((b, a), (e,)) for e, a, b, _ in EDGES)
    assert paths(pattern.hops(graph, Node(), Edge((), "any"), 2)) == brute(2, both)
    with pytest.raises(ValueError):
        pattern.match(graph, Node(), (Edge((), "up"), Node()))


def test_types_labels_and_conditions(graph):
    assert paths(pattern.match(graph, Node("P"), (Edge(("A", "B")), Node("P", "region = 'y'")))) == [((1, 2), (1,)), ((1, 2), (2,)), ((2, 2), (5,))]
    differs = pattern.where_nodes(pattern.match(graph, Node(), (Edge(), Node())), graph, {0: "a", 1: "b"}, "a_region <> b_region", ["region"])
    assert paths(differs) == [((1, 2), (1,)), ((1, 2), (2,)), ((2, 3), (3,))]
    near = pattern.where_nodes(pattern.match(graph, Node(), (Edge(), Node())), graph, {0: "a", 1: "b"}, "abs(a_lat - b_lat) < 0.5", ["lat"])
    assert paths(near) == [((2, 2), (5,)), ((2, 3), (3,))]


def test_every_node_and_page(graph, spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "node_id long")
    three = pattern.hops(graph, Node(), Edge(), 3)
    assert paths(pattern.every_node(three, ids)) == [p for p in brute(3) if 4 not in p[0]]
    assert [tuple(r.edge_ids) for r in pattern.page(three, 2, 3).collect()] == sorted(q for _, q in brute(3))[2:5]


def test_two_patterns_share_a_node_and_no_edge(graph):
    a = pattern.match(graph, Node(), (Edge(("A",)), Node()))
    m = pattern.both(a, a, {1: 1}).collect()
    want = {(x[0], y[0]) for x in EDGES for y in EDGES if x[3] == y[3] == "A" and x[2] == y[2] and x[0] != y[0]}
    assert {(r.edge_ids[0], r.other_edges[0]) for r in m} == want


def walk(graph, nodes, relation, w, threshold, cont):
    s = {r.node_id: (r.ts, r.v) for r in graph.series.collect()}
    hops, pin = [], None
    for a, b in zip(nodes, nodes[1:]):
        r = a in s and b in s and emulator.td(*s[a], *s[b], w, relation, threshold, pin if cont else None)
        if not r:
            return None
        hops.append((a, b, *r))
        pin = r[1]
    return hops


@pytest.mark.parametrize(("semantics", "relation", "threshold"), [("2cont", "overlaps", 0.0), ("2cont", "before", 0.3), ("cont", "overlaps", 0.0), ("cont", "equal", -1.0)])
def test_walks(graph, semantics, relation, threshold):
    mixed = None
    for n in (1, 2, 3):
        p = pattern.hops(graph, Node(), Edge(), n)
        want = sorted((nodes, edges, h) for nodes, edges in brute(n) if (h := walk(graph, nodes, relation, 3, threshold, semantics == "cont")))
        if n != 2:
            got = temporal_walk(p, graph.series, "x", relation, 3, threshold, semantics, n_hops=n)
            assert sorted((tuple(r.nodes), tuple(r.edge_ids), [tuple(h) for h in r.hops]) for r in got.collect()) == want
        mixed = p if mixed is None else mixed.unionByName(p)
    got = temporal_walk(mixed, graph.series, "x", relation, 3, threshold, semantics).count()
    assert got == sum(walk(graph, nodes, relation, 3, threshold, semantics == "cont") is not None for n in (1, 2, 3) for nodes, _ in brute(n))


def test_counts_are_per_path(graph):
    p = pattern.match(graph, Node(), (Edge(("A",)), Node()))
    assert count_matches(p, graph.series, "x", "equal", 3, -1.0).first().n == temporal_walk(p, graph.series, "x", "equal", 3, -1.0).count() == 4


def test_virtual_edges(graph):
    p = pattern.match(graph, Node(), (Edge(("B",)), Node()))
    w = temporal_walk(p, graph.series, "x", "equal", 3, -1.0, n_hops=1)
    h, v = w.first().hops[0], virtual_edges(w, graph.series, "x", 3, -1.0).first()
    s = {r.node_id: (r.ts, r.v) for r in graph.series.collect()}
    assert [tuple(x) for x in v.source_sub] == list(zip(*(c[h.i : h.i + 3] for c in s[2]))) and [tuple(x) for x in v.target_sub] == list(zip(*(c[h.j : h.j + 3] for c in s[3])))
    assert (v.ts_type, v.sub_length, v.threshold) == ("x", 3, -1.0)


def test_series_of_points_and_lists(spark):
    points = spark.sql("SELECT 1L AS node_id, 'x' AS ts_type, TIMESTAMP'2024-01-02' AS ts, 2 AS v UNION ALL SELECT 1L, 'x', TIMESTAMP'2024-01-01', 1")
    assert from_points(points).first().v == [1.0, 2.0]
    lists = spark.createDataFrame([(1, "['2024-01-01T00:00:00+0000', '2024-01-02']", "[1, , \"2.5\", 9]")], "id long, t string, v string")
    r = from_lists(lists, "x", "t", "v", "id").first()
    assert r.v == [1.0, 2.5] and r.ts[1] - r.ts[0] == DAY
    with pytest.raises(ValueError):
        from_lists(lists.withColumn("v", F.array(F.lit(1))), "x", "t", "v", "id")
    short = spark.createDataFrame([(1, "x", [1, 2], [1.0])], "node_id long, ts_type string, ts array<long>, v array<double>")
    with pytest.raises(Exception, match="fewer values"):
        checked_series(short).collect()


@pytest.mark.parametrize("semantics", ["2cont", "cont"])
@pytest.mark.parametrize("direction", ["out", "any"])
def test_counted_walks_are_the_listed_ones(graph, semantics, direction):
    """With parallel edges, a loop, and, seen from both ends, edges that could be taken twice."""
    edge = Edge((), direction)
    for n, start, through in ((1, Node(), Node()), (2, Node(), Node("P")), (3, Node("P"), Node())) if direction == "any" else ((4, Node(), Node()),):
        listed = temporal_walk(pattern.hops(graph, start, edge, n, through), graph.series, "x", "overlaps", 4, -0.5, semantics, n_hops=n)
        assert count_walks(graph, start, edge, n, through, "x", "overlaps", 4, -0.5, semantics).collect() == [(listed.count(),)]
    assert count_walks(graph, Node("none"), edge, 2, Node(), "x", "overlaps", 4, -0.5, semantics).collect() == [(0,)]


def test_states_not_walks_are_counted(spark):
    """A ladder with 4 parallel edges for each step: 4^4 paths, a row for each node."""
    edges = spark.createDataFrame([(k * 4 + c, k, k + 1, "A") for k in range(5) for c in range(4)], "edge_id long, src long, dst long, type string")
    nodes = spark.createDataFrame([(k, "P") for k in range(6)], "node_id long, label string")
    series = spark.createDataFrame([(k, "x", [i * DAY for i in range(8)], [float(x) for x in (1, 2, 4, 3, 5, 9, 7, 8)]) for k in range(6)], "node_id long, ts_type string, ts array<long>, v array<double>")
    assert count_walks(HybridGraph(nodes, edges, series), Node("P", "node_id = 0"), Edge(), 4, Node(), "x", "equal", 4, 0.9).collect() == [(4**4,)]
    for bad in ({"n_hops": 6}, {"n_hops": 0}, {"semantics": "both"}):
        with pytest.raises(ValueError):
            count_walks(HybridGraph(nodes, edges, series), Node(), Edge(), **({"n_hops": 2} | bad), through=Node(), ts_type="x", relation="equal", w=4)


@pytest.mark.parametrize("blocks", [False, True])
def test_metrics_count_what_a_walk_does(spark, graph, monkeypatch, blocks):
    from loomgraph.operators import tdjoin

    if blocks:
        monkeypatch.setattr(tdjoin, "block_rows", lambda series: 2)
    paths = pattern.hops(graph, Node(), Edge(), 2)
    plain = temporal_walk(paths, graph.series, "x", "overlaps", 4, -0.5, "cont", n_hops=2).collect()
    seen = WalkMetrics(spark)
    assert len(temporal_walk(paths, graph.series, "x", "overlaps", 4, -0.5, "cont", n_hops=2, metrics=seen).collect()) == len(plain)
    first, second = seen.hops().collect()
    assert (first.asked, first.found, second.matched) == (paths.count(), len({r.hops[0].src * 10 + r.hops[0].dst for r in temporal_walk(paths, graph.series, "x", "overlaps", 4, -0.5, "2cont", n_hops=2).collect()} | {12, 22, 23, 31}), len(plain))
    assert second.asked == first.matched and first.pairs >= first.found and first.seconds > 0 and second.seconds > 0
    t = seen.times().first()
    assert t.hops == 2 and t.mean_seconds == pytest.approx((first.seconds + second.seconds) / 2) and t.seconds == pytest.approx(2 * t.mean_seconds)
    both = WalkMetrics(spark)
    temporal_walk(paths, graph.series, "x", "overlaps", 4, -0.5, "2cont", n_hops=2, metrics=both).collect()
    shared, *hops = both.hops().collect()
    assert shared.hop == -1 and shared.pairs >= shared.found > 0 and [h.asked for h in hops][0] == paths.count() and hops[1].asked == hops[0].matched


@pytest.mark.parametrize("apart", [None, "region"])
def test_matches_around_a_hop_are_counted_as_they_are_listed(spark, graph, apart):
    kinds = [("A", 1, 2), ("A", 1, 2), ("A", 3, 2), ("A", 4, 2), ("A", 2, 2), ("A", 2, 3), ("A", 3, 1), ("A", None, 3), ("B", 2, 3), ("B", 2, 3), ("B", 2, 2), ("C", 1, 2), ("C", 4, 2), ("D", 2, 3)]
    edges = spark.createDataFrame([(k, a, b, kind) for k, (kind, a, b) in enumerate(kinds)], "edge_id long, src long, dst long, type string")
    g = HybridGraph(graph.nodes, edges, graph.series)
    near, hop = Edge(("A",)), Edge(("B", "C"))
    both = pattern.both(pattern.match(g, Node(), (near, Node()), (hop, Node())), pattern.match(g, Node(), (near, Node())), {2: 1})
    listed = both.select(F.col("nodes")[1].alias("src"), F.col("nodes")[2].alias("dst"), F.col("nodes")[0].alias("x"), F.col("other_nodes")[0].alias("y"))
    for end in ("x", "y"):
        listed = listed.join(g.nodes.select(F.col("node_id").alias(end), F.col("region").alias(f"of_{end}")), end)
    want = (listed if apart is None else listed.where("of_x <> of_y")).groupBy("src", "dst").count()
    assert want.count() and sorted(map(tuple, pattern.count_around(g, near, hop, apart).collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="none in common"):
        pattern.count_around(g, near, Edge(("A", "B")))


@pytest.mark.parametrize("name", ["sel_owners_any", "sel_owners_differ"])
def test_owners_of_both_ends_are_not_listed(spark, monkeypatch, name):
    from loomgraph.plans import catalogue

    asked = []
    own = catalogue.matching
    monkeypatch.setattr(catalogue, "matching", lambda pairs, *more, **named: (asked.append(pairs), own(pairs, *more, **named))[1])
    found = catalogue.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert found and asked[0].count() == asked[0].select("src", "dst").distinct().count()

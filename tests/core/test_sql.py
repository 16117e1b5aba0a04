import pytest

from loomgraph.operators import pattern, sql
from loomgraph.operators.pattern import Edge, Node
from loomgraph.operators.walk import temporal_walk
from loomgraph.plans.model import HybridGraph

DAY = 86_400_000_000


@pytest.fixture(scope="module")
def graph(spark):
    sql.register(spark)
    edges = spark.createDataFrame([(1, 1, 2), (2, 1, 2), (3, 2, 3), (4, 3, 1), (5, 2, 2), (6, 3, 4)], "edge_id long, src long, dst long").selectExpr("*", "'A' AS type")
    nodes = spark.createDataFrame([(k, "P") for k in range(1, 5)], "node_id long, label string")
    values = {1: [1, 2, 4, 3, 5, 9, 7, 8, 2, 2], 2: [2, 1, 3, 3, 6, 8, 7, 9, 1, 4], 3: [5, 1, 4, 4, 4, 2, 8, 1, 6, 3]}
    rows = [(k, "x", [(i + k) * DAY for i in range(10)], [float(x) for x in v]) for k, v in values.items()]
    return HybridGraph(nodes, edges, spark.createDataFrame(rows, "node_id long, ts_type string, ts array<long>, v array<double>"))


def flat(df, key):
    return sorted((tuple(r[key]), [tuple(h) for h in r["hops"]]) for r in df.collect())


@pytest.mark.parametrize(("semantics", "method"), [("2cont", "td"), ("cont", "td"), ("cont", "stomp"), ("2cont", "stamp")])
def test_walks_in_sql(spark, graph, semantics, method):
    paths = pattern.hops(graph, Node(), Edge(), 2).unionByName(pattern.hops(graph, Node(), Edge(), 1))
    want = flat(temporal_walk(paths, graph.series, "x", "overlaps", 4, -0.5, semantics, method), "edge_ids")
    hops = sql.td_walk_hops(paths, graph.series, "x").withColumnRenamed("nothing", "x").selectExpr("*", "1 AS more")
    hops.createOrReplaceTempView("hops_of_paths")
    got = spark.sql(f"SELECT * FROM temporal_walk(TABLE(hops_of_paths), 'OVERLAPS', 4, -0.5D, '{semantics}', '{method}')")
    assert got.columns == ["path", "hops"] and flat(got, "path") == want and len(want) > 3
    own = spark.sql(f"SELECT * FROM temporal_walk_by(TABLE(hops_of_paths) PARTITION BY (path, more) ORDER BY (hop), 'overlaps', 4, -0.5D, '{semantics}', '{method}')")
    assert flat(own, "path") == want


def test_path_of_any_kind(spark, graph):
    """The result's columns follow the table's."""
    spark.sql("SELECT 'a' AS path, 0 AS hop, 'x' AS src, 'y' AS dst, array(0L, 1L, 2L, 3L) AS ta, array(1D, 2D, 4D, 3D) AS va, array(0L, 1L, 2L, 3L) AS tb, array(2D, 4D, 8D, 6D) AS vb").createOrReplaceTempView("one_hop")
    got = spark.sql("SELECT * FROM temporal_walk(TABLE(one_hop), 'equal', 4, 0.9D, 'cont', 'td')")
    assert dict(got.dtypes)["path"] == "string" and got.collect()[0]["hops"][0].asDict() == {"src": "x", "dst": "y", "i": 0, "j": 0, "dist": 0.0}


@pytest.mark.parametrize(
    ("table", "arguments", "says"),
    [("one_hop", "'after', 4, 0.9D, 'cont', 'td'", "is no relation"), ("one_hop", "'equal', 0, 0.9D, 'cont', 'td'", "w must be"), ("one_hop", "'equal', 4, 0.9D, 'both', 'td'", "semantics"), ("one_hop", "'equal', 4, 0.9D, 'cont', 'x'", "method"), ("no_hops", "'equal', 4, 0.9D, 'cont', 'td'", "no column")],
)
def test_arguments_are_checked_before_anything_runs(spark, graph, table, arguments, says):
    spark.sql("SELECT 'a' AS path, 0 AS hop, 'x' AS src, 'y' AS dst, array(0L) AS ta, array(1D) AS va, array(0L) AS tb, array(2D) AS vb").createOrReplaceTempView("one_hop")
    spark.sql("SELECT 1 AS path, 2 AS hop").createOrReplaceTempView("no_hops")
    with pytest.raises(Exception, match=says):
        spark.sql(f"SELECT * FROM temporal_walk(TABLE({table}), {arguments})")


def test_clear_cache(spark, graph):
    assert spark.sql("SELECT message FROM clear_cache()").collect() == [("Cache cleared",)]


def test_memo_keeps_tables_apart(monkeypatch):
    """Pairs of the same ids with other series are other entries; what was not found is kept too; a full memo starts anew."""
    from pyspark.sql import Row

    sql._memo.clear()
    monkeypatch.setattr(sql, "MEMO", 2)
    row = lambda v: Row(src=1, dst=2, ta=[0, 1, 2, 3], va=[1.0, 2.0, 4.0, 3.0], tb=[0, 1, 2, 3], vb=v)
    assert sql._remembered(row([2.0, 4.0, 8.0, 6.0]), "equal", 4, 0.9, "td", None) == (0, 0, 0.0)
    assert sql._remembered(row([4.0, 3.0, 1.0, 2.0]), "equal", 4, 0.9, "td", None) is None and len(sql._memo) == 2
    assert sql._remembered(row([2.0, 4.0, 8.0, 6.0]), "equal", 4, 0.9, "td", 1) is None and len(sql._memo) == 1
    sql._memo.clear()

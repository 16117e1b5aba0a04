import pytest
from pyspark.sql import functions as F

from loomgraph.operators import pattern, skew
from loomgraph.operators.pattern import Edge, Node
from loomgraph.operators.skew import band_join, salted_join
from loomgraph.operators.tdjoin import td_join
from loomgraph.plans.model import HybridGraph
from loomgraph.session import fresh_path
from loomgraph.sources import loaders


@pytest.fixture(scope="module")
def people(spark):
    """A third of the persons of one name, city and year; some without a city, a name or a date."""
    rows = []
    for k in range(240):
        hot = k % 3 == 0
        rows.append((f"p{k}", "MF"[k % 2], "X" if hot else f"n{k % 5}", "c" if hot else None if k % 17 == 0 else f"c{k % 4}", None if k % 19 == 0 else f"{1940 + (0 if hot and k % 2 else k * 7 % 60)}-05-01"))
    return spark.createDataFrame(rows, "node_id string, gender string, last string, city string, birthdate string").withColumn("birthdate", F.col("birthdate").cast("date")).withColumn("label", F.lit("P"))


def pairs(df):
    return sorted((r.src, r.dst) for r in df.collect())


@pytest.mark.parametrize("rows", [1_000_000, 10, 1])
def test_band_join(spark, monkeypatch, rows):
    a = spark.range(150).selectExpr("id AS a", "if(id % 3 = 0, 0, id % 7) AS k", "id * 3 % 50 - 10 AS y")
    b = spark.range(130).selectExpr("id AS b", "if(id % 3 = 0, 0, id % 9) AS k", "if(id % 13 = 0, null, id * 5 % 60 - 20) AS z")
    for low, high in ((25, 35), (-4, 4), (7, 7)):
        want = sorted(map(tuple, a.join(b, "k").where(f"z - y BETWEEN {low} AND {high}").select("a", "b").collect()))
        assert sorted(map(tuple, band_join(a, b, ["k"], "y", "z", low, high, rows).select("a", "b").collect())) == want and want
    with pytest.raises(ValueError):
        band_join(a, b, ["k"], "y", "z", 3, 2)


def test_frequent_keys_are_cut(spark):
    """A key with all rows, both sides: cells hold a bounded number of rows of each side, and every pair meets once."""
    a = spark.range(100).selectExpr("id AS a", "1 AS k")
    b = spark.range(90).selectExpr("id AS b", "1 AS k")
    joined = salted_join(a, b, ["k"], 10)
    assert joined.count() == 9000 == joined.distinct().count()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "cell_l" in plan and "cell_r" in plan
    assert salted_join(a.limit(0), b, ["k"], 10).count() == 0


def test_derived_edges_with_frequent_names(people, monkeypatch):
    a, b = people.alias("a"), people.alias("b")
    years = F.year("b.birthdate") - F.year("a.birthdate")
    fathers = pairs(a.join(b, F.expr("a.last = b.last AND a.gender = 'M' AND a.node_id <> b.node_id")).where(years.between(25, 35)).selectExpr("a.node_id AS src", "b.node_id AS dst"))
    mates = pairs(a.join(b, F.expr("a.city = b.city AND year(a.birthdate) = year(b.birthdate) AND a.node_id <> b.node_id")).selectExpr("a.node_id AS src", "b.node_id AS dst"))
    for rows in (1_000_000, 7):
        monkeypatch.setattr(skew, "CELL_ROWS", rows)
        assert pairs(loaders.father_of(people)) == fathers and pairs(loaders.classmates(people)) == mates
    assert len(mates) > 1000


def test_patterns_over_groups_are_those_over_edges(spark, people, monkeypatch):
    monkeypatch.setattr(skew, "CELL_ROWS", 20)
    some = people.where("cast(substr(node_id, 2) AS int) < 60")
    fathers = loaders.father_of(some)
    stored = HybridGraph(some, fathers.unionByName(loaders.classmates(some)), None)
    implied = HybridGraph(some, fathers.unionByName(loaders.classes(some)), None)
    assert implied.edges.where("type = 'IN_CLASS'").count() <= some.count()
    real, via = Edge(("WAS_CLASSMATE_OF",)), Edge(("WAS_CLASSMATE_OF",), via="IN_CLASS")
    key = lambda df: sorted((tuple(r.nodes), tuple(r.edge_ids)) for r in df.collect())
    man = Node("P", "gender = 'M'")
    assert key(pattern.match(implied, man, (via, Node()))) == key(pattern.match(stored, man, (real, Node())))
    father = Edge(("FATHER_OF",))
    assert key(pattern.match(implied, Node(), (father, Node()), (via, man))) == key(pattern.match(stored, Node(), (father, Node()), (real, man)))
    assert key(pattern.match(implied, man, (via, Node("P", "gender = 'F'")), (via, man))) == key(pattern.match(stored, man, (real, Node("P", "gender = 'F'")), (real, man)))
    with pytest.raises(ValueError):
        pattern.match(implied, man, (Edge(("WAS_CLASSMATE_OF",), "any", "IN_CLASS"), Node()))


def test_bucketed_series_do_not_move(spark):
    day = 86_400_000_000
    series = spark.range(60).selectExpr("id AS node_id", "'x' AS ts_type", f"transform(sequence(0L, 19L), k -> k * {day}L) AS ts", "transform(sequence(0L, 19L), k -> cast((k * (id + 3)) % 7 AS double)) AS v")
    edges = spark.range(300).selectExpr("id AS edge_id", "id % 60 AS src", "(id * 7) % 60 AS dst", "'A' AS type")
    nodes = spark.range(60).selectExpr("id AS node_id", "'P' AS label")
    g = loaders.write_bucketed(HybridGraph(nodes, edges, series), "bucketed_test", 4, fresh_path(spark, "bucketed"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = td_join(g.edges, g.series, "x", "overlaps", 5, 0.2)
        plan = joined._jdf.queryExecution().executedPlan().toString().splitlines()
        scans = [n for n, line in enumerate(plan) if "bucketed_test_series" in line]
        assert len(scans) == 2
        deep = lambda line: len(line) - len(line.lstrip(" :+-|"))
        for n in scans:  # from a scan up to its join there is no exchange
            assert "Bucketed: true" in plan[n]
            above, at = [], n
            while "Join" not in plan[at]:
                at = next(k for k in range(at - 1, -1, -1) if deep(plan[k]) < deep(plan[at]))
                above.append(plan[at])
            assert above and not any("Exchange" in line for line in above)
        got = sorted(map(str, joined.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == sorted(map(str, td_join(edges, series, "x", "overlaps", 5, 0.2).collect())) and got
    for part in ("nodes", "edges", "series"):
        spark.sql(f"DROP TABLE bucketed_test_{part}")

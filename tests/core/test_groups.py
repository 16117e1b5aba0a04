import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import groups, kernel
from loomgraph.operators.groups import matching_groups
from loomgraph.operators.relations import Relation
from loomgraph.operators.walk import matching
from loomgraph.plans import catalogue
from loomgraph.sources import loaders

DAY = 86_400_000_000
SMOKE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("relation", list(Relation))
@pytest.mark.parametrize(("threshold", "offset"), [(-1.0, 0), (0.0, -3), (0.5, 2), (0.9, 0), (0.999999, 0)])
def test_matrix_of_matches(monkeypatch, relation, threshold, offset):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (40, 16)).astype(float), np.round(rng.normal(0, 1e3, (50, 13)), 1)
    a[3], b[4], a[5, 7], b[6, 2], b[7] = 4.0, 0.0, np.nan, np.inf, a[0, :13]  # constant, odd and copied series
    ia, ib = (k.ravel() for k in np.indices((40, 50)))
    for m in (3, 6):
        want = kernel.grid_join(a, b, m, relation, offset, threshold, ia, ib).i.reshape(40, 50) >= 0
        for side, dear in ((512, 1 << 13), (7, 1), (512, 1 << 40), (512, 1e-9)):
            monkeypatch.setattr(kernel, "SIDE", side)
            monkeypatch.setattr(kernel, "DEAR", dear)
            assert (kernel.grid_match(a, b, m, relation, offset, threshold) == want).all()
    monkeypatch.setattr(kernel, "LONG", 10)
    assert (kernel.grid_match(a, b, 6, relation, offset, threshold) == want).all()


@pytest.mark.parametrize("relation", ["before", "overlaps", "none"])
def test_groups_match_as_their_pairs(spark, monkeypatch, relation):
    rng = np.random.default_rng(2)
    rows = [(k, "x", [(k % 3 + p * (1 + k % 2)) * DAY for p in range(n)], [float(v) for v in rng.integers(0, 9, n)]) for k in range(60) for n in [8 + k % 4]]
    series = spark.createDataFrame(rows, "node_id long, ts_type string, ts array<long>, v array<double>").cache()
    people = spark.createDataFrame([(k, None if k == 7 else "ab"[k % 2], None if k == 9 else k % 5) for k in range(70)], "node_id long, key string, at int")
    a, b = people.where("node_id % 4 < 3").withColumnRenamed("node_id", "src"), people.selectExpr("node_id AS dst", "key", "at AS value")
    monkeypatch.setattr(groups, "CELL_NODES", 4)
    pairs = a.join(b, "key").where("value - at BETWEEN 1 AND 2 AND src <> dst")
    for low, high, own in ((1, 2, pairs), (0, 0, a.join(b, "key").where("value = at AND src <> dst"))):
        want = sorted(map(tuple, matching(own.select("src", "dst"), series, "x", relation, 4, 0.5).collect()))
        assert want and sorted(map(tuple, matching_groups(a, b, ["key"], series, "x", relation, 4, 0.5, low, high).collect())) == want
    assert matching_groups(a, b, ["key"], series, "x", relation, 2, 0.5).count() == 0


@pytest.mark.parametrize("name", ["sel_classmates", "sel_mothers", "sel_fathers"])
def test_pairs_of_groups_are_not_written_out(spark, name):
    plan = catalogue.queries()[name](spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "\nMapInArrow" not in plan and "- MapInArrow" not in plan


@pytest.mark.parametrize(("low", "high"), [(25, 35), (-3, 30)])
def test_sides_of_mothers_are_their_edges(spark, low, high):
    rows = [(k, "M" if k % 2 == 0 else "F", None if k == 8 else f"l{k % 3}", None if k == 11 else f"c{k % 5 % 3}", None if k == 12 else f"{1940 + k * 7 % 60}-05-01") for k in range(90)]
    rows += [(200, "M", "alone", "c1", "1990-01-01"), (201, "M", "two", "c1", "1990-01-01"), (202, "M", "two", "c1", "1990-03-01")]
    people = spark.createDataFrame(rows, "node_id long, gender string, last string, city string, birthdate string").withColumn("birthdate", F.col("birthdate").cast("date")).cache()
    women, children = loaders.mother_sides(people, low, high)
    got = women.join(children, "city").where(f"value - at BETWEEN {low} AND {high}").select("src", "dst")
    want = loaders.mother_of(people, loaders.father_of(people, low, high), low, high).select("src", "dst")
    assert want.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

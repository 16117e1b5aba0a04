import importlib
import importlib.util

import duckdb
import pytest

import __spark_entry__ as entry
from loomgraph.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    r = duck.sql(entry.oracle_sql()[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(x[k]) for k in at) for x in r.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_repeats_itself(spark, name):
    one, two = (sorted(map(str, entry.queries()[name](spark, SMALL).collect())) for _ in range(2))
    assert one == two and one


def test_every_edge_is_classified(spark):
    assert "src < 5" not in entry.oracle_sql()["stamp_classify"]
    assert len({r.src for r in entry.queries()["stamp_classify"](spark, SMALL).collect()}) > 5


def test_entry(spark):
    assert entry.entry(spark).columns == ["relation", "n"] and entry.entry(spark).count() == 4


def test_the_rest_works_without_the_llm_subpackage(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("loomgraph.llm", "corpus_pipeline")) else real(name, *a))
    assert set(entry.queries()) == set(catalogue.queries()) and set(entry.oracle_sql()) == set(catalogue.oracle_sql())


def test_nothing_else_imports_the_llm_subpackage():
    from pathlib import Path

    top = Path(entry.__file__).parent
    for p in [*(top / "loomgraph").rglob("*.py"), top / "bench.py"]:
        if "llm" not in p.parts:
            assert "loomgraph.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p

import json
import random

import pytest

from loomgraph.sources.json_array import read_json_array

SCHEMA = "id long, s string, ts struct<a: array<struct<Start: string, Value: double>>, b: array<double>>"


def items(n):
    rnd = random.Random(n)
    texts = ["plain", "} {", '"', "\\", '\\"}', "[{]", "ü日本", "a\nb\t}", "", "}}}}", "\\\\", '{"id": 5}']
    return [{"id": k, "s": rnd.choice(texts) + rnd.choice(texts), "ts": {"a": [{"Start": f"}}{k}", "Value": j + 0.5} for j in range(rnd.randint(0, 4))], "b": [1.0] * rnd.randint(0, 3)}} for k in range(n)]


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, str(v)) for k, v in zip(kept, (n, 1))]
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("indent", "separators"), [(None, (",", ":")), (2, None)])
def test_the_same_rows_however_it_is_cut(spark, tmp_path, small_splits, indent, separators):
    (tmp_path / "x.json").write_text(json.dumps(items(40), indent=indent, separators=separators, ensure_ascii=False))
    (tmp_path / "y.json").write_text(json.dumps(items(7), indent=indent, ensure_ascii=True) + "\n")
    (tmp_path / "z.json").write_text(" [ ]\n")
    want = rows(spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path)))
    assert len(want) == 47
    for size in (97, 1000, 1 << 20):  # splits within elements, strings and escapes; of several elements; of several files
        small_splits(size)
        assert rows(read_json_array(spark, str(tmp_path), SCHEMA)) == want


def test_one_array_in_many_tasks(spark, tmp_path, small_splits):
    (tmp_path / "x.json").write_text(json.dumps(items(3000)))
    small_splits(20_000)
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "x.json")).rdd.getNumPartitions() >= 8
    got = read_json_array(spark, str(tmp_path / "x.json"), "id long")
    assert sorted(r.id for r in got.collect()) == list(range(3000))


def test_missing_and_odd_fields(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"id": 1, "more": [{"x": {}}]}, {"id": "no", "s": "t"}, {}]')
    assert rows(read_json_array(spark, str(tmp_path), "id long, s string")) == ["Row(id=1, s=None)", "Row(id=None, s='t')", "Row(id=None, s=None)"]

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import analytics
from loomgraph.functions import series as fn
from loomgraph.operators import sql
from loomgraph.operators.tdjoin import td_join
from loomgraph.sources import loaders, synthetic
from loomgraph.streaming.append import append_points, read_series, windowed_means

DAY = 86_400_000_000


def test_bank_files(spark, tmp_path):
    (tmp_path / "Account.csv").write_text("accountId|createTime|isBlocked|accountType|nickname|phonenum|email|freqLoginType|lastLoginTime|accountLevel\n1|2022-01-02 03:04:05|true|a|b|c|d|e|1641092645000|Gold level\n2|bad|maybe||||||x|\n")
    (tmp_path / "Loan.csv").write_text("loanId|loanAmount|balance|createTime|loanUsage|interestRate\n5|10.5|1|2022-01-02 03:04:05|car|0.1\n")
    (tmp_path / "AccountTransferAccount.csv").write_text("fromId|toId|amount|createTime|orderNum|comment|payType|goodsType\n1|2|9.5|2022-01-02 03:04:05|7|x|y|z\n1|2|9.5|2022-01-02 03:04:05|7|x|y|z\n1|3|1|2022-01-02 03:04:05|7|x|y|z\n")
    (tmp_path / "b.csv").write_text("id,balance_timestamps,balance_values\n1,\"['2022-01-03T00:00:00+0000', '2022-01-04T00:00:00+0000']\",\"[1.5, 2.5]\"\n")
    a = {r.node_id: r for r in loaders.bank_nodes(spark, str(tmp_path), "Account").collect()}
    one, two = a["Account:1"], a["Account:2"]
    assert one.isBlocked is True and str(one.createTime) == str(one.lastLoginTime) == "2022-01-02 03:04:05"
    assert two.createTime is None and two.isBlocked is None and two.lastLoginTime is None
    assert loaders.bank_nodes(spark, str(tmp_path), "Loan").first().flow_rate == "constant"
    nodes = {"Account": loaders.bank_nodes(spark, str(tmp_path), "Account")}
    e = loaders.bank_edges(spark, str(tmp_path), "AccountTransferAccount", nodes).collect()
    assert [(r.src, r.dst, r.type, r.amount) for r in e] == [("Account:1", "Account:2", "Transfer", 9.5)] * 2 and len({r.edge_id for r in e}) == 2
    s = loaders.bank_balances(spark, str(tmp_path / "b.csv")).first()
    assert (s.node_id, s.ts_type, s.v, s.ts[1] - s.ts[0]) == ("Account:1", "balance", [1.5, 2.5], DAY)


def test_patients(spark, tmp_path):
    (tmp_path / "o.csv").write_text("DATE,PATIENT,DESCRIPTION,VALUE\n2020-01-02,p,bmi,2.5\n2020-01-01,p,bmi,1.5\n2020-01-01,p,other,9\n")
    o = loaders.read_delimited(spark, str(tmp_path / "o.csv"), "DATE string, PATIENT string, DESCRIPTION string, VALUE double")
    g = loaders.group_observations(o, "bmi", "bmi").first()
    assert json.loads(g.bmi_values) == [1.5, 2.5] and json.loads(g.bmi_timestamps)[0] == "2020-01-01"
    cells = {f"{v}_{k}": "[]" for v in loaders.VITALS for k in ("timestamps", "values")} | {"bmi_timestamps": g.bmi_timestamps, "bmi_values": g.bmi_values}
    spark.createDataFrame([("p", *cells.values())], ["patient", *cells]).coalesce(1).write.option("header", True).option("escape", "\"").csv(str(tmp_path / "t"))
    s = {r.ts_type: r.v for r in loaders.patient_series(spark, str(tmp_path / "t")).collect()}
    assert s["bmi"] == [1.5, 2.5] and s["heartRate"] == []
    (tmp_path / "p.csv").write_text("Id,BIRTHDATE,DEATHDATE,SSN,PREFIX,FIRST,LAST,RACE,ETHNICITY,GENDER,ADDRESS,CITY,STATE,COUNTY,ZIP,HEALTHCARE_COVERAGE,INCOME\n" + "\n".join(f"{n},{y}-05-01,,,,A,{last},,,{g},,{c},,,1,1,1" for n, y, last, g, c in [("f", 1960, "X", "M", "u"), ("c", 1990, "X", "F", "u"), ("m", 1962, "Y", "F", "u"), ("d", 1990, "Z", "M", "u"), ("e", 1999, "X", "F", "v")]))
    p = loaders.patients(spark, str(tmp_path / "p.csv"))
    fathers = loaders.father_of(p)
    pairs = lambda df: sorted((r.src, r.dst) for r in df.collect())
    assert pairs(fathers) == [("f", "c")] and pairs(loaders.mother_of(p, fathers)) == [("m", "c")] and pairs(loaders.classmates(p)) == [("c", "d"), ("d", "c")]


def test_stations_and_trips(spark, tmp_path):
    points = [{"Start": f"2024-01-01T{h:02d}:00:00", "Value": h} for h in range(6)]
    (tmp_path / "s.json").write_text(json.dumps([{"station_id": "a", "region_id": "1", "lat": 1.5, "start": "2024-01-01T00:00:00", "ts": {"num_bikes_available": points}}]))
    trip = {"from": "a", "to": "a", "start": "x", "end": "y", "ts": {"num_bikes": points[:2]}}
    (tmp_path / "t.json").write_text(json.dumps([trip, trip]))
    nodes, series = loaders.stations(spark, str(tmp_path / "s.json"), 4)
    assert nodes.first().lat == 1.5 and [(r.ts_type, r.v) for r in series.collect()] == [("num_bikes_available", [0.0, 1.0, 2.0, 3.0])]
    edges, series = loaders.trips(spark, str(tmp_path / "t.json"))
    assert edges.count() == 1 and series.first().v == [0.0, 1.0] and edges.first().start is None


def test_graph_files_and_results(spark, tmp_path):
    n = spark.createDataFrame([(1, "A")], "node_id long, label string")
    e = spark.createDataFrame([(1, 1, 1, "T")], "edge_id long, src long, dst long, type string")
    s = spark.createDataFrame([(1, "x", [1], [1.0])], "node_id long, ts_type string, ts array<long>, v array<double>")
    for _ in range(2):
        loaders.write_graph(n, e, s, str(tmp_path))
    plan = spark.read.parquet(str(tmp_path / "series")).where("ts_type = 'x'")
    assert plan.count() == 1 and "PartitionFilters: [isnotnull(ts_type" in plan._jdf.queryExecution().toString()
    for _ in range(2):
        loaders.append_results(n, str(tmp_path / "r"))
    assert spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "r")).count() == 2


def test_balances(spark):
    a = spark.createDataFrame([(k, synthetic.LEVELS[k % 6][0]) for k in range(12)], "node_id long, level string")
    one = {r.node_id: r for r in synthetic.balances(a).collect()}
    two = {r.node_id: r for r in synthetic.balances(a.repartition(5)).collect()}
    assert one == two and all(len(r.v) == 252 and r.v[0] == synthetic.LEVELS[k % 6][1] for k, r in one.items())
    gaps = {(y - x) // DAY for x, y in zip(one[0].ts, one[0].ts[1:])}
    assert gaps == {1, 3} and len({tuple(r.v) for r in one.values()}) == 12
    with pytest.raises(Exception, match="unknown account level"):
        synthetic.balances(a.withColumn("level", F.lit("None"))).collect()
    many = spark.range(4000).withColumnRenamed("id", "node_id")
    assert abs(synthetic.half(many).count() - 2000) < 150


def test_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 2.0, 2.0], [0, DAY], "1.5M")], "a array<double>, b array<double>, t array<long>, label string")
    r = df.select(
        fn.z_normalised(F.col("a")).alias("za"), fn.z_normalised(F.col("b")).alias("zb"), fn.cosine(F.col("a"), fn.z_normalised(F.col("b"))).alias("c0"), fn.euclidean(F.col("a"), F.col("b")).alias("e"),
        fn.granularity(F.col("t")).alias("g"), fn.granularity(F.slice("t", 1, 1)).alias("g1"), fn.round_half_up(F.lit(-0.000015)).alias("r"), analytics.parse_size(F.col("label")).alias("n"),
        fn.parse_list(F.lit("[1, x, '', 2.5]")).alias("p"), analytics.parse_size(F.lit("5k")).alias("k"), analytics.parse_size(F.lit("big")).alias("none"),
    ).first()
    assert r.za[1] == 0 and r.za[2] == -r.za[0] == pytest.approx(1.5**0.5) and r.zb == [0.0] * 3 and r.c0 == 0 and r.e == pytest.approx(2**0.5)
    assert (r.g, r.g1, r.n, r.p, r.k, r.none) == ("DAYS", None, 1_500_000, [1.0, None, 2.5], 5000, None) and r.r == pytest.approx(-0.00001)
    with pytest.raises(ValueError):
        fn.round_half_up(F.lit(1.0), -1)


def test_table_function_equals_the_operator(spark):
    rows = [(k, "x", [i * DAY for i in range(9)], [float((i * (k + 2)) % 5) for i in range(9)]) for k in range(5)]
    s = spark.createDataFrame(rows, "node_id long, ts_type string, ts array<long>, v array<double>")
    p = spark.createDataFrame([(a, b) for a in range(5) for b in range(5)], "src long, dst long")
    sql.register(spark)
    s.createOrReplaceTempView("series_")
    p.createOrReplaceTempView("pairs_")
    for method in ("td", "stamp"):
        got = spark.sql(f"SELECT p.src, p.dst, h.i, h.j, h.dist FROM pairs_ p JOIN series_ a ON a.node_id = p.src JOIN series_ b ON b.node_id = p.dst, LATERAL td_join(a.ts, a.v, b.ts, b.v, 'overlaps', 4, 0.2D, '{method}') h")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, td_join(p, s, "x", "overlaps", 4, 0.2, method).drop("pin").collect()))
    cache = sql.SeriesCache()
    assert cache.series(s, "x").count() == 5 and cache.series(s, "x") is cache.series(s, "x") and cache.clear() == "Cache cleared"


def test_points_arrive_as_a_stream(spark, tmp_path):
    points = spark.sql("SELECT 1L AS node_id, 'x' AS ts_type, TIMESTAMP'2024-01-01' + make_dt_interval(0, cast(id AS int)) AS ts, cast(id AS double) AS v FROM range(48)")
    points.union(points).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    append_points(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert read_series(spark, str(tmp_path / "out"), "x").first().v == [float(k) for k in range(48)]
    assert len(read_series(spark, str(tmp_path / "out"), "x", "2024-01-02").first().v) == 24
    q = windowed_means(stream, "12 hours").writeStream.format("memory").queryName("means_").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.v, r.n) for r in spark.sql("SELECT * FROM means_ ORDER BY start").collect()][:2] == [(5.5, 24), (17.5, 24)]


def test_the_cache_never_gives_another_tables_rows(spark):
    cache = sql.SeriesCache()
    for k in range(30):
        table = spark.createDataFrame([(k, "x", [k], [float(k)])], "node_id long, ts_type string, ts array<long>, v array<double>")
        assert cache.series(table, "x").first().node_id == k
        del table
    cache.clear()


def _write(df, path, sep):
    df.coalesce(1).toPandas().to_csv(path, sep=sep, index=False)


def test_a_whole_bank(spark, tmp_path):
    folder, sf = str(tmp_path), "/root/testdata/sf0.001"
    keep = {"long": "l_orderkey % 40", "double": "l_extendedprice", "timestamp": "date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss')", "string": "concat('t', l_linenumber)", "boolean": "l_linenumber = 1", "millis": "unix_millis(cast(l_shipdate AS timestamp))"}
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").limit(300)
    for label, (key, columns) in loaders.BANK_NODES.items():
        kinds = [c for c in loaders._kinds(columns) if c[0] != key]
        rows = spark.range(30).join(lines.limit(1))
        _write(rows.selectExpr(f"id AS {key}", *[f"{keep[k]} AS {n}" for n, k in kinds]), f"{folder}/{label}.csv", "|")
    for file, (_, _, a, _, b, more) in loaders.BANK_EDGES.items():
        rows = lines.selectExpr(f"l_orderkey % 40 AS {a}", f"l_partkey % 33 AS {b}", *[f"{keep[k]} AS {n}" for n, k in loaders._kinds(more)])
        _write(rows.union(rows.limit(2)), f"{folder}/{file}.csv", "|")
    _write(spark.sql("SELECT id, \"['2024-01-01T00:00:00+0000', '2024-01-02T00:00:00+0000']\" AS balance_timestamps, concat('[1.5, ', id, ']') AS balance_values FROM range(15)"), f"{folder}/account_balances.csv", ",")
    g = loaders.bank(spark, folder)
    assert g.nodes.count() == 150 and g.series.count() == 15
    edges = g.edges.select("edge_id", "src", "dst", "type").collect()
    want = lines.where("l_orderkey % 40 < 30 AND l_partkey % 33 < 30").count()
    assert 13 * want <= len(edges) <= 13 * (want + 2) and len({e.edge_id for e in edges}) == len(edges)
    assert sorted(edges) == sorted(loaders.bank(spark, folder).edges.select("edge_id", "src", "dst", "type").repartition(7).collect())


def test_trips_of_known_stations(spark, tmp_path):
    import json

    point = lambda v: [{"Start": "2024-01-01T00:00:00", "Value": v}]
    series = lambda names, v: {n: point(v) for n in names}
    stations = [{"station_id": s, "name": s, "capacity": 3, "lat": 1.0, "lon": 2.0, "start": "2024-01-01", "end": "2024-02-01", "ts": series(loaders.STATION_SERIES, 1.0)} for s in "ab"]
    trips = [{"from": a, "to": b, "start": "2024-01-01", "end": "2024-01-02", "ts": series(loaders.TRIP_SERIES, v)} for a, b, v in (("a", "b", 7.0), ("a", "b", 5.0), ("b", "x", 1.0), ("x", "a", 1.0), ("b", "a", 2.0))]
    (tmp_path / "nodes.json").write_text(json.dumps(stations))
    (tmp_path / "edges.json").write_text(json.dumps(trips))
    g = loaders.bikes(spark, str(tmp_path))
    assert sorted((e.src, e.dst) for e in g.edges.collect()) == [("a", "b"), ("b", "a")]
    assert {tuple(r.v) for r in g.series.where("ts_type = 'num_bikes'").collect()} == {(5.0,), (2.0,)} and g.series.where("node_id = 'a'").count() == 4

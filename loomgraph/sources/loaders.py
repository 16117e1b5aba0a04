"""Readers for the dataset families, derived edges, and the result writer.

Schemas are given, never inferred; bad values become null. Keys that must resolve are inner-joined, so edges of unknown
ends are dropped. Spark's readers split files into partitions by themselves; there is no batch size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.skew import band_join, salted_join
from loomgraph.plans.model import HybridGraph, first_points, from_lists
from loomgraph.sources.json_array import read_json_array

STAMP = "yyyy-MM-dd HH:mm:ss"

# The file formats and the names in them.
#: Bank graph: node files as (file, label, key, columns with kinds), `|`-separated with a header.
BANK_NODES = {
    "Account": ("accountId", "accountId long, createTime timestamp, isBlocked boolean, accountType string, nickname string, phonenum string, email string, freqLoginType string, lastLoginTime millis, accountLevel string"),
    "Company": ("companyId", "companyId long, companyName string, isBlocked boolean, createTime timestamp, country string, city string, business string, description string, url string"),
    "Loan": ("loanId", "loanId long, loanAmount double, balance double, createTime timestamp, loanUsage string, interestRate double"),
    "Medium": ("mediumId", "mediumId long, mediumType string, isBlocked boolean, createTime timestamp, lastLoginTime millis, riskLevel string"),
    "Person": ("personId", "personId long, personName string, isBlocked boolean, createTime timestamp, gender string, birthday timestamp, country string, city string"),
}
#: Edge files: (type, source label, source key, target label, target key, other columns).
BANK_EDGES = {
    "AccountRepayLoan": ("Repay", "Account", "accountId", "Loan", "loanId", "amount double, createTime timestamp"),
    "LoanDepositAccount": ("Deposit", "Loan", "loanId", "Account", "accountId", "amount double, createTime timestamp"),
    "AccountTransferAccount": ("Transfer", "Account", "fromId", "Account", "toId", "amount double, createTime timestamp, orderNum long, comment string, payType string, goodsType string"),
    "AccountWithdrawAccount": ("Withdraw", "Account", "fromId", "Account", "toId", "amount double, createTime timestamp"),
    "CompanyApplyLoan": ("Apply", "Company", "companyId", "Loan", "loanId", "createTime timestamp, org string"),
    "PersonApplyLoan": ("Apply", "Person", "personId", "Loan", "loanId", "createTime timestamp, org string"),
    "CompanyGuaranteeCompany": ("Guarantee", "Company", "fromId", "Company", "toId", "createTime timestamp, relation string"),
    "PersonGuaranteePerson": ("Guarantee", "Person", "fromId", "Person", "toId", "createTime timestamp, relation string"),
    "CompanyInvestCompany": ("Invest", "Company", "investorId", "Company", "companyId", "createTime timestamp, ratio double"),
    "PersonInvestCompany": ("Invest", "Person", "investorId", "Company", "companyId", "createTime timestamp, ratio double"),
    "CompanyOwnAccount": ("Own", "Company", "companyId", "Account", "accountId", "createTime timestamp"),
    "PersonOwnAccount": ("Own", "Person", "personId", "Account", "accountId", "createTime timestamp"),
    "MediumSignInAccount": ("SignIn", "Medium", "mediumId", "Account", "accountId", "createTime timestamp, location string"),
}
PATIENT = "Id string, BIRTHDATE date, DEATHDATE date, SSN string, PREFIX string, FIRST string, LAST string, RACE string, ETHNICITY string, GENDER string, ADDRESS string, CITY string, STATE string, COUNTY string, ZIP long, HEALTHCARE_COVERAGE double, INCOME double"
VITALS = ("bodyHeight", "bmi", "respiratoryRate", "heartRate", "bodyWeight")
STATION_SERIES = ("num_bikes_available", "num_docks_disabled", "num_bikes_disabled", "num_ebikes_available")
TRIP_SERIES = ("num_bikes", "member_ride", "casual_ride", "classic_ride", "electric_ride", "active_trips")


def _kinds(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in columns.split(", ")]


def typed(text: DataFrame, columns: str) -> DataFrame:
    """Text columns cast to their kinds, null where a value is bad; millis is a timestamp in milliseconds."""

    def cast(name: str, kind: str) -> F.Column:
        c = F.col(name)
        if kind == "millis":
            return F.timestamp_millis(c.try_cast("long"))
        return F.try_to_timestamp(c, F.lit(STAMP)) if kind == "timestamp" else c.try_cast(kind)

    return text.select(*[cast(n, k).alias(n) for n, k in _kinds(columns)])


def read_delimited(spark: SparkSession, path: str, columns: str, sep: str = ",") -> DataFrame:
    """A delimited file with a header, by column name."""
    raw = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("inferSchema", False).csv(path)
    return typed(raw, columns)


def bank_nodes(spark: SparkSession, folder: str, label: str) -> DataFrame:
    key, columns = BANK_NODES[label]
    rows = read_delimited(spark, f"{folder}/{label}.csv", columns, "|")
    rows = rows.withColumn("flow_rate", F.lit("constant")) if label == "Loan" else rows
    return rows.select(F.concat_ws(":", F.lit(label), F.col(key)).alias("node_id"), F.lit(label).alias("label"), "*")


def bank_edges(spark: SparkSession, folder: str, file: str, nodes: dict[str, DataFrame] | None = None) -> DataFrame:
    """Edges of one file; with nodes by label, only those whose ends exist. Every row is an edge of its own.

    edge_id is the hash of the row's values and its number among equal rows: the same whenever the file is read."""
    kind, a, ka, b, kb, more = BANK_EDGES[file]
    rows = read_delimited(spark, f"{folder}/{file}.csv", f"{ka} long, {kb} long, {more}", "|")
    values = rows.columns
    rows = rows.groupBy(*values).agg(F.count(F.lit(1)).cast("int").alias("equal_")).withColumn("nth_", F.explode(F.sequence(F.lit(1), F.col("equal_"))))
    # two hashes: 64 bits alone would meet by chance among some billions of edges
    number = F.concat_ws("-", F.hex(F.xxhash64(*values)), F.hex(F.xxhash64(F.lit(1), *values)), "nth_")
    rows = rows.select(number.alias("number_"), F.concat_ws(":", F.lit(a), F.col(ka)).alias("src"), F.concat_ws(":", F.lit(b), F.col(kb)).alias("dst"), F.lit(kind).alias("type"), *[n for n, _ in _kinds(more)])
    for side, label in (("src", a), ("dst", b)):
        if nodes is not None:
            rows = rows.join(nodes[label].select(F.col("node_id").alias(side)), side)
    return rows.withColumn("edge_id", F.concat_ws("#", F.lit(file), "number_")).drop("number_")


def bank_balances(spark: SparkSession, path: str) -> DataFrame:
    rows = read_delimited(spark, path, "id long, balance_timestamps string, balance_values string")
    return from_lists(rows.withColumn("id", F.concat_ws(":", F.lit("Account"), F.col("id"))), "balance", "balance_timestamps", "balance_values", "id")


def patients(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, PATIENT).select(F.col("Id").alias("node_id"), F.lit("Patient").alias("label"), *[F.col(n).alias(n.lower()) for n, _ in _kinds(PATIENT)[1:]])


def patient_series(spark: SparkSession, path: str) -> DataFrame:
    names = "patient string, " + ", ".join(f"{v}_timestamps string, {v}_values string" for v in VITALS)
    rows, out = read_delimited(spark, path, names), None
    for v in VITALS:
        one = from_lists(rows, v, f"{v}_timestamps", f"{v}_values", "patient")
        out = one if out is None else out.unionByName(one)
    return out


def group_observations(observations: DataFrame, description: str, ts_type: str) -> DataFrame:
    """(patient, <type>_timestamps, <type>_values) as JSON lists of one kind of observation, by time."""
    o = observations.where((F.col("DESCRIPTION") == description) & F.col("VALUE").isNotNull())
    o = o.groupBy(F.col("PATIENT").alias("patient")).agg(F.sort_array(F.collect_list(F.struct("DATE", "VALUE"))).alias("points"))
    return o.select("patient", F.to_json(F.col("points.DATE")).alias(f"{ts_type}_timestamps"), F.to_json(F.col("points.VALUE")).alias(f"{ts_type}_values"))


def _nested(name: str) -> str:
    return f"{name}: array<struct<Start: string, Value: double>>"


STATION = "station_id string, nodeid string, name string, short_name string, region_id string, capacity long, lat double, lon double, start string, end string, ts struct<" + ", ".join(map(_nested, STATION_SERIES)) + ">"
TRIP = "`from` string, `to` string, start string, end string, ts struct<" + ", ".join(map(_nested, TRIP_SERIES)) + ">"


def _unnest(rows: DataFrame, owner: str, names: tuple[str, ...], points: int) -> DataFrame:
    out = None
    for n in names:
        one = rows.where(F.col("ts")[n].isNotNull()).select(F.col(owner).alias("node_id"), F.lit(n).alias("ts_type"), F.transform(F.col("ts")[n]["Start"], lambda x: F.unix_micros(x.try_cast("timestamp"))).alias("ts"), F.col("ts")[n]["Value"].alias("v"))
        out = one if out is None else out.unionByName(one)
    return first_points(out, points)


def stations(spark: SparkSession, path: str, points: int = 500) -> tuple[DataFrame, DataFrame]:
    """(nodes, series) of a JSON array of stations."""
    rows = read_json_array(spark, path, STATION)
    nodes = rows.select(F.col("station_id").alias("node_id"), F.lit("Station").alias("label"), "nodeid", "name", "short_name", "region_id", "capacity", "lat", "lon", F.col("start").try_cast("timestamp").alias("start"), F.col("end").try_cast("timestamp").alias("end"))
    return nodes, _unnest(rows, "station_id", STATION_SERIES, points)


def trips(spark: SparkSession, path: str, points: int = 500, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, series of the edges): one edge for each (from, to, start, end), of repeats the row of the least series.

    With nodes (node_id), only edges whose stations both exist."""
    key = ["from", "to", "start", "end"]
    rows = read_json_array(spark, path, TRIP).groupBy(*key).agg(F.min("ts").alias("ts"))
    for end in ("from", "to") if nodes is not None else ():
        rows = rows.join(nodes.select(F.col("node_id").alias(end)).distinct(), end, "left_semi")
    rows = rows.withColumn("edge_id", F.concat_ws("|", *key))
    edges = rows.select("edge_id", F.col("from").alias("src"), F.col("to").alias("dst"), F.lit("SUPER_EDGE").alias("type"), F.col("start").try_cast("timestamp").alias("start"), F.col("end").try_cast("timestamp").alias("end"))
    return edges, _unnest(rows, "edge_id", TRIP_SERIES, points)


def _together(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def bank(spark: SparkSession, folder: str, balances: str = "account_balances.csv") -> HybridGraph:
    """The whole bank graph of a folder: five node files, thirteen edge files, the accounts' balances."""
    nodes = {label: bank_nodes(spark, folder, label) for label in BANK_NODES}
    edges = [bank_edges(spark, folder, file, nodes) for file in BANK_EDGES]
    # columns of one name have one kind only within a label; the graph's are texts where kinds differ
    kinds: dict[str, set[str]] = {}
    for df in nodes.values():
        for name, kind in df.dtypes:
            kinds.setdefault(name, set()).add(kind)
    plain = [df.select(*[F.col(c).cast("string").alias(c) if len(kinds[c]) > 1 else F.col(c) for c in df.columns]) for df in nodes.values()]
    return HybridGraph(_together(plain), _together(edges), bank_balances(spark, f"{folder}/{balances}"))


def hospital(spark: SparkSession, folder: str) -> HybridGraph:
    """The whole patient graph of a folder: patients.csv, timeseries.csv, and the three derived edge types."""
    people = patients(spark, f"{folder}/patients.csv")
    fathers = father_of(people)
    return HybridGraph(people, _together([fathers, mother_of(people, fathers), classmates(people)]), patient_series(spark, f"{folder}/timeseries.csv"))


def bikes(spark: SparkSession, folder: str, points: int = 500) -> HybridGraph:
    """The whole bike graph of a folder: nodes.json, edges.json; series of stations and of trips."""
    nodes, series = stations(spark, f"{folder}/nodes.json", points)
    edges, of_edges = trips(spark, f"{folder}/edges.json", points, nodes)
    return HybridGraph(nodes, edges, series.unionByName(of_edges))


def sensors(spark: SparkSession, path: str) -> DataFrame:
    """Road sensors: node_id, latitude, longitude as Parquet, CSV with a header or JSON, by the path's ending."""
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    rows = spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.json(path)
    return rows.select(F.col("node_id").cast("string"), F.lit("TRAFFIC_LIGHT").alias("label"), F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double"))


def _related(pairs: DataFrame, kind: str) -> DataFrame:
    return pairs.select("src", "dst", F.lit(kind).alias("type")).distinct().withColumn("edge_id", F.concat_ws("|", "type", "src", "dst"))


def father_sides(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Men (src, last, at) and persons (dst, last, value) by year of birth: what FATHER_OF follows from, 25 to 35 years apart."""
    a = people.where("gender = 'M'").select(F.col("node_id").alias("src"), "last", F.year("birthdate").alias("at"))
    return a, people.select(F.col("node_id").alias("dst"), "last", F.year("birthdate").alias("value"))


def father_of(people: DataFrame, low: int = 25, high: int = 35) -> DataFrame:
    """Men to persons of the same last name born low to high years later: a band join, so a frequent name is no hot key."""
    return _related(band_join(*father_sides(people), ["last"], "at", "value", low, high).where(F.col("src") != F.col("dst")), "FATHER_OF")


def mother_sides(people: DataFrame, low: int = 25, high: int = 35) -> tuple[DataFrame, DataFrame]:
    """Women (src, city, at) and children of a father of their city (dst, city, value): what MOTHER_OF follows from.

    A father of the city is one of few groups of men by name, city and year, so fathers and children are not paired.
    """
    men = people.where("gender = 'M'").groupBy("last", "city", F.year("birthdate").alias("y")).agg(F.min("node_id").alias("a"), F.max("node_id").alias("b"))
    c = people.select(F.col("node_id").alias("dst"), "last", "city", F.year("birthdate").alias("value"))
    groups = c.select("last", "city", "value").distinct()
    near = band_join(men, groups, ["last", "city"], "y", "value", low, high).groupBy("last", "city", "value").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    children = c.join(near, ["last", "city", "value"]).where((F.col("a") != F.col("dst")) | (F.col("b") != F.col("dst")))
    m = people.where("gender = 'F'").select(F.col("node_id").alias("src"), "city", F.year("birthdate").alias("at"))
    return m, children.select("dst", "city", "value").distinct()


def mother_of(people: DataFrame, fathers: DataFrame, low: int = 25, high: int = 35) -> DataFrame:
    """Women to the children of a father of their city, where the child lives there too and was born low to high years later."""
    m = people.where("gender = 'F'").select(F.col("node_id").alias("src"), "city", F.year("birthdate").alias("y"))
    f = people.select(F.col("node_id").alias("father"), "city")
    c = people.select(F.col("node_id").alias("dst"), "city", F.year("birthdate").alias("z"))
    families = fathers.select(F.col("src").alias("father"), "dst").join(f, "father").join(c, ["dst", "city"]).select("dst", "city", "z").distinct()
    return _related(band_join(m, families, ["city"], "y", "z", low, high), "MOTHER_OF")


def classes(people: DataFrame) -> DataFrame:
    """An edge IN_CLASS from each person to the class of a city and year of birth: what WAS_CLASSMATE_OF follows from.

    Edge(("WAS_CLASSMATE_OF",), via="IN_CLASS") walks from person to person over it, so that a class of c persons has c edges
    instead of c (c - 1).
    """
    rows = people.where("city is not null and birthdate is not null").select(F.col("node_id").alias("src"), F.concat_ws("|", F.lit("class"), "city", F.year("birthdate")).alias("dst"), F.lit("IN_CLASS").alias("type"))
    return rows.distinct().withColumn("edge_id", F.concat_ws("|", "type", "src"))


def classmates(people: DataFrame) -> DataFrame:
    """Persons of the same city and year of birth, both ways: classes() written out. A class that is frequent is cut into cells."""
    a = people.where("city is not null and birthdate is not null").select(F.col("node_id").alias("src"), "city", F.year("birthdate").alias("y"))
    return _related(salted_join(a, a.withColumnRenamed("src", "dst"), ["city", "y"]).where("src <> dst"), "WAS_CLASSMATE_OF")


def write_graph(nodes: DataFrame, edges: DataFrame, series: DataFrame, folder: str) -> None:
    """The graph as Parquet, overwriting; series by type, so that a query reads its own type alone."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")
    series.write.mode("overwrite").partitionBy("ts_type").parquet(f"{folder}/series")


def write_bucketed(graph: HybridGraph, name: str, buckets: int, folder: str | None = None) -> HybridGraph:
    """The graph as tables `name`_nodes, `name`_edges, `name`_series of the session's catalog, overwriting; read from there.

    Series and nodes are bucketed and sorted by node, edges by source: joins on these columns move the other side alone.
    """
    out = []
    for part, df, key in (("nodes", graph.nodes, "node_id"), ("edges", graph.edges, "src"), ("series", graph.series, "node_id")):
        writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
        if folder is not None:
            writer = writer.option("path", f"{folder}/{part}")
        writer.saveAsTable(f"{name}_{part}")
        out.append(df.sparkSession.table(f"{name}_{part}"))
    return HybridGraph(*out)


def append_results(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").option("header", True).option("sep", ";").csv(folder)

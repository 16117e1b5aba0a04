"""Hybrid graphs made of the star-schema tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.model import HybridGraph
from loomgraph.session import read

BUCKETS, BUCKET_DAYS = 86, 28
DAY = 86_400_000_000
HOUR = 3_600_000_000


def _lists(points: DataFrame) -> DataFrame:
    """(node_id, ts_type, k, t, v) with at most one point for each k, as arrays in order of k."""
    p = points.groupBy("node_id", "ts_type").agg(F.sort_array(F.collect_list(F.struct("k", "t", "v"))).alias("p"))
    return p.select("node_id", "ts_type", F.col("p.t").alias("ts"), F.col("p.v").alias("v"))


def trade(spark: SparkSession, sf_dir: str) -> HybridGraph:
    """Nations; edges from customers' to suppliers' nations that trade; series `revenue` of a nation's customers."""
    t = {n: read(spark, sf_dir, n) for n in ("nation", "region", "customer", "supplier", "orders", "lineitem")}
    nodes = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("node_id"), F.lit("Nation").alias("label"), F.col("n_name").alias("name"), F.col("r_name").alias("region"))
    cust = t["customer"].select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    supp = t["supplier"].select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    sold = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    # each order's suppliers' nations as bits, before orders are joined: nations are fewer than 64
    to = t["lineitem"].select("l_orderkey", "l_suppkey").join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    to = to.groupBy("l_orderkey").agg(F.bit_or(F.expr("shiftleft(1L, cast(dst AS int))")).alias("nations"))
    met = to.join(sold.select("o_orderkey", "src"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("src").agg(F.bit_or("nations").alias("nations"))
    met = met.select("src", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("dst"), "nations").where("getbit(nations, dst) = 1")
    edges = met.select((F.col("src") * 100 + F.col("dst")).alias("edge_id"), "src", "dst", F.lit("TRADES").alias("type"))
    bucket = F.floor(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) / BUCKET_DAYS).cast("int")
    sums = sold.groupBy(F.col("src").alias("node_id"), bucket.alias("k")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    spine = t["nation"].select(F.col("n_nationkey").cast("long").alias("node_id"), F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("k"))
    start = F.unix_micros(F.lit("1995-01-01").cast("timestamp"))
    points = spine.join(sums, ["node_id", "k"], "left").select("node_id", F.lit("revenue").alias("ts_type"), "k", (start + F.col("k").cast("long") * BUCKET_DAYS * DAY).alias("t"), F.coalesce(F.col("s").cast("double"), F.lit(0.0)).alias("v"))
    return HybridGraph(nodes, edges, _lists(points))


USER_DAYS = 30


def users(spark: SparkSession, sf_dir: str) -> HybridGraph:
    """Users; an edge from each event's user to the next event's, typed by the first; daily series `count` and `value`."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    # the next event by id: ids are dense in blocks, so ranges of ids order by themselves and only their ends meet
    block = F.floor(F.col("event_id") / 4096)
    from pyspark.sql import Window

    inside = Window.partitionBy("block").orderBy("event_id")
    b = e.withColumn("block", block)
    firsts = b.groupBy("block").agg(F.min(F.struct("event_id", "user_id")).alias("f"))
    after = Window.orderBy("block")  # one row for each 4096 events
    firsts = firsts.withColumn("next_first", F.lead("f").over(after)).select("block", "next_first")
    b = b.withColumn("dst", F.lead("user_id").over(inside)).join(firsts, "block")
    edges = b.withColumn("dst", F.coalesce("dst", F.col("next_first.user_id"))).where("dst is not null")
    edges = edges.select(F.col("event_id").alias("edge_id"), F.col("user_id").alias("src"), "dst", F.col("event_type").alias("type"))
    people = e.select(F.col("user_id").alias("node_id")).distinct()
    nodes = people.select("node_id", F.lit("User").alias("label"), (F.col("node_id") % 7).alias("team"), (F.col("node_id") % 10).cast("double").alias("lat"))
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    daily = e.groupBy(F.col("user_id").alias("node_id"), day.alias("k")).agg(F.count(F.lit(1)).cast("double").alias("count"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    spine = people.select("node_id", F.explode(F.sequence(F.lit(0), F.lit(USER_DAYS - 1))).alias("k"))
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    wide = spine.join(daily, ["node_id", "k"], "left").withColumn("t", start + F.col("k").cast("long") * DAY)
    points = wide.select("node_id", F.lit("count").alias("ts_type"), "k", "t", F.coalesce("count", F.lit(0.0)).alias("v"))
    points = points.unionByName(wide.select("node_id", F.lit("value").alias("ts_type"), "k", "t", F.coalesce("value", F.lit(0.0)).alias("v")))
    return HybridGraph(nodes, edges, _lists(points))


REACH = 3


def vectors(spark: SparkSession, sf_dir: str) -> HybridGraph:
    """Vectors; edges between those of one label up to REACH ids apart; series `signal` by the hour, starting id % 24 hours
    into the day."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    nodes = e.select("node_id", F.lit("Vector").alias("label"), F.col("label").alias("kind"))
    near = nodes.select(F.col("node_id").alias("src"), "kind", F.explode(F.sequence(F.lit(1), F.lit(REACH))).alias("step")).withColumn("dst", F.col("src") + F.col("step"))
    edges = near.join(nodes.select(F.col("node_id").alias("dst"), "kind"), ["dst", "kind"]).select((F.col("src") * 10 + F.col("step")).alias("edge_id"), "src", "dst", F.concat(F.lit("NEAR"), F.col("step")).alias("type"))
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    ts = F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda k: start + (k + F.col("node_id") % 24) * HOUR)
    return HybridGraph(nodes, edges, e.select("node_id", F.lit("signal").alias("ts_type"), ts.alias("ts"), "v"))


# ---- the same in SQL: node n, edge e, series s(node, ts_type, ts, v) ----

_MICROS_1995, _MICROS_2024 = 788_918_400_000_000, 1_704_067_200_000_000

TRADE_SQL = f"""
n AS (SELECT n_nationkey::BIGINT AS node_id, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
sold AS (SELECT o_orderkey, c_nationkey::BIGINT AS src, o_orderdate, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
e AS (SELECT src * 100 + dst AS edge_id, src, dst, 'TRADES' AS type FROM (SELECT DISTINCT src, s_nationkey::BIGINT AS dst FROM lineitem JOIN sold ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)),
sums AS (SELECT src AS node_id, datediff('day', DATE '1995-01-01', o_orderdate::DATE) // {BUCKET_DAYS} AS k, sum(o_totalprice::DECIMAL(18,2)) AS v FROM sold GROUP BY 1, 2),
spine AS (SELECT n_nationkey::BIGINT AS node_id, unnest(range(0, {BUCKETS})) AS k FROM nation),
s AS (SELECT node_id AS node, 'revenue' AS ts_type, list({_MICROS_1995} + k * {BUCKET_DAYS * DAY} ORDER BY k) AS ts, list(coalesce(v::DOUBLE, 0.0) ORDER BY k) AS v FROM spine LEFT JOIN sums USING (node_id, k) GROUP BY 1)"""

USERS_SQL = f"""
ev AS (SELECT event_id, ts, user_id, event_type, value FROM events),
n AS (SELECT DISTINCT user_id AS node_id, user_id % 7 AS team, (user_id % 10)::DOUBLE AS lat FROM ev),
e AS (SELECT event_id AS edge_id, user_id AS src, nxt AS dst, event_type AS type FROM (SELECT *, lead(user_id) OVER (ORDER BY event_id) AS nxt FROM ev) WHERE nxt IS NOT NULL),
daily AS (SELECT user_id AS node_id, datediff('day', DATE '2024-01-01', ts::DATE) AS k, count(*)::DOUBLE AS c, sum(value::DECIMAL(18,2))::DOUBLE AS x FROM ev GROUP BY 1, 2),
spine AS (SELECT node_id, unnest(range(0, {USER_DAYS})) AS k FROM n),
s AS (SELECT node_id AS node, 'count' AS ts_type, list({_MICROS_2024} + k * {DAY} ORDER BY k) AS ts, list(coalesce(c, 0.0) ORDER BY k) AS v FROM spine LEFT JOIN daily USING (node_id, k) GROUP BY 1
 UNION ALL SELECT node_id, 'value', list({_MICROS_2024} + k * {DAY} ORDER BY k), list(coalesce(x, 0.0) ORDER BY k) FROM spine LEFT JOIN daily USING (node_id, k) GROUP BY 1)"""

VECTORS_SQL = f"""
n AS (SELECT vec_id AS node_id, label AS kind FROM embeddings),
e AS (SELECT a.node_id * 10 + (b.node_id - a.node_id) AS edge_id, a.node_id AS src, b.node_id AS dst, concat('NEAR', b.node_id - a.node_id) AS type FROM n a JOIN n b ON a.kind = b.kind AND b.node_id BETWEEN a.node_id + 1 AND a.node_id + {REACH}),
s AS (SELECT vec_id AS node, 'signal' AS ts_type, list_transform(range(0, len(embedding)), lambda k: {_MICROS_2024} + (k + vec_id % 24) * {HOUR}) AS ts, embedding::DOUBLE[] AS v FROM embeddings)"""

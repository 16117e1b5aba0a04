"""python bench.py: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import pattern
from loomgraph.operators.pattern import Edge, Node
from loomgraph.operators.tdjoin import td_join
from loomgraph.operators.walk import count_matches, count_walks, temporal_walk
from loomgraph.plans import testgraph
from loomgraph.plans.model import HybridGraph

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def stored(g: HybridGraph, folder: str, name: str) -> HybridGraph:
    """The graph written as Parquet once: queries are timed on stored graphs, as an engine has them."""
    out = []
    for part, df in (("nodes", g.nodes), ("edges", g.edges), ("series", g.series)):
        path = f"{folder}/{name}/{part}"
        df.write.mode("overwrite").parquet(path)
        out.append(df.sparkSession.read.schema(df.schema).parquet(path))
    return HybridGraph(*out)


def ledgers(spark: SparkSession, trade: HybridGraph) -> HybridGraph:
    """Nations of Asia and their trade, each with one long series: the prices of its customers' orders, one by one."""
    read = lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")
    nations = trade.nodes.where("region = 'ASIA'")
    sold = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("long").alias("node_id"), "o_orderkey", "o_totalprice")
    prices = sold.join(nations, "node_id").groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("p"))
    ts = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda k: k.cast("long") * 3_600_000_000)
    series = prices.select("node_id", F.lit("price").alias("ts_type"), ts.alias("ts"), F.col("p.o_totalprice").alias("v"))
    edges = trade.edges
    for end in ("src", "dst"):
        edges = edges.join(nations.select(F.col("node_id").alias(end)), end, "left_semi")
    return HybridGraph(nations, edges.select("edge_id", "src", "dst", "type"), series)


def main() -> None:
    import tempfile

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory() as folder:
        seconds: dict[str, float] = {}

        def timed(name: str, run) -> None:
            began = time.time()
            run().write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - began, 3)

        began = time.time()
        trade = stored(testgraph.trade(spark, SF_DIR), folder, "trade")
        users = stored(testgraph.users(spark, SF_DIR), folder, "users")
        vectors = stored(testgraph.vectors(spark, SF_DIR), folder, "vectors")
        seconds["load_graphs"] = round(time.time() - began, 3)
        hop = lambda g: pattern.match(g, Node(), (Edge(), Node()))
        count_matches(hop(trade), trade.series, "revenue", "equal", 8).collect()  # starts the workers

        for relation in ("overlaps", "meets", "equal", "before"):
            for method in ("td", "stamp", "stomp"):
                timed(f"baseline_trade_{relation}_{method}", lambda: count_matches(hop(trade), trade.series, "revenue", relation, 30, 0.85, method))  # noqa: B023
            timed(f"scalability_users_{relation}", lambda: count_matches(hop(users), users.series, "value", relation, 7, 0.0))  # noqa: B023
            timed(f"scalability_vectors_{relation}", lambda: count_matches(hop(vectors), vectors.series, "signal", relation, 30, 0.0))  # noqa: B023
        asia = Node("Nation", "region = 'ASIA'")
        for n in (1, 2, 3):
            paths = pattern.hops(trade, asia, Edge(("TRADES",)), n, asia)
            for semantics in ("2cont", "cont"):
                timed(f"path_cost_{semantics}_n{n}", lambda: temporal_walk(paths, trade.series, "revenue", "overlaps", 30, 0.85, semantics, "td", n))  # noqa: B023
        timed("selectivity_undirected", lambda: pattern.match(users, Node(), (Edge((), "any"), Node())).agg(F.count(F.lit(1))))
        timed("selectivity_hops_2", lambda: pattern.hops(vectors, Node(), Edge(), 2).agg(F.count(F.lit(1))))
        ledger = stored(ledgers(spark, trade), folder, "ledger")
        for method in ("td", "stamp", "stomp"):  # 25 pairs of series of some thousand points
            timed(f"long_before_{method}", lambda: td_join(ledger.edges.repartition(int(CPUS)), ledger.series, "price", "before", 30, 0.0, method))  # noqa: B023
        timed("walk_count_n3", lambda: count_walks(trade, asia, Edge(("TRADES",)), 3, asia, "revenue", "overlaps", 30, 0.85))
        timed("hub_blocks", lambda: td_join(users.edges, users.series, "value", "overlaps", 7, 0.0, blocks=4))
        timed("none_trade", lambda: td_join(trade.edges, trade.series, "revenue", "none", 20, 0.5))
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    main()

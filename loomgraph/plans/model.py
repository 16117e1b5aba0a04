"""The hybrid graph: nodes and edges as tables, and the series of nodes (or edges) as arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.series import parse_list


@dataclass(frozen=True)
class HybridGraph:
    """nodes: node_id, label, properties. edges: edge_id, src, dst, type, properties; a multigraph.

    series: node_id, ts_type, ts (array of microseconds since 1970), v (array of doubles), one row for each owner and
    type, points in stored order. Series never travel with nodes: a pattern reads node columns alone.
    """

    nodes: DataFrame
    edges: DataFrame
    series: DataFrame


def checked_series(series: DataFrame) -> DataFrame:
    """series with as many values as timestamps: more values are cut, fewer are an error when the row is read."""
    short = F.size("v") < F.size("ts")
    values = F.when(short, F.raise_error(F.lit("a series has fewer values than timestamps"))).otherwise(F.slice("v", 1, F.size("ts")))
    return series.where(F.col("ts").isNotNull() & F.col("v").isNotNull()).withColumn("v", values.cast("array<double>"))


def from_points(points: DataFrame) -> DataFrame:
    """Series of (node_id, ts_type, ts, v) rows, in order of time (of equal times, of value)."""
    p = points.select("node_id", "ts_type", F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("v").cast("double").alias("v")).alias("point"))
    p = p.groupBy("node_id", "ts_type").agg(F.sort_array(F.collect_list("point")).alias("points"))
    return p.select("node_id", "ts_type", F.col("points.t").alias("ts"), F.col("points.v").alias("v"))


def from_lists(lists: DataFrame, ts_type: str, ts: str, v: str, node_id: str) -> DataFrame:
    """Series of two list columns: arrays, or texts such as '[1, 2]'; timestamps as timestamps or ISO texts."""
    kinds = dict(lists.dtypes)
    stamps, values = F.col(ts), F.col(v)
    if kinds[ts] == "string":
        stamps = parse_list(stamps, "timestamp")
    elif not kinds[ts].startswith(("array<timestamp", "array<string", "array<date")):
        raise ValueError(f"{ts} is {kinds[ts]}: timestamps must be a list of timestamps or texts, or a text")
    if kinds[v] == "string":
        values = parse_list(values)
    elif kinds[v] not in ("array<double>", "array<string>"):
        raise ValueError(f"{v} is {kinds[v]}: values must be a list of doubles or texts, or a text")
    stamps = F.transform(stamps, lambda x: F.unix_micros(x.cast("timestamp")))
    values = F.transform(values, lambda x: x.try_cast("double")) if kinds[v] == "array<string>" else values
    return checked_series(lists.select(F.col(node_id).alias("node_id"), F.lit(ts_type).alias("ts_type"), stamps.alias("ts"), values.alias("v")))


def first_points(series: DataFrame, n: int) -> DataFrame:
    """Each series cut to its first n points."""
    return series.withColumn("ts", F.slice("ts", 1, n)).withColumn("v", F.slice("v", 1, n))

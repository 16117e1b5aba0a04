"""Series that grow: points arrive as a stream and are appended to a table of points by day.

A batch is deduplicated by (node_id, ts_type, ts) within the watermark and committed once: the sink writes each batch to a
folder of its own number, and overwrites it if the batch is repeated after a failure. Series are made from the points on
reading, for the time that a query asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.plans.model import from_points

POINT = "node_id long, ts_type string, ts timestamp, v double"


def append_points(points: DataFrame, folder: str, checkpoint: str, late: str = "1 hour", once: bool = True) -> StreamingQuery:
    """Start appending a stream of points (node_id, ts_type, ts, v); once: take what is there and stop."""
    seen = points.withWatermark("ts", late).dropDuplicatesWithinWatermark(["node_id", "ts_type", "ts"])

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{folder}/batch={number}")

    q = seen.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()


def read_series(spark: SparkSession, folder: str, ts_type: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Series of one type over days (both inclusive); only those days' files are read."""
    p = spark.read.schema(POINT + ", day date").option("basePath", folder).parquet(f"{folder}/batch=*")
    p = p.where(F.col("ts_type") == ts_type)
    p = p if first_day is None else p.where(F.col("day") >= F.lit(first_day).cast("date"))
    p = p if last_day is None else p.where(F.col("day") <= F.lit(last_day).cast("date"))
    return from_points(p)


def windowed_means(points: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """(node_id, ts_type, start, v, n): tumbling means of a stream of points, each final once the watermark is past it."""
    g = points.withWatermark("ts", late).groupBy("node_id", "ts_type", F.window("ts", width).alias("w"))
    return g.agg(F.avg("v").alias("v"), F.count("v").alias("n")).select("node_id", "ts_type", F.col("w.start").alias("start"), "v", "n")

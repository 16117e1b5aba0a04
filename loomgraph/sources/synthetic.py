"""Simulated balances: geometric Brownian motion by account level, the same for the same seed on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Level, balance at the start, drift, volatility.
LEVELS = (
    ("Basic level", 500.0, -0.0001, 0.02),
    ("Silver level", 1500.0, 0.0002, 0.015),
    ("Gold level", 3000.0, 0.0004, 0.01),
    ("Platinum level", 6000.0, 0.0005, 0.008),
    ("Elite level", 12000.0, 0.0003, 0.005),
    ("Diamond level", 25000.0, 0.0002, 0.004),
)
DAYS_A_YEAR = 252


def standard_normal(*key: F.Column) -> F.Column:
    """A normal deviate that is a function of the key (Box-Muller on two hashes)."""
    unit = lambda salt: (F.pmod(F.xxhash64(F.lit(salt), *key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.ln(unit("radius"))) * F.cos(2 * F.pi() * unit("angle"))


def business_days(start: str, days: int) -> F.Column:
    """Array of the first `days` weekdays from start on, as dates."""
    first = F.to_date(F.lit(start))
    every = F.sequence(first, F.date_add(first, days * 7 // 5 + 7))
    return F.slice(F.filter(every, lambda d: F.dayofweek(d).between(2, 6)), 1, days)


def balances(accounts: DataFrame, days: int = DAYS_A_YEAR, start: str = "2022-01-01", seed: int = 42) -> DataFrame:
    """Series `balance` of accounts (node_id, level): the first value is the level's, later ones rounded to three places.

    Accounts of an unknown level are an error.
    """
    spark = accounts.sparkSession
    levels = spark.createDataFrame(LEVELS, "level string, first double, mu double, sigma double")
    a = accounts.select("node_id", "level").join(F.broadcast(levels), "level", "left")
    first = F.when(F.col("first").isNull(), F.raise_error(F.concat(F.lit("unknown account level: "), F.coalesce("level", F.lit("null"))))).otherwise(F.col("first"))
    a = a.withColumn("first", first.cast("double")).select("node_id", "first", "mu", "sigma", F.posexplode(business_days(start, days)).alias("day", "date"))
    dt = 1.0 / DAYS_A_YEAR
    step = (F.col("mu") - F.col("sigma") ** 2 / 2) * dt + F.col("sigma") * dt**0.5 * standard_normal(F.col("node_id"), F.col("day"), F.lit(seed))
    a = a.withColumn("step", F.when(F.col("day") == 0, 0.0).otherwise(step))
    so_far = Window.partitionBy("node_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    a = a.withColumn("v", F.round(F.col("first") * F.exp(F.sum("step").over(so_far)), 3))
    a = a.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct(F.unix_micros(F.col("date").cast("timestamp")).alias("t"), "v"))).alias("points"))
    return a.select("node_id", F.lit("balance").alias("ts_type"), F.col("points.t").alias("ts"), F.col("points.v").alias("v"))


def half(nodes: DataFrame, share: float = 0.5, seed: int = 42) -> DataFrame:
    """A sample by the first 32 bits of the md5 of seed and id: the same rows in any order or partitioning, or engine."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("node_id").cast("string"))), 1, 8)
    return nodes.where(F.conv(digits, 16, 10).cast("long") < int(share * (1 << 32)))

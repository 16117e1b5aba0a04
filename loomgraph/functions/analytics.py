"""Evaluation of result tables: means by pivot, speed-up ratios, size labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_size(label: Column) -> Column:
    """'5k' is 5000, '1M' a million; a plain number is itself and anything else null."""
    parts = F.regexp_extract(F.trim(label), r"^([0-9]+(?:\.[0-9]+)?)([kKmM]?)$", 1)
    unit = F.lower(F.regexp_extract(F.trim(label), r"^([0-9]+(?:\.[0-9]+)?)([kKmM]?)$", 2))
    scale = F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)
    return F.round(F.nullif(parts, F.lit("")).try_cast("double") * scale).cast("long")


def pivot_mean(rows: DataFrame, by: list[str], column: str, values: list, measure: str) -> DataFrame:
    """The mean of a measure for each group and each of the given values of a column."""
    return rows.groupBy(*by).pivot(column, values).agg(F.avg(measure))


def speedup(rows: DataFrame, by: list[str], method: str, measure: str, base: str) -> DataFrame:
    """For each group and method, its mean over that of the base method: how many times slower it is."""
    means = rows.groupBy(*by, method).agg(F.avg(measure).alias("mean"))
    of_base = means.where(F.col(method) == base).select(*by, F.col("mean").alias("base_mean"))
    return means.join(of_base, by).select(*by, method, (F.col("mean") / F.nullif("base_mean", F.lit(0.0))).alias("ratio"))

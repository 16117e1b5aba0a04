"""Scalar functions on windows and series, as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY, HOUR, MINUTE, SECOND = 86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000


def round_half_up(x: Column, places: int = 5) -> Column:
    """floor(x * 10^places + 1/2) / 10^places."""
    if places < 0:
        raise ValueError("places must not be negative")
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def total(x: Column) -> Column:
    """Sum of an array from left to right."""
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def mean(x: Column) -> Column:
    return total(x) / F.nullif(F.size(x), F.lit(0))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: inside a lambda, a plain column would be computed for each element again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _standardised(x: Column, flat: float) -> Column:
    def with_mean(m: Column) -> Column:
        sd = F.sqrt(total(F.transform(x, lambda v: (v - m) * (v - m))) / F.nullif(F.size(x), F.lit(0)))
        return bound(sd, lambda d: F.transform(x, lambda v: F.when(d == 0, F.lit(flat)).otherwise((v - m) / F.nullif(d, F.lit(0.0)))))

    return bound(mean(x), with_mean)


def z_normalised(x: Column) -> Column:
    """(x - mean) / standard deviation of the population; zeros where all values are the same."""
    return _standardised(x, 0.0)


def z_list(x: Column) -> Column:
    """As z_normalised(), of a whole list and without the guard: all NaN where all values are the same."""
    return _standardised(x, float("nan"))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has length 0."""
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def granularity(ts: Column) -> Column:
    """The coarsest of DAYS, HOURS, MINUTES, SECONDS that divides the first gap of an array of microseconds.

    Null with fewer than two points or a gap that no unit divides.
    """
    gap = F.when(F.size(ts) >= 2, ts[1] - ts[0])
    return F.when(gap % DAY == 0, "DAYS").when(gap % HOUR == 0, "HOURS").when(gap % MINUTE == 0, "MINUTES").when(gap % SECOND == 0, "SECONDS")


def parse_list(text: Column, kind: str = "double") -> Column:
    """'[1, 2]', also with quoted items, as an array; blank items are skipped and bad ones null."""
    inside = F.regexp_replace(text, r"[\[\]\"']", "")
    items = F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(items, lambda x: x.try_cast(kind))


def windows(series: DataFrame, w: int) -> DataFrame:
    """(node_id, ts_type, i, ts, x, z): each run of w points of each series with its z-normalised values."""
    s = series.where(F.size("v") >= w).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("v") - w)))
    s = s.select("node_id", "ts_type", "i", F.slice("ts", F.col("i") + 1, F.lit(w)).alias("ts"), F.slice("v", F.col("i") + 1, F.lit(w)).alias("x"))
    return s.withColumn("z", z_normalised(F.col("x")))

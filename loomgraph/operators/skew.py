"""Equi-joins and band joins whose frequent keys are cut into cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import staged

#: Rows of a key on one side from which that side is cut.
CELL_ROWS = 20_000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """The inner join on keys. A key with more rows than `rows` on a side has that side dealt to cells by a hash of the row,
    and the other side goes to each of them: no task has more than about rows by rows of one key, if rows differ.

    Counting costs both sides an aggregation of their keys; the table of frequent keys has at most a row for each `rows` rows.
    """
    rows = rows or CELL_ROWS
    counts = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > rows) for df, n in ((left, "l_"), (right, "r_"))]
    hot = staged(counts[0].join(counts[1], keys, "full"), "frequent-keys")
    cells = lambda n: F.coalesce(F.ceil(F.col(n) / rows), F.lit(1)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), cells(n) - 1))
    own = lambda df, n: F.pmod(F.xxhash64(*df.columns), cells(n))
    a = left.join(hot, keys, "left").withColumn("cell_l", own(left, "l_")).withColumn("cell_r", every("r_")).drop("l_", "r_")
    b = right.join(hot, keys, "left").withColumn("cell_r", own(right, "r_")).withColumn("cell_l", every("l_")).drop("l_", "r_")
    return a.join(b, [*keys, "cell_l", "cell_r"]).drop("cell_l", "cell_r")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, low: int, high: int, rows: int | None = None) -> DataFrame:
    """Pairs of equal keys whose right value is low to high over the left one (both whole numbers).

    Values are cut into bins as wide as the band: a left row goes to the two bins that its band can touch, a right row to its
    own, so only neighbours are compared, and each pair meets once. Null keys and values meet nothing.
    """
    if high < low:
        raise ValueError("the band is empty")
    wide = high - low + 1

    def bin_of(c: Column) -> Column:
        return F.floor(c / wide).cast("long")

    a = left.where(F.col(at).isNotNull()).withColumn("bin_", F.explode(F.sequence(bin_of(F.col(at) + low), bin_of(F.col(at) + high))))
    b = right.where(F.col(value).isNotNull()).withColumn("bin_", bin_of(F.col(value)))
    return salted_join(a, b, [*keys, "bin_"], rows).where((F.col(value) - F.col(at)).between(low, high)).drop("bin_")

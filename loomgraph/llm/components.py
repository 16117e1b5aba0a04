"""Connected components of an edge table, by contraction under hashed priorities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import ship, staged, tidy


class Forest:
    """Union-find over 64-bit integers; the smallest member is a tree's root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = list(self.up)
        return nodes, [self.root(x) for x in nodes]


#: Trees of this many nodes are handed on, so that a task's memory is bounded; more edges than needed do no harm.
FOREST_NODES = 500_000


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        a, b = (batch.column(i).to_numpy() for i in (0, 1))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            forest.join(x, y)
        if len(forest.up) > FOREST_NODES:
            x, y = forest.edges()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])
            forest = Forest()
    x, y = forest.edges()
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame | None:
    """(node, root) as xxhash64 of the edges' ends, which is one to one on 64-bit integers; None if there is no edge.

    Each round maps every node to the least of itself and its neighbours and contracts the edges so; hashed ids make
    the graph shrink by a constant factor on average whatever its shape. A hub's rows are only ever pre-aggregated, or
    joined as two plain exchanges that adaptive execution can split. Null ends are ignored; repeated edges and loops do
    no harm.
    """
    spark = edges.sparkSession
    ship(spark)
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    # written first: one Python worker beside another in a task would double what the workers hold
    e = staged(e.select(F.xxhash64(a).alias("a"), F.xxhash64(b).alias("b")), "links").mapInArrow(tidy(_spanning), "a long, b long")
    e = staged(e.where("a <> b"), "edges")
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        m = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        m = staged(m.select("node", F.least("node", "least").alias("root")), "labels")
        maps.append(m)
        to_a, to_b = m.select(F.col("node").alias("a"), F.col("root").alias("x")), m.select(F.col("node").alias("b"), F.col("root").alias("y"))
        e = e.join(to_a, "a").join(to_b, "b").where("x <> y")
        e = staged(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not maps:
        return None
    found = maps.pop()
    while maps:
        nxt = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = maps.pop().join(nxt, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return found


def as_arrow(schema: pa.Schema, **columns: np.ndarray | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

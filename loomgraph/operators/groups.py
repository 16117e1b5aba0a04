"""The window join where pairs come in groups: every source of a group with every target of it, and only whether they match.

Groups are never written out as pairs: a group's sources and targets are cut into cells, two cells make a tile, and a tile
gets its series once, however many pairs it has. A pair becomes a row when its series match, and not before.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import kernel
from loomgraph.operators.relations import Relation
from loomgraph.operators.skew import band_join
from loomgraph.operators.tdjoin import _grid, _rows
from loomgraph.session import ship, staged

#: Nodes, and points of their series, that a cell should have.
CELL_NODES, CELL_POINTS = 1024, 1 << 20


def _alike(times: list[np.ndarray], step: bool) -> dict[tuple[int, ...], np.ndarray]:
    """Rows of series that stand on a target's grid in the same way, by length, first time and, for sources, first step."""
    kinds = defaultdict(list)
    for k, t in enumerate(times):
        kinds[(len(t), int(t[0]), int(t[1] - t[0])) if step else (len(t), int(t[0]))].append(k)
    return {k: np.array(rows) for k, rows in kinds.items()}


def _tile_kernel(w: int, relation: Relation, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        side, own = t.column("side").to_numpy(), []
        for k in (0, 1):
            part = t.filter(pa.array(side == k)).combine_chunks()
            ts, v = (_rows(c.chunk(0), kind) if c.num_chunks else [] for c, kind in ((part.column("ts"), np.int64), (part.column("v"), float)))
            own.append((part.column("node_id").combine_chunks(), ts, v))
        (src, ta, va), (dst, tb, vb) = own
        targets = _alike(tb, False)
        for (n, *_), rows in _alike(ta, True).items():
            xs = np.array([va[k][:n] for k in rows])
            for (m, _), goals in targets.items():
                offset = 0 if relation is Relation.NONE else _grid(ta[rows[0]], tb[goals[0]], 0)
                if offset is None:
                    continue
                ys = np.array([vb[k][:m] for k in goals])
                for lo in range(0, len(rows), kernel.SIDE):  # rows leave part by part
                    x, y = np.nonzero(kernel.grid_match(xs[lo : lo + kernel.SIDE], ys, w, relation, offset, threshold))
                    yield pa.RecordBatch.from_arrays([src.take(pa.array(rows[x + lo])), dst.take(pa.array(goals[y]))], names=["src", "dst"])

    return run


def matching_groups(sources: DataFrame, targets: DataFrame, keys: list[str], series: DataFrame, ts_type: str, relation: str | None, w: int, threshold: float = 0.0, low: int = 0, high: int = 0) -> DataFrame:
    """(src, dst): the pairs whose series match, each once, as matching() finds them; a node is not paired with itself.

    sources: src, keys and a whole number at; targets: dst, keys and a whole number value; a node has one row on a side. Pairs
    have equal keys, and value is low to high over at. Null keys and numbers meet nothing.
    """
    r, spark = Relation.of(relation), series.sparkSession
    ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = staged(series.where((F.col("ts_type") == ts_type) & (F.size("ts") >= max(w, 2))).select("node_id", "ts", "v"), "group-series")
    whole = [F.col(k).isNotNull() for k in keys]
    sides, sizes = [], []
    for df, node, at, cells in ((sources, "src", "at", "cells_a"), (targets, "dst", "value", "cells_b")):
        for there in [*whole, F.col(at).isNotNull()]:
            df = df.where(there)
        sides.append(staged(df.select(F.col(node).alias("node_id"), *keys, at), "group-members"))
        many = F.greatest(F.ceil(F.count(F.lit(1)) / CELL_NODES), F.ceil(F.sum(F.size("ts")) / CELL_POINTS)).cast("int").alias(cells)
        sizes.append(sides[-1].join(s.select("node_id", "ts"), "node_id").groupBy(*keys, at).agg(many))
    met = staged(band_join(*sizes, keys, "at", "value", low, high), "groups")
    tile = [*keys, "at", "value", "cell_a", "cell_b"]
    cell = lambda n: F.pmod(F.xxhash64("node_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = sides[0].join(met, [*keys, "at"]).withColumn("cell_a", cell("cells_a")).withColumn("cell_b", every("cells_b"))
    b = sides[1].join(met, [*keys, "value"]).withColumn("cell_b", cell("cells_b")).withColumn("cell_a", every("cells_a"))
    parts = [df.groupBy("node_id").agg(F.collect_list(F.struct(*tile)).alias("tiles")).withColumn("side", F.lit(k)) for k, df in enumerate((a, b))]
    sent = parts[0].unionByName(parts[1]).join(s, "node_id").select(F.explode("tiles").alias("tile"), "side", "node_id", "ts", "v")
    sent = sent.select(*[F.col(f"tile.{c}").alias(c) for c in tile], "side", "node_id", "ts", "v").repartition(tasks, *tile)
    kind = dict(sources.dtypes)["src"], dict(targets.dtypes)["dst"]
    if w <= 2:
        sent = sent.limit(0)
    return sent.groupBy(*tile).applyInArrow(_tile_kernel(w, r, float(threshold)), f"src {kind[0]}, dst {kind[1]}").where("src <> dst")

"""The window join and the walks in SQL: table functions, and the cache that queries share.

    SELECT p.src, p.dst, h.* FROM pairs p JOIN ..., LATERAL td_join(ta, va, tb, vb, 'overlaps', 8, 0.85D, 'td') h

gives at most one row (i, j, dist) for each row of its input. For whole tables td_join() of the operators is faster: it
works on the distinct pairs and many at a time.

    SELECT * FROM temporal_walk(TABLE(hops), 'overlaps', 8, 0.85D, 'cont', 'td')

walks the paths of a table of hops: a row for each hop with path (of any type: what tells paths apart), hop (their order),
src, dst, and both ends' series ta, va, tb, vb. It gives path and hops of those that match wholly. The function itself asks for
its rows by path and in order, so the query needs no PARTITION BY; a query that gives its own (PARTITION BY of more
columns, say) calls temporal_walk_by instead. td_walk_hops() makes such a table of paths and series.

    SELECT * FROM clear_cache()     -- the memo of the workers; CLEAR CACHE does the same for cached tables
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from loomgraph.operators import kernel
from loomgraph.operators.relations import Relation
from loomgraph.session import ship


def best_windows(ta: list, va: list, tb: list, vb: list, relation: str | None, w: int, threshold: float, method: str) -> tuple[int, int, float] | None:
    r = Relation.of(relation)
    if ta is None or tb is None or w > min(len(ta), len(tb)):
        return None
    a, b = (np.array(x, float)[: len(t)] for x, t in ((va, ta), (vb, tb)))
    ta, tb = np.array(ta, np.int64), np.array(tb, np.int64)
    if method != "td":
        return kernel.profile_join(a, ta, b, tb, w, r)
    if w <= 2:
        return None
    offset = 0
    if r is not Relation.NONE:
        step, gap = int(ta[1] - ta[0]), int(ta[0] - tb[0])
        if step == 0 or gap % step:
            return None
        offset = gap // step
    best = kernel.grid_join(a[None], b[None], w, r, offset, threshold)
    return (int(best.i[0]), int(best.j[0]), float(best.dist[0])) if best.i[0] >= 0 else None


class TdJoin:
    def eval(self, ta: list, va: list, tb: list, vb: list, relation: str, w: int, threshold: float, method: str) -> Iterator[tuple[int, int, float]]:
        found = best_windows(ta, va, tb, vb, relation, w, threshold, method)
        if found is not None:
            yield found


#: Joins that a worker remembers, found or not; by the series themselves, so that no other table's rows are taken for them.
MEMO = 4096
_memo: dict[tuple, tuple[int, int, float] | None] = {}

_HOP_COLUMNS = ("path", "hop", "src", "dst", "ta", "va", "tb", "vb")


def _constant(argument: AnalyzeArgument, name: str, kinds: tuple[type, ...]):
    if not argument.isConstantExpression or not isinstance(argument.value, kinds):
        raise ValueError(f"{name} is a constant of kind {' or '.join(k.__name__ for k in kinds)}")
    return argument.value


class TemporalWalkBy:
    """The walk of each partition's rows: one path's hops, in the order that they come in."""

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.how: tuple = ()

    @staticmethod
    def analyze(hops: AnalyzeArgument, relation: AnalyzeArgument, w: AnalyzeArgument, threshold: AnalyzeArgument, semantics: AnalyzeArgument, method: AnalyzeArgument) -> AnalyzeResult:
        if not hops.isTable:
            raise ValueError("the first argument is a table of hops")
        kinds = {f.name: f.dataType for f in hops.dataType.fields}
        if missing := [c for c in _HOP_COLUMNS if c not in kinds]:
            raise ValueError(f"the table of hops has no column {', '.join(missing)}")
        Relation.of(_constant(relation, "relation", (str,)))
        if _constant(w, "w", (int,)) < 1:
            raise ValueError("w must be positive")
        float(threshold.value)
        if _constant(semantics, "semantics", (str,)) not in ("2cont", "cont"):
            raise ValueError("semantics is 2cont or cont")
        if _constant(method, "method", (str,)) not in ("td", "stamp", "stomp"):
            raise ValueError("method is td, stamp or stomp")
        hop = StructType([StructField("src", kinds["src"]), StructField("dst", kinds["dst"]), StructField("i", IntegerType()), StructField("j", IntegerType()), StructField("dist", DoubleType())])
        return AnalyzeResult(StructType([StructField("path", kinds["path"]), StructField("hops", ArrayType(hop))]))

    def eval(self, hops: Row, relation: str, w: int, threshold: float, semantics: str, method: str) -> None:
        self.rows.append(hops)
        self.how = relation, w, float(threshold), semantics, method

    def terminate(self) -> Iterator[tuple]:
        if not self.rows:
            return
        relation, w, threshold, semantics, method = self.how
        pin, found = None, []
        for r in self.rows:
            best = _remembered(r, relation, w, threshold, method, pin)
            if best is None:
                return
            found.append((r["src"], r["dst"], *best))
            pin = best[1] if semantics == "cont" else None
        yield self.rows[0]["path"], found


class TemporalWalk(TemporalWalkBy):
    """The same, which asks for its rows by path, in the order of hop."""

    @staticmethod
    def analyze(hops: AnalyzeArgument, relation: AnalyzeArgument, w: AnalyzeArgument, threshold: AnalyzeArgument, semantics: AnalyzeArgument, method: AnalyzeArgument) -> AnalyzeResult:
        found = TemporalWalkBy.analyze(hops, relation, w, threshold, semantics, method)
        return AnalyzeResult(found.schema, partitionBy=[PartitioningColumn("path")], orderBy=[OrderingColumn("hop")])


def _remembered(r: Row, relation: str, w: int, threshold: float, method: str, pin: int | None) -> tuple[int, int, float] | None:
    ta, va, tb, vb = r["ta"], r["va"], r["tb"], r["vb"]
    if ta is None or va is None or tb is None or vb is None:
        return None
    key = (r["src"], r["dst"], pin, relation, w, threshold, method, tuple(ta), tuple(va), tuple(tb), tuple(vb))
    if key not in _memo:
        if len(_memo) >= MEMO:
            _memo.clear()
        if pin is None:
            _memo[key] = best_windows(ta, va, tb, vb, relation, w, threshold, method)
        elif pin + w > len(ta):
            _memo[key] = None
        else:
            best = best_windows(ta[pin : pin + w], va[pin : pin + w], tb, vb, relation, w, threshold, method)
            _memo[key] = None if best is None else (best[0] + pin, *best[1:])
    return _memo[key]


class ClearCache:
    def eval(self) -> Iterator[tuple[str]]:
        _memo.clear()
        yield ("Cache cleared",)


def td_walk_hops(paths: DataFrame, series: DataFrame, ts_type: str) -> DataFrame:
    """The table of hops of paths (nodes, edge_ids): path is edge_ids; hops without a series have nulls, so their path does not match."""
    steps = F.posexplode(F.arrays_zip(F.slice("nodes", 1, F.size("nodes") - 1).alias("src"), F.slice("nodes", 2, F.size("nodes") - 1).alias("dst")))
    hops = paths.select(F.col("edge_ids").alias("path"), steps.alias("hop", "ends")).select("path", "hop", "ends.src", "ends.dst")
    s = series.where(F.col("ts_type") == ts_type)
    a = s.select(F.col("node_id").alias("src"), F.col("ts").alias("ta"), F.col("v").alias("va"))
    b = s.select(F.col("node_id").alias("dst"), F.col("ts").alias("tb"), F.col("v").alias("vb"))
    return hops.join(a, "src", "left").join(b, "dst", "left").select(*_HOP_COLUMNS)


def register(spark: SparkSession, name: str = "td_join") -> None:
    """Make the table functions known to the session's SQL: td_join (or name), temporal_walk, temporal_walk_by, clear_cache."""
    ship(spark)
    spark.udtf.register(name, udtf(TdJoin, returnType="i: int, j: int, dist: double"))
    spark.udtf.register("temporal_walk", udtf(TemporalWalk))
    spark.udtf.register("temporal_walk_by", udtf(TemporalWalkBy))
    spark.udtf.register("clear_cache", udtf(ClearCache, returnType="message: string"))


class SeriesCache:
    """Series of one type kept for several joins; clear() lets them go.

    A table is known by its object, which the cache holds on to: another table never gets its rows.
    """

    def __init__(self) -> None:
        self._kept: dict[tuple[int, str], tuple[DataFrame, DataFrame]] = {}

    def series(self, series: DataFrame, ts_type: str) -> DataFrame:
        key = (id(series), ts_type)
        if key not in self._kept:
            self._kept[key] = series, series.where(series["ts_type"] == ts_type).persist()
        return self._kept[key][1]

    def clear(self) -> str:
        for _, df in self._kept.values():
            df.unpersist()
        self._kept.clear()
        return "Cache cleared"

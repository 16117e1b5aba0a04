"""The temporal subsequence join on pairs of nodes.

For each pair of series, windows of w points whose places stand in the relation are z-normalised; those with cosine at or
over the threshold compete, and the pair keeps the one of least Euclidean distance (rounded to five places; of equal ones
the last source window, then the first target window). Pairs without such windows give no row.

Only series travel, never their windows: windows are made inside the kernel. Small tables of series are joined to each pair.
Large ones meet the pairs in blocks: sources are hashed into p rows and targets into p columns, pairs go to the block of
their ends, and each block gets a series once, however many of its pairs have it. So at most 2 p copies of a series
travel, and the pairs of a hub lie in p blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.series import granularity
from loomgraph.operators import kernel
from loomgraph.operators.metrics import HopMetrics
from loomgraph.operators.relations import Relation
from loomgraph.session import ship, staged

METHODS = ("td", "stamp", "stomp")
_NAMES = ["src", "dst", "pin", "i", "j", "dist"]
#: Window pairs of one pair of series that a task looks through along diagonals; longer ones are shared.
SHARE_PAIRS = 1 << 28


def _rows(column: pa.Array, kind: type) -> list[np.ndarray]:
    """Each list as an array; nulls inside are NaN."""
    values = column.values.to_numpy(zero_copy_only=False).astype(kind)
    offsets = column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _grid(ta: np.ndarray, tb: np.ndarray, at: int) -> int | None:
    """Steps from the target's start to the source's place `at`, in the source's own step there; None off the grid."""
    step, gap = int(ta[at + 1] - ta[at]), int(ta[at] - tb[0])
    return None if step == 0 or gap % step else gap // step


def _found(w: int, relation: Relation, threshold: float, method: str, a: tuple[list, list], b: tuple[list, list], ia: np.ndarray, ib: np.ndarray, pins: np.ndarray, shares: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int, float]]:
    """(pair, i, j, dist) of each pair that matches: series ia of a (times, values) with series ib of b."""
    (times_a, values_a), (times_b, values_b) = a, b
    found: list[tuple[int, int, int, float]] = []
    alike: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
    for k in range(len(ia)):
        at, to = int(ia[k]), int(ib[k])
        times, goal, pin = times_a[at], times_b[to], 0
        n, m = len(times), len(goal)
        if not np.isnan(pins[k]):
            pin = int(pins[k])
            times = times[pin : pin + w]
            n = len(times)
            if n != w:
                continue
        if w > min(n, m):
            continue
        if method != "td":
            part, parts = shares[k] if shares else (0, 1)
            if (r := kernel.profile_join(values_a[at][pin : pin + n], times, values_b[to][:m], goal, w, relation, method, part, parts)) is not None:
                found.append((k, r[0] + pin, r[1], r[2]))
            continue
        offset = 0 if relation is Relation.NONE else _grid(times, goal, 0)
        if offset is not None:
            alike[n, m, offset].append((k, pin))
    for (n, m, offset), rows in alike.items():
        sources: dict[tuple[int, int], int] = {}
        targets: dict[int, int] = {}
        here = [sources.setdefault((int(ia[k]), pin), len(sources)) for k, pin in rows]
        there = [targets.setdefault(int(ib[k]), len(targets)) for k, _ in rows]
        xs, ys = np.array([values_a[k][pin : pin + n] for k, pin in sources]), np.array([values_b[k][:m] for k in targets])
        best = kernel.grid_join(xs, ys, w, relation, offset, threshold, np.array(here), np.array(there))
        found += [(k, int(best.i[p]) + pin, int(best.j[p]), float(best.dist[p])) for p, (k, pin) in enumerate(rows) if best.i[p] >= 0]
    return found


def _rows_of(ends: list[pa.Array], found: list[tuple[int, int, int, float]]) -> pa.RecordBatch:
    take = pa.array([f[0] for f in found], pa.int64())
    places = [pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.float64())]
    return pa.RecordBatch.from_arrays([*(e.take(take) for e in ends), *places], names=_NAMES)


def _kernel(w: int, relation: Relation, threshold: float, method: str):
    """Rows of src, dst, pin, ta, va, tb, vb and perhaps part, parts: pairs with their series."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pins = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            ta, va, tb, vb = (_rows(batch.column(k), kind) for k, kind in ((3, np.int64), (4, float), (5, np.int64), (6, float)))
            shares = list(zip(batch.column(7).to_pylist(), batch.column(8).to_pylist(), strict=True)) if batch.num_columns > 7 else None
            each = np.arange(batch.num_rows)
            yield _rows_of(batch.columns[:3], _found(w, relation, threshold, method, (ta, va), (tb, vb), each, each, pins, shares))

    return run


#: Bytes of series, as the planner estimates them, from which pairs are dealt to blocks; bytes of series that a block should get.
BLOCKED_BYTES, BLOCK_BYTES = 64 << 20, 16 << 20
#: Rows and columns of blocks at least, where there are any: pairs of a hub are shared by so many tasks.
LEAST_BLOCKS = 16
#: Pairs of a block that are worked on together.
TOGETHER = 4096


def block_rows(series: DataFrame) -> int:
    """How many rows and columns of blocks suit a stored table of series, by its size; 0: none, or not just one stored table.

    Estimates of joined or unstored tables are far off. Blocks without pairs cost nothing.
    """
    plan = series._jdf.queryExecution().optimizedPlan()
    if plan.collectLeaves().size() != 1 or not series.inputFiles():
        return 0
    size = int(str(plan.stats().sizeInBytes()))
    return 0 if size < BLOCKED_BYTES else min(1 << 20, max(LEAST_BLOCKS, -(-size // BLOCK_BYTES)))


def enough_blocks(series: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(series as a stored table, rows and columns of blocks): least, or as many as keep the series of a row to about BLOCK_BYTES.

    Points are counted, since files are smaller than what they hold: the memory of a block does not grow with the series.
    """
    if series._jdf.queryExecution().optimizedPlan().collectLeaves().size() != 1 or not series.inputFiles():
        series = staged(series, "block-series")
    points = series.agg(F.sum(F.size("ts"))).first()[0] or 0
    return series, min(1 << 20, max(least, -(-points * 16 // BLOCK_BYTES)))


def in_blocks(pairs: DataFrame, series: DataFrame, p: int) -> tuple[DataFrame, DataFrame]:
    """(pairs with block; block, side, node_id, ts, v): p x p blocks, and the series that each needs as sources (side 0) and targets.

    Each series is read and joined once, to the list of blocks that need it; it is copied behind that join.
    """
    part = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(p))
    dealt = pairs.withColumn("block", part("src") * p + part("dst"))
    needs = [dealt.select(F.col(c).alias("node_id"), (F.col("block") * 2 + side).alias("slot")) for side, c in ((0, "src"), (1, "dst"))]
    slots = needs[0].unionByName(needs[1]).groupBy("node_id").agg(F.collect_set("slot").alias("slots"))
    sent = series.join(slots, "node_id").select(F.explode("slots").alias("slot"), "node_id", "ts", "v")
    return dealt, sent.select(F.expr("slot div 2").alias("block"), F.pmod("slot", F.lit(2)).cast("int").alias("side"), "node_id", "ts", "v")


def _block_kernel(w: int, relation: Relation, threshold: float, method: str):
    def run(pairs: pa.Table, series: pa.Table) -> pa.Table:
        side = series.column("side").to_numpy()
        own = []
        for k in (0, 1):
            part = series.filter(pa.array(side == k)).combine_chunks()
            ts, v = (_rows(c.chunk(0), t) if c.num_chunks else [] for c, t in ((part.column("ts"), np.int64), (part.column("v"), float)))
            own.append((part.column("node_id"), (ts, v)))
        at = [pc.index_in(pairs.column(c), value_set=ids.combine_chunks()) for c, (ids, _) in zip(("src", "dst"), own, strict=True)]
        there = pairs.filter(pc.and_(pc.is_valid(at[0]), pc.is_valid(at[1]))).combine_chunks()
        ia, ib = (pc.index_in(there.column(c), value_set=ids.combine_chunks()).to_numpy() for c, (ids, _) in zip(("src", "dst"), own, strict=True))
        pins = there.column("pin").to_numpy().astype(float)
        out = []
        for lo in range(0, there.num_rows, TOGETHER):
            q = slice(lo, lo + TOGETHER)
            found = _found(w, relation, threshold, method, own[0][1], own[1][1], ia[q], ib[q], pins[q])
            out.append(_rows_of([there.column(c).slice(lo, TOGETHER).combine_chunks() for c in ("src", "dst", "pin")], found))
        if out:
            return pa.Table.from_batches(out)
        return pa.table([there.column("src"), there.column("dst"), there.column("pin"), *(pa.array([], t) for t in (pa.int32(), pa.int32(), pa.float64()))], names=_NAMES)

    return run


def td_join(pairs: DataFrame, series: DataFrame, ts_type: str, relation: str | None, w: int, threshold: float = 0.0, method: str = "td", blocks: int | None = None, metrics: HopMetrics | None = None) -> DataFrame:
    """(src, dst, pin, i, j, dist): the best windows of each pair that has any.

    pairs: src and dst (repeats are worked on once), and pin, if the source window is given: its place in src's series;
    the grid is then that of the window's own first step, and i is the pin. series: node_id, ts_type, ts (microseconds)
    and v. method stamp or stomp: the matrix-profile baselines, which read relations off timestamps and take no threshold.
    Windows of fewer than three points match only under the baselines; nodes without the series match nothing.
    blocks: rows and columns of blocks that pairs are dealt to, 0 for none, or more where series are many; without it, by the
    size of series. stomp shares its long pairs itself and has none. metrics: counts pairs and matches and times the kernel.
    """
    r = Relation.of(relation)
    if method not in METHODS:
        raise ValueError(f"{method!r} is no method; one of {', '.join(METHODS)}")
    if w < 1:
        raise ValueError("w must be positive")
    ship(pairs.sparkSession)
    s = series.where((F.col("ts_type") == ts_type) & (F.size("ts") >= max(w, 2)))
    p = pairs if "pin" in pairs.columns else pairs.withColumn("pin", F.lit(None).cast("int"))
    # pairs are few bytes and much work: tasks are by the setting, not by the size that adaptive execution would go by
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = p.select("src", "dst", F.col("pin").cast("int").alias("pin")).distinct().repartition(tasks, "src", "dst", "pin")
    if method == "td" and w <= 2:
        p = p.limit(0)
    kind = dict(pairs.dtypes)
    out = f"src {kind['src']}, dst {kind['dst']}, pin int, i int, j int, dist double"
    if method != "stomp" and (blocks := block_rows(s) if blocks is None else blocks) > 0:
        dealt, sent = in_blocks(p, *enough_blocks(s.select("node_id", "ts", "v"), blocks))
        run = _block_kernel(w, r, float(threshold), method)
        if metrics is not None:
            dealt, run = metrics.watch(dealt, "pairs"), metrics.timed(run)
        dealt, sent = dealt.repartition(tasks, "block"), sent.repartition(tasks, "block")
        found = dealt.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(run, out)
        return found if metrics is None else metrics.watch(found, "found")
    a = s.select(F.col("node_id").alias("src"), F.col("ts").alias("ta"), F.col("v").alias("va"))
    b = s.select(F.col("node_id").alias("dst"), F.col("ts").alias("tb"), F.col("v").alias("vb"))
    joined = p.join(a, "src").join(b, "dst").select("src", "dst", "pin", "ta", "va", "tb", "vb")
    run = _kernel(w, r, float(threshold), method)
    if metrics is not None:
        run = metrics.timed(run)
    if method != "stomp" or r not in (Relation.BEFORE, Relation.OVERLAPS):
        if metrics is None:
            return joined.mapInArrow(run, out)
        return metrics.watch(metrics.watch(joined, "pairs").mapInArrow(run, out), "found")
    # a pair of long series is shared out by diagonals, each share a row of its own, and the shares' rows are compared
    pairs_of_windows = (F.size("ta") - (w - 1)).cast("double") * (F.size("tb") - (w - 1))
    joined = joined.withColumn("parts", F.greatest(F.ceil(pairs_of_windows / SHARE_PAIRS), F.lit(1)).cast("int"))
    short = joined.where("parts = 1").drop("parts").mapInArrow(run, out)
    shares = joined.where("parts > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    shares = shares.select("src", "dst", "pin", "ta", "va", "tb", "vb", "part", "parts").repartition(tasks, "src", "dst", "pin", "part").mapInArrow(run, out)
    least = shares.groupBy("src", "dst", "pin").agg(F.min(F.struct("dist", (-F.col("i")).alias("i"), "j")).alias("b"))
    found = short.unionByName(least.select("src", "dst", "pin", (-F.col("b.i")).alias("i"), F.col("b.j").alias("j"), F.col("b.dist").alias("dist")))
    return found if metrics is None else metrics.watch(found, "found")


def compatible_pairs(pairs: DataFrame, series: DataFrame, ts_type: str) -> DataFrame:
    """pairs whose series are of one granularity (days, hours, minutes or seconds): the strict test, to be asked for before
    a join. Nodes without the series, and series of under two points or of an odd step, go with nothing."""
    unit = series.where(F.col("ts_type") == ts_type).select("node_id", granularity(F.col("ts")).alias("unit")).where("unit is not null")
    a = unit.select(F.col("node_id").alias("src"), "unit")
    b = unit.select(F.col("node_id").alias("dst"), F.col("unit").alias("other"))
    return pairs.join(a, "src").join(b, "dst").where("unit = other").select(*pairs.columns)


def classify(pairs: DataFrame, series: DataFrame, ts_type: str, w: int) -> DataFrame:
    """(src, dst, relation, n, dist): window pairs of each relation when none is asked for, as the baselines sort them.

    Each window pair is the first that holds of equal, meets, overlaps, before; n counts them, dist is the least distance.
    """
    ship(pairs.sparkSession)
    s = series.where((F.col("ts_type") == ts_type) & (F.size("ts") >= w))
    a = s.select(F.col("node_id").alias("src"), F.col("ts").alias("ta"), F.col("v").alias("va"))
    b = s.select(F.col("node_id").alias("dst"), F.col("ts").alias("tb"), F.col("v").alias("vb"))
    kind = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, va, tb, vb = (_rows(batch.column(k), t) for k, t in ((2, np.int64), (3, float), (4, np.int64), (5, float)))
            out = []
            for k in range(batch.num_rows):
                found = kernel.classified(va[k], ta[k], vb[k], tb[k], w)
                out += [(k, name, *found[name]) for name in found]
            take = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.float64())], names=["src", "dst", "relation", "n", "dist"])

    joined = pairs.select("src", "dst").distinct().join(a, "src").join(b, "dst").select("src", "dst", "ta", "va", "tb", "vb")
    return joined.mapInArrow(run, f"src {kind['src']}, dst {kind['dst']}, relation string, n long, dist double")

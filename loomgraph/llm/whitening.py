"""Whitening of embeddings by a one-sided Jacobi singular value decomposition.

Three scans of the vectors: whole-number sums give the mean; each task then compresses its centred rows, block by block, to one
upper triangle R (tall-and-skinny QR), and triangles are stacked and compressed again in groups until one is left; plane
rotations make R's columns orthogonal, and the rotations themselves, multiplied together, are the components. The columns' lengths
over sqrt(n) are the standard deviations: the covariance is never formed, so small ones keep their digits. The third scan
projects each centred row.

Between tasks travel triangles (dimensions squared), never vectors. One task holds FAN triangles at most; the driver gets the sums and
the components asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import ship, staged, tidy

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Triangles that one task stacks.
FAN = 16
#: Rows of a block that goes into a triangle.
BLOCK = 4096
#: A standard deviation of less than this part of the largest is rounding, not variance.
NO_VARIANCE = 1e-12
#: Entries from here on would not be whole numbers in a double once scaled.
HUGE = float(1 << 42)


def scaled(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def usable(vectors: DataFrame, columns: list[str], vector: str) -> DataFrame:
    """vectors' columns and v, the vector in doubles: rows without nulls, NaN or entries of 2^42 and more in it."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(*columns, v.alias("v"))
    return rows.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= HUGE)))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows of one length) for each length in a column of lists."""
    sizes = column.value_lengths().to_numpy()
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))[:-1]
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, values[offsets[at][:, None] + np.arange(d)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for _, m in _matrices(batch.column(0)):
            n, s = found.get(m.shape[1], (0, 0))
            found[m.shape[1]] = n + len(m), s + scaled(m).sum(axis=0)
    if found:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([s.tolist() for _, s in found.values()], pa.list_(pa.int64()))], names=["d", "n", "s"]
        )


def sums(rows: DataFrame) -> tuple[int, np.ndarray] | None:
    """n and the sums of the scaled entries of each dimension, of the vectors of the commonest length (of two, the longer)."""
    parts = staged(rows.select("v").where(F.size("v") > 0).mapInArrow(tidy(_sums), "d int, n long, s array<long>"), "sums")
    lengths = parts.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    own = parts.where(F.col("d") == lengths["d"]).select(F.posexplode("s").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
    return lengths["n"], np.array([r["x"] for r in own.orderBy("k").collect()], np.int64)


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n x - S, exactly: 64-bit numbers where they suffice, else Python's."""
    if n * int(np.abs(x).max(initial=0)) + int(np.abs(s).max(initial=0)) < 1 << 62:
        return n * x - s
    return n * x.astype(object) - s.astype(object)


def _square_sums(y: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly; None where it is over a long."""
    if y.dtype != object:
        about = (y.astype(float) ** 2).sum(axis=1)
        if about.max(initial=0) < 9e18:
            return (y * y).sum(axis=1).tolist()
    total = (y.astype(object) ** 2).sum(axis=1)
    return [t if t < 1 << 63 else None for t in total.tolist()]


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _triangles(n: int, s: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, r, held = len(s), np.empty((0, len(s))), []
        for batch in batches:
            for _, m in _matrices(batch.column(0)):
                held.append(deviations(scaled(m), n, s).astype(float) / n)
            if sum(map(len, held)) >= max(BLOCK, d):
                r, held = triangle(np.concatenate([r, *held])), []
        if held:
            r = triangle(np.concatenate([r, *held]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel()], pa.list_(pa.float64()))], names=["r"])

    return run


def _stack(d: int, table: pa.Table) -> np.ndarray:
    """One triangle of those in a table, in the order of their parts."""
    table = table.sort_by("part")
    return triangle(np.concatenate([np.array(x).reshape(-1, d) for x in table.column("r").to_pylist()]))


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of columns once, in rounds of pairs without a column in common."""
    ring, out = list(range(d + d % 2)), []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(a, b) for a, b in zip(ring[:half], ring[:half - 1:-1], strict=True) if max(a, b) < d]
        out.append((np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; right singular vectors as rows) of r: pairs of columns are rotated until all are orthogonal.

    The entry of a vector that is largest by amount is positive.
    """
    d = r.shape[1]
    columns, turned, least = np.ascontiguousarray(r.T), np.eye(d), np.sqrt(d) * np.finfo(float).eps
    for _ in range(sweeps):
        still = False
        for p, q in _rounds(d):
            a, b = columns[p], columns[q]
            aa, bb, ab = (np.einsum("ij,ij->i", x, y) for x, y in ((a, a), (b, b), (a, b)))
            turn = np.abs(ab) > least * np.sqrt(aa * bb)
            if not turn.any():
                continue
            still = True
            p, q, aa, bb, ab = p[turn], q[turn], aa[turn], bb[turn], ab[turn]
            zeta = (bb - aa) / (2 * ab)
            tangent = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = (1 / np.hypot(1, tangent))[:, None]
            s = c * tangent[:, None]
            for m in (columns, turned):
                x, y = m[p], m[q]
                m[p], m[q] = c * x - s * y, s * x + c * y
        if not still:
            break
    size = np.sqrt(np.einsum("ij,ij->i", columns, columns))
    order = np.argsort(-size, kind="stable")
    vectors = turned[order]
    lead = vectors[np.arange(d), np.abs(vectors).argmax(axis=1)]
    return size[order], vectors * np.where(lead < 0, -1.0, 1.0)[:, None]


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums s; the first components (rows), their variances (0: none), and the sum of all variances."""

    n: int
    s: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.variances]


def fit(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors of the commonest length; None if there is no vector."""
    if components < 1:
        raise ValueError("components is at least 1")
    ship(vectors.sparkSession)
    rows = usable(vectors, [], vector)
    if (found := sums(rows)) is None:
        return None
    n, s = found
    d = len(s)
    own = rows.where(F.size("v") == d).mapInArrow(tidy(_triangles(n, s)), "r array<double>")
    table = staged(own.withColumn("part", F.spark_partition_id()), "triangles")
    parts = table.agg(F.max("part")).first()[0] + 1
    while parts > FAN:

        def stacked(group: pa.Table) -> pa.Table:
            part = group.column("part")[0].as_py() // FAN
            return pa.table({"r": pa.array([_stack(d, group).ravel()], pa.list_(pa.float64())), "part": pa.array([part], pa.int32())})

        table = staged(table.groupBy(F.expr(f"part div {FAN}").alias("g")).applyInArrow(stacked, "r array<double>, part int"), "triangles")
        parts = -(-parts // FAN)

    def decomposed(group: pa.Table) -> pa.Table:
        sd, vectors = jacobi(_stack(d, group))
        e = np.where(sd > NO_VARIANCE * sd[0], sd, 0.0) ** 2 / n
        k = min(components, d)
        return pa.table({"component": pa.array(range(k), pa.int32()), "e": pa.array(e[:k]), "trace": pa.array([float((sd**2).sum() / n)] * k), "c": pa.array(vectors[:k].tolist(), pa.list_(pa.float64()))})

    got = table.groupBy(F.lit(0).alias("g")).applyInArrow(decomposed, "component int, e double, trace double, c array<double>").orderBy("component").collect()
    return Whitening(n, s, np.array([r["c"] for r in got]), np.array([r["e"] for r in got]), got[0]["trace"])


def transform(vectors: DataFrame, model: Whitening, columns: list[str], vector: str = "embedding") -> DataFrame:
    """columns of the usable vectors of the model's length, with deviation and whitened (an entry for each component).

    deviation: the sum over dimensions of (n x - S)^2, null where it is over a long. whitened is null for a component
    without variance.
    """
    n, s, d = model.n, model.s, len(model.s)
    sd = np.sqrt(model.variances)
    by = model.components / np.where(sd > 0, sd, np.nan)[:, None]
    rows = usable(vectors, columns, vector).where(F.size("v") == d)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = deviations(scaled(batch.column(len(columns)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)), n, s)
            white = (y.astype(float) / n) @ by.T
            flat = pa.array(white.ravel(), from_pandas=True)  # NaN: null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * white.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(_square_sums(y), pa.int64()), lists], names=[*columns, "deviation", "whitened"])

    ship(vectors.sparkSession)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], "deviation long, whitened array<double>"])
    return rows.mapInArrow(tidy(run), schema)


def identity_error(whitened: DataFrame, components: list[int]) -> float | None:
    """The largest entry, by amount, of the covariance of these places of the column whitened less the identity.

    Centred by the mean of a first pass before products are summed.
    """
    if not components:
        return None
    z = [F.get("whitened", F.lit(k)) for k in components]
    mean = whitened.agg(*[F.avg(c) for c in z]).first()
    centred = [c - m for c, m in zip(z, mean, strict=True)]
    pairs = [(a, b) for a in range(len(z)) for b in range(a + 1)]
    found = whitened.agg(*[F.avg(centred[a] * centred[b]) for a, b in pairs]).first()
    return max(abs(x - (a == b)) for x, (a, b) in zip(found, pairs, strict=True))


def whitened(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null, empty or hold null, NaN, infinite or huge (2^42 and more) entries have no rows and are not
    fitted; nor are vectors of another length than the commonest one. Repeated rows and repeated or null ids are vectors
    of their own. Fewer dimensions than components give a component for each dimension. A component without variance
    (all vectors alike, or fewer vectors than dimensions) has whitened null and explained 0, or null if there is no variance
    at all; identity_error is over the others, null without any. Equal variances leave the choice of their components
    open, the same for all rows. An empty table gives no rows. Other columns are not read.
    """
    spark: SparkSession = vectors.sparkSession
    model = fit(vectors, components, vector)
    if model is None:
        kind = dict(vectors.dtypes)[id_column]
        return spark.createDataFrame([], f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = staged(transform(vectors, model, [id_column], vector), "whitened")
    error = identity_error(rows, [k for k, e in enumerate(model.variances) if e > 0])
    share = F.array(*[F.lit(x).cast("double") for x in model.explained()])
    out = rows.select(id_column, "deviation", F.posexplode("whitened").alias("k", "w"))
    return out.select(
        id_column, (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"), F.get(share, F.col("k")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )

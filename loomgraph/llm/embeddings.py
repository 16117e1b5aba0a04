"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

A unit vector x is rotated at random and coded by the signs of its coordinates; with the code goes the correction factor
f = <code, x>, where code is the sign vector over sqrt(d). For another unit vector q, <code, q> / f is an unbiased estimate
of <x, q> with standard error below sqrt((1 - f*f) / (f*f * (d - 1))). A pair whose upper confidence bound (`SURE` standard
errors) is below the threshold is settled; all others are computed exactly, in double precision.

Pairs are looked at where vectors of one label meet in a bucket of one of `TABLES` tables: a bucket is the axis and sign
that is nearest after each of two further random rotations. Vectors with cosine 0.97 or more share nearly always one of
twelve buckets, those with 0.93 in most cases; a pair counts in the first table in which it meets, so once. Large buckets
are cut into chunks that meet pairwise in tasks of their own. Tasks return link counts and spanning edges, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.components import Forest, connected
from loomgraph.session import ship, staged, tidy

THRESHOLD, TABLES, SURE, CHUNK, SEED = 0.93, 12, 5.0, 2048, 17


@lru_cache(64)
def rotation(d: int, k: int) -> np.ndarray:
    """The k-th random rotation of d dimensions, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, d, k)).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision; large and small numbers are safe."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs packed to bytes, correction factors)."""
    d = units.shape[1]
    turned = units @ rotation(d, 0)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(d)


def buckets(units: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """(rows, tables): in each table, the nearest axis and sign after each of two rotations."""
    n, d = units.shape
    out, every = np.zeros((n, tables), np.int32), np.arange(n)
    for t in range(tables):
        for k in (0, 1):
            turned = units @ rotation(d, 1 + 2 * t + k)
            axis = np.abs(turned).argmax(axis=1)
            out[:, t] = out[:, t] * 2 * d + axis * 2 + (turned[every, axis] > 0)
    return out


def estimates(codes: np.ndarray, factors: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of coded rows with units, and the standard error of each coded row."""
    d = units.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    turned = (units @ rotation(d, 0)).astype(np.float32)
    est = (signs @ turned.T) / np.float32(np.sqrt(d)) / factors[:, None].astype(np.float32)
    return est, np.sqrt(np.maximum(1 - factors**2, 0) / (factors**2 * max(d - 1, 1)))


def linked(units: np.ndarray, codes: np.ndarray, factors: np.ndarray, keys: np.ndarray, table: int, threshold: float, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions i < j) of a bucket with cosine at or over the threshold that meet in no earlier table.

    own: with two chunks, which row is of which; then only pairs across them.
    """
    n = len(units)
    for at in range(0, n, 256):
        rows = np.arange(at, min(at + 256, n))
        est, error = estimates(codes[rows], factors[rows], units[at:])
        open_ = est + SURE * error[:, None].astype(np.float32) >= threshold - 1e-4
        open_ &= np.arange(at, n)[None, :] > rows[:, None]
        if own is not None:
            open_ &= own[rows][:, None] != own[None, at:]
        i, j = np.nonzero(open_)
        if not len(i):
            continue
        i, j = i + at, j + at
        if table:
            fresh = np.ones(len(i), bool)
            for k in range(table):
                fresh &= keys[i, k] != keys[j, k]
            i, j = i[fresh], j[fresh]
        for lo in range(0, len(i), 1 << 15):
            a, b = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
            sure = np.einsum("ij,ij->i", units[a], units[b]) >= threshold
            if sure.any():
                yield a[sure], b[sure]


_CODED = "label long, uid long, n long, dim int, keys binary, code binary, factor double, vec binary"


def _coder(tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, uid, n = (batch.column(k).to_pylist() for k in range(3))
            by_dim: dict[int, list[tuple[int, np.ndarray]]] = {}
            for k, v in enumerate(batch.column(3)):
                values = v.values
                if values is None or not len(values) or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(float)
                if np.isfinite(x).all() and x.any():
                    by_dim.setdefault(len(x), []).append((k, x))
            for d, rows in by_dim.items():
                at = [k for k, _ in rows]
                units = unit(np.array([x for _, x in rows]))
                code, factor = encode(units)
                keys = buckets(units, tables)
                columns = [[label[k] for k in at], [uid[k] for k in at], [n[k] for k in at], [d] * len(at), [x.tobytes() for x in keys], [x.tobytes() for x in code], factor, [x.tobytes() for x in units]]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["label", "uid", "n", "dim", "keys", "code", "factor", "vec"])

    return run


def _meet(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket; a bucket's rows may go on in the next batch."""

        def close(rows: list[tuple]) -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            d, table, lo, hi = rows[0][1], rows[0][2], rows[0][4], rows[0][5]
            uid, n = np.array([r[7] for r in rows]), np.array([r[8] for r in rows])
            units = np.frombuffer(b"".join(r[12] for r in rows)).reshape(len(rows), d)
            codes = np.frombuffer(b"".join(r[10] for r in rows), np.uint8).reshape(len(rows), -1)
            keys = np.frombuffer(b"".join(r[9] for r in rows), np.int32).reshape(len(rows), -1)
            own = np.array([r[6] for r in rows]) if lo != hi else None
            links, forest = np.zeros(len(rows), np.int64), Forest()
            for a, b in linked(units, codes, np.array([r[11] for r in rows]), keys, table, threshold, own):
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                for x, y in zip(a.tolist(), b.tolist(), strict=True) if len(a) < 64 else _thin(a, b):
                    forest.join(x, y)
            hit = np.flatnonzero(links)
            if not len(hit):
                return None
            return pa.RecordBatch.from_arrays([pa.array(uid[hit]), pa.array(links[hit]), pa.array(uid[[forest.root(x) for x in hit.tolist()]])], names=["uid", "links", "other"])

        held: list[tuple] = []
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True))
            start = 0
            for k, r in enumerate(rows):
                if held and start == 0 and k == 0 and r[:6] != held[0][:6]:
                    if (out := close(held)) is not None:
                        yield out
                    held = []
                if k and r[:6] != rows[k - 1][:6]:
                    if (out := close(held + rows[start:k])) is not None:
                        yield out
                    held, start = [], k
            held += rows[start:]
        if (out := close(held)) is not None:
            yield out

    return run


def _thin(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges to each position's least reachable one: as many as positions, not as pairs."""
    label = np.arange(int(max(a.max(), b.max())) + 1)
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            break
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        label = label[label]
    touched = np.unique(np.concatenate((a, b)))
    return zip(touched.tolist(), label[touched].tolist(), strict=True)


def duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors (vec_id, embedding, label).

    Rows are compared with equal, not null labels and equal numbers of components. Null, empty and zero vectors and those
    with a null or non-finite component link with nothing and are kept. Rows that repeat a vector are linked vectors of
    their own (identical ones are worked on once); rows that repeat a vec_id as well count each other. component_id is the
    smallest vec_id reachable. Other columns are not read; an empty table gives no row.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    v = v.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    same = ["label", "h1", "h2"]
    usable = v.where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    distinct = usable.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.any_value("embedding").alias("embedding"))
    distinct = staged(distinct.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    coded = staged(distinct.select("label", "uid", "n", "embedding").mapInArrow(tidy(_coder(tables)), _CODED), "codes")

    # rows by bucket; buckets over the chunk size become pairs of chunks
    rows = coded.withColumn("table", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
    rows = rows.withColumn("bucket", F.expr("substring(keys, table * 4 + 1, 4)"))
    at = ["label", "dim", "table", "bucket"]
    large = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > chunk)
    large = staged(large.withColumn("m", F.ceil(F.col("size") / chunk).cast("int")).drop("size"), "large")
    rows = rows.join(large, at, "left").withColumn("m", F.coalesce("m", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("uid"), F.col("m")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.withColumn("lo", F.least("own", "with")).withColumn("hi", F.greatest("own", "with"))
    order = [*at, "lo", "hi"]
    rows = rows.select(*order, "own", "uid", "n", "keys", "code", "factor", "vec").repartition(*order).sortWithinPartitions(*order)
    met = staged(rows.mapInArrow(tidy(_meet(threshold)), "uid long, links long, other long"), "links")

    counts = staged(met.groupBy("uid").agg(F.sum("links").alias("links")), "counts")
    owner = coded.select("uid").join(distinct.select("uid", *same, "n", "least"), "uid")
    found = connected(met.select("uid", "other"), "uid", "other")
    if found is None:
        owner = owner.withColumn("top", F.col("least"))
    else:
        members = staged(owner.withColumn("node", F.xxhash64("uid")).join(found, "node").select("uid", "root", "least"), "members")
        top = staged(members.groupBy("root").agg(F.min("least").alias("top")), "tops")
        owner = owner.join(members.join(top, "root").select("uid", "top"), "uid", "left").withColumn("top", F.coalesce("top", "least"))
    owner = owner.join(counts, "uid", "left")
    owner = staged(owner.select(*same, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "top"), "owners")
    out = v.select("vec_id", *same).join(owner, same, "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("top", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

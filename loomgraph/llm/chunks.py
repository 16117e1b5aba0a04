"""Comparison of all rows of a group that are not of one class, in pairs of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import staged


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray | pa.Array]]:
    """The columns of rows sorted by their first column, in pieces that end where its value changes."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        keys = batch.column(0).to_numpy()
        if keys[0] == keys[-1] and rest[0].column(0)[-1].as_py() == keys[0]:
            continue  # one bucket goes on
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        yield pa.Table.from_batches([*rest[:-1], batch.slice(0, cut)]).combine_chunks().columns
        rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().columns


def chunk_pairs(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """rows (group, class, uid, bytes, ...; a written table) as often as they are compared, with key and side.

    Groups are cut into chunks, and pairs of chunks are compared: what has one key, one side with the other, or a chunk, of
    side 0, with itself. A class of more than a chunk has chunks of its own, which are not compared with each other;
    smaller classes share chunks.
    """
    sizes = rows.groupBy("group", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    parts = F.ceil(F.greatest(F.col("n") / most_rows, F.col("bytes") / most_bytes)).cast("int")
    sizes = staged(sizes.withColumn("m", parts), "class-sizes")
    small = sizes.where("m = 1").groupBy("group").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select("group", parts.alias("pool"))
    sizes = sizes.select("group", "class", "m").join(small, "group", "left")
    own = F.when(F.col("m") > 1, F.xxhash64("class", F.pmod(F.xxhash64("uid"), F.col("m")))).otherwise(F.pmod(F.xxhash64("class"), F.col("pool")))
    dealt = rows.join(sizes, ["group", "class"]).select(*rows.columns, own.alias("chunk"), F.when(F.col("m") > 1, F.col("class")).alias("only"))
    chunks = staged(dealt.select("group", "chunk", "only").distinct(), "chunks")
    two = chunks.select("group", F.col("chunk").alias("with"), F.col("only").alias("its"))
    pairs = chunks.join(two, "group").where("chunk <= with and (only is null or its is null or only <> its)")
    pairs = pairs.select("group", "chunk", "with", F.xxhash64("group", "chunk", "with").alias("key"))
    ends = pairs.select("group", "chunk", "key", F.lit(0).alias("side")).union(pairs.where("chunk <> with").select("group", "with", "key", F.lit(1)))
    return dealt.join(staged(ends, "chunk-pairs"), ["group", "chunk"]).select("key", "side", *rows.columns)

"""A file that is one JSON array of objects, read by many tasks.

Spark's text reader cuts the file at closing braces, wherever its splits are. A first pass finds for each split how it would
change depth, were its start inside a string or outside; running sums over the splits tell which it is. A second pass then puts the
pieces of each element together; what a split begins and another ends are fragments, joined by a small shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.session import ship, staged

_END = "}"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray, np.ndarray]]:
    """(file and start of a split, bytes, ends of the pieces in them), each piece with the brace that it was cut at."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.binary_join_element_wise(batch.column(0).cast(pa.large_string()), pa.scalar(_END, pa.large_string()), pa.scalar("", pa.large_string()))
        path, start = batch.column(1).to_pylist(), batch.column(2).to_numpy()
        at = 0
        while at < batch.num_rows:
            to = at + 1
            while to < batch.num_rows and start[to] == start[at] and path[to] == path[at]:
                to += 1
            part = text.slice(at, to - at)
            ends = np.cumsum(pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64))
            first = int(np.frombuffer(part.buffers()[1], np.int64)[part.offset])
            yield (path[at], int(start[at])), np.frombuffer(part.buffers()[2], np.uint8)[first : first + ends[-1]], ends
            at = to


def _quotes(data: np.ndarray) -> np.ndarray:
    """How many quotes, escaped ones apart, there are up to each byte."""
    quote = data == ord('"')
    before = np.flatnonzero(quote[1:] & (data[:-1] == ord("\\"))) + 1
    for k in before.tolist():
        run = k
        while run and data[run - 1] == ord("\\"):
            run -= 1
        quote[k] = (k - run) % 2 == 0
    return np.cumsum(quote)


def _steps(data: np.ndarray) -> np.ndarray:
    up, down = (data == ord("{")) | (data == ord("[")), (data == ord("}")) | (data == ord("]"))
    return up.astype(np.int64) - down


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], list[int]] = {}
    for key, data, _ in _pieces(batches):
        s = found.setdefault(key, [0, 0, 0])
        inside, step = (_quotes(data) + s[0]) % 2, _steps(data)
        s[1] += int(step[inside == 0].sum())
        s[2] += int(step[inside == 1].sum())
        s[0] = int(inside[-1])
    columns = [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64())]
    columns += [pa.array([s[n] for s in found.values()], pa.int64()) for n in range(3)]
    yield pa.RecordBatch.from_arrays(columns, names=["path", "start", "quotes", "outside", "inside"])


def _elements(begins: dict[tuple[str, int], tuple[int, int]]):
    """Whole elements, and the fragments at a split's ends (opens: it begins an element)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, opens, inside, depth, number = None, b"", True, 0, 0, 0

        def rows(texts: list[bytes] | pa.Array, whole: bool, opens: bool) -> pa.RecordBatch:
            nonlocal number
            n = len(texts)
            text = pa.array([t.decode() for t in texts], pa.large_string()) if isinstance(texts, list) else texts
            columns = [pa.array([now[0]] * n, pa.string()), pa.array([now[1]] * n, pa.int64()), pa.array(range(number, number + n), pa.int64()), pa.array([whole] * n), pa.array([opens] * n), text.cast(pa.string())]
            number += n
            return pa.RecordBatch.from_arrays(columns, names=["path", "start", "nth", "whole", "opens", "text"])

        for key, data, ends in _pieces(batches):
            if key != now:
                if held:
                    yield rows([held], False, opens)
                now, held, number = key, b"", 0
                inside, depth = begins[key]
                opens = depth < 2  # else the split begins within an element
            quotes = (_quotes(data) + inside) % 2
            level = depth + np.cumsum(np.where(quotes == 0, _steps(data), 0))
            done = ends[(level[ends - 1] == 1) & (quotes[ends - 1] == 0)]
            inside, depth = int(quotes[-1]), int(level[-1])
            at = 0
            if len(done):
                yield rows([held + data[: done[0]].tobytes()], opens, opens)
                if len(done) > 1:
                    body = pa.py_buffer(np.ascontiguousarray(data[done[0] : done[-1]]))
                    yield rows(pa.LargeStringArray.from_buffers(len(done) - 1, pa.py_buffer((done - done[0]).astype(np.int64)), body), True, True)
                held, opens, at = b"", True, int(done[-1])
            held += data[at:].tobytes()
        if held:
            yield rows([held], False, opens)

    return run


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of an array, or of the arrays of several files, by a schema; fields that are missing or of another kind are null.

    As many tasks as the file has splits (spark.sql.files.maxPartitionBytes). Any layout of white space, and any text in
    strings; empty arrays have no rows.
    """
    ship(spark)
    text = spark.read.option("lineSep", _END).text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    # a row for each split, as the planner itself has
    splits = text.mapInArrow(_splits, "path string, start long, quotes long, outside long, inside long").groupBy("path", "start").agg(*[F.sum(c).alias(c) for c in ("quotes", "outside", "inside")])
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("within", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("depth", F.coalesce(F.sum(F.when(F.col("within") == 0, F.col("outside")).otherwise(F.col("inside"))).over(earlier), F.lit(0)))
    begins = {(r["path"], r["start"]): (int(r["within"]), int(r["depth"])) for r in splits.collect()}
    found = text.mapInArrow(_elements(begins), "path string, start long, nth long, whole boolean, opens boolean, text string")
    found = staged(found, "elements")
    order = Window.partitionBy("path").orderBy("start", "nth")
    parts = found.where("not whole").withColumn("element", F.sum(F.col("opens").cast("int")).over(order))
    joined = parts.groupBy("path", "element").agg(F.sort_array(F.collect_list(F.struct("start", "nth", "text"))).alias("p")).select(F.array_join(F.col("p.text"), "").alias("text"))
    elements = found.where("whole").select("text").unionByName(joined)
    plain = elements.select(F.regexp_replace("text", r"^[^{]*", "").alias("text")).where("startswith(text, '{')")
    return plain.select(F.from_json("text", schema).alias("r")).select("r.*")

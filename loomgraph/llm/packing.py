"""Packing documents into sequences of a fixed number of tokens by best-two-fit.

Texts are encoded once; only documents longer than a sequence are cut, into whole sequences and a first piece with the rest.
Whole sequences stay where they were written. All other pieces of one length are alike, so the packing is made of counts: a
bin is filled greedily, longest piece first; then its smallest piece gives way to two unpacked ones that leave less room, as
long as there are such two. A bin so filled is repeated while the counts last: the plan has some thousand kinds of bins whatever
the number of documents, and is all that the driver holds. Pieces are numbered within their length (by task, then by order in
the task, so that no length is ordered in one place) and take the places that the plan has for that number.

Pieces of a bin meet in one shuffle; what is shuffled are the pieces shorter than a sequence.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.bytelevel import ByteLevelEncoder
from loomgraph.session import fresh_path, ship, staged, tidy

TOKENIZER, END_ID, CAPACITY = "byte_bpe_50k.json", 0, 2048
#: Characters of text that are encoded together, about; tokens of a task that fills sequences, about.
TOGETHER, TASK_TOKENS = 8_000_000, 8 << 20
PIECES = "part int, nth long, sequence_id long, doc_id long, piece int, start long, length int, ids binary"
_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32())])
#: ids are little-endian unsigned 32-bit integers, one after another.
SEQUENCES = "sequence_id long, n_tokens int, ids binary, members array<struct<doc_id:bigint,piece:int,start:bigint,length:int>>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def cut(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of every piece of documents of so many tokens; the first piece takes the rest."""
    n = -(-counts // capacity)
    doc = np.repeat(np.arange(len(counts)), n)
    piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = counts - (n - 1) * capacity
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, first[doc], capacity)


_encoders: dict[str, ByteLevelEncoder] = {}


def _pieces(path: str, end_id: int, capacity: int):
    """Pieces of texts: those of a whole sequence have their number at once, others their place among the task's of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if path not in _encoders:
            _encoders[path] = ByteLevelEncoder(path)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy())
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (int(sizes[at - 1]) if at else 0) + TOGETHER, "right")))
                ids, n = _encoders[path].encode(batch.column(1).slice(at, to - at))
                text_ends = np.cumsum(n)
                ids, n = np.insert(ids, text_ends, end_id), n + 1
                doc, piece, start, length = cut(n, capacity)
                # the place of a piece among those of its length: sorted by length, counted from each length's first
                order = np.argsort(length, kind="stable")
                by = length[order]
                nth = np.empty(len(by), np.int64)
                nth[order] = np.arange(len(by)) - np.searchsorted(by, by) + seen[by]
                np.add.at(seen, length, 1)
                ends = np.concatenate(([0], np.cumsum(length))) * 4
                whole = pa.array(np.where(length == capacity, -1 - ((part << 40) + nth), 0), mask=length < capacity)
                columns = [pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth), whole, batch.column(0).slice(at, to - at).take(pa.array(doc)), pa.array(piece.astype(np.int32))]
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
                columns += [pa.array(start), pa.array(length.astype(np.int32))]
                for k in range(0, len(doc), 2000):
                    rows = [c.slice(k, 2000) for c in (*columns, blobs)]
                    yield pa.RecordBatch.from_arrays([*rows[:-1], rows[-1].cast(pa.binary())], names=["part", "nth", "sequence_id", "doc_id", "piece", "start", "length", "ids"])
                at = to

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of docs (doc_id, text), as a written table."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = fresh_path(docs.sparkSession, "pieces")
    rows.mapInArrow(tidy(_pieces(tokenizer or default_path(), end_id, capacity)), PIECES).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(PIECES).parquet(path)


def best_two(lengths: np.ndarray, left: np.ndarray, low: int, high: int) -> tuple[int, int] | None:
    """Two of the lengths (rising; left says how many there are of each) with the largest sum over low and up to high."""
    if not len(lengths):
        return None
    other = np.searchsorted(lengths, high - lengths, "right") - 1
    other = np.minimum(other, np.arange(len(lengths)))  # the second is not the longer one
    other = other - ((other == np.arange(len(lengths))) & (left < 2))
    total = np.where(other >= 0, lengths + lengths[np.maximum(other, 0)], 0)
    best = int(total.argmax())
    return (int(lengths[best]), int(lengths[other[best]])) if total[best] > low else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Kinds of bins: ([(length, how many of it), longest first], how often). counts: how many pieces have each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths are from 1 to the capacity")
    lengths = sorted(left)
    bins = []
    while lengths:
        used: Counter[int] = Counter()
        room = capacity
        k = len(lengths) - 1
        while k >= 0 and room:
            k = min(k, bisect_right(lengths, room) - 1)
            if k < 0:
                break
            take = min(left[lengths[k]], room // lengths[k])
            used[lengths[k]] = take
            room -= take * lengths[k]
            k -= 1
        while room:
            least = min(used)
            # no piece fits the room, so both of the two are shorter than the least one
            shorter = lengths[: bisect_left(lengths, least)]
            spare = np.array([left[n] - used[n] for n in shorter], np.int64)
            free = spare > 0
            two = best_two(np.array(shorter, np.int64)[free], spare[free], least, least + room)
            if two is None:
                break
            used[least] -= 1
            used[two[0]] += 1
            used[two[1]] += 1
            used = +used
            room += least - sum(two)
        often = min(left[n] // c for n, c in used.items())
        bins.append((sorted(used.items(), reverse=True), often))
        for n, c in used.items():
            left[n] -= c * often
            if not left[n]:
                del left[n]
                lengths.pop(bisect_left(lengths, n))
    return bins


def places(bins: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """The plan as a table: pieces of a length with numbers from `first` on, `often` for each copy, go to bins from `bin` on, at `offset`."""
    rows, seen, at = [], Counter(), 0
    for kinds, often in bins:
        offset = 0
        for n, c in kinds:
            rows.append((n, seen[n], often, at, offset))
            seen[n] += c * often
            offset += n * c
        at += often
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "often", "bin", "offset"), table.T, strict=True))


def _placed(table: dict[str, np.ndarray], capacity: int):
    """A column function (length, number within the length) -> bin * (capacity + 1) + offset."""
    key = (table["length"] << 48) + table["first"]

    @F.pandas_udf("long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.Series:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        k = np.searchsorted(key, (n << 48) + r, "right") - 1
        nth = r - table["first"][k]
        sequence = table["bin"][k] + nth % table["often"][k]
        return pd.Series(sequence * (capacity + 1) + table["offset"][k] + nth // table["often"][k] * n)

    return placed


def _flat(column: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of a column of binaries, and where each begins and the last ends in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return column.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])), offsets - offsets[0]


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences of pieces in the order of sequence and offset; one sequence may span batches."""

    def joined(table: pa.Table) -> pa.RecordBatch:
        t = table.combine_chunks().to_batches()[0]
        sequence = t.column(0).to_numpy()
        first = np.flatnonzero(np.diff(sequence, prepend=sequence[0] - 1))
        ends = np.append(first, len(sequence)).astype(np.int32)
        data, offsets = _flat(t.column(5))
        at = offsets[ends].astype(np.int32)
        members = pa.StructArray.from_arrays([t.column(k) for k in range(1, 5)], fields=list(_MEMBER))
        ids = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), data])
        return pa.RecordBatch.from_arrays(
            [t.column(0).take(pa.array(first)), pa.array(np.diff(at) // 4), ids, pa.ListArray.from_arrays(pa.array(ends), members)],
            names=["sequence_id", "n_tokens", "ids", "members"],
        )

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        last = table.column(0)[-1].as_py()
        until = int(np.searchsorted(table.column(0).to_numpy(), last))
        if until:
            yield joined(table.slice(0, until))
        rest = table.slice(until)
    if rest is not None:
        yield joined(rest)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """SEQUENCES of docs (doc_id, text): ids in order (token_ids() makes lists of them), and members, the pieces in them in order.

    Each text's ids and end_id are in exactly one place; start counts a piece's document's ids before it. A null or empty
    text is one piece, of end_id alone. Rows that repeat a doc_id, or have none, are documents of their own. Numbers of
    sequences are negative for those that are one piece of a longer document, from 0 on for the others. An empty
    table gives no sequences. Other columns are not read.
    """
    if capacity < 1 or capacity >= 1 << 15:
        raise ValueError("capacity is from 1 to 32767")
    spark = docs.sparkSession
    table = pieces(docs, tokenizer, end_id, capacity)
    short = table.where(F.col("length") < capacity)
    whole = table.where(F.col("length") == capacity)
    counts = staged(short.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # at most a row for each length of a sequence
    seen = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = staged(counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "piece-bases")
    one = F.array(F.struct("doc_id", "piece", "start", "length"))
    out = whole.select("sequence_id", F.col("length").alias("n_tokens"), "ids", one.alias("members"))
    if not seen:
        return out
    at = _placed(places(plan(seen, capacity)), capacity)(F.col("length"), F.col("base") + F.col("nth"))
    placed = short.join(base, ["length", "part"]).withColumn("at", at)
    step = F.lit(capacity + 1)
    placed = placed.select(F.expr(f"`at` div {capacity + 1}").alias("sequence_id"), "doc_id", "piece", "start", "length", "ids", F.pmod("at", step).alias("offset"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(n * c for n, c in seen.items()) // TASK_TOKENS))
    placed = placed.repartition(parts, "sequence_id").sortWithinPartitions("sequence_id", "offset").drop("offset")
    path = fresh_path(spark, "sequences")
    placed.mapInArrow(tidy(_filled), SEQUENCES).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(SEQUENCES).parquet(path).unionByName(out)


def token_ids(sequences: DataFrame) -> DataFrame:
    """sequences with ids as lists of integers."""
    ship(sequences.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data, offsets = _flat(batch.column(2))
                lists = pa.ListArray.from_arrays(pa.array((offsets // 4).astype(np.int32)), pa.array(np.frombuffer(data, "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists, batch.column(3)], names=["sequence_id", "n_tokens", "ids", "members"])

    return sequences.select("sequence_id", "n_tokens", "ids", "members").mapInArrow(tidy(run), SEQUENCES.replace("ids binary", "ids array<int>"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        members = batch.column(2)
        n = members.value_lengths().to_numpy()
        parts = members.flatten()
        length = parts.field("length").to_numpy().astype(np.int64)
        ends = np.cumsum(length)
        first = np.concatenate(([0], ends))[np.cumsum(n) - n]
        data = memoryview(_flat(batch.column(1))[0])
        crc = [zlib.crc32(data[a:b]) for a, b in zip(((ends - length) * 4).tolist(), (ends * 4).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [parts.field("doc_id"), parts.field("piece"), parts.field("start"), pa.array(length), pa.array(crc, pa.int64()), batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(ends - length - np.repeat(first, n))],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def digests(sequences: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece, read from packed sequences."""
    ship(sequences.sparkSession)
    rows = sequences.select("sequence_id", "ids", "members")
    return rows.mapInArrow(tidy(_digests), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by pivot distance tables.

A fingerprint's bit is 1 if it is set in over half of the XXH64 values (seed 42) of the text's shingles. Two fingerprints
link at `radius` or fewer differing bits; a document's class is its connected component.

Candidates: the 64 bits are cut into `blocks` blocks. Fingerprints within `radius` bits differ in at most `radius` blocks,
so they agree wholly in at least `blocks - radius`. Agreement in a block is the pivot test with difference 0: a
block's distances to the zero pattern and to its unit patterns are as much as its bits, so equal distance rows are an
equi-join key. Each fingerprint goes under every choice of `blocks - radius` blocks. Below a key, Hamming distances to
`PIVOTS` reference fingerprints are computed once; pairs whose largest coordinate difference is over the radius are
discarded (the triangle inequality), and the survivors are verified by their exact distance. A search from member to
member stops at what is not yet reached, so a dense group costs about its size, and gives a spanning forest, never
its pairs.

For near-duplicates by similarity, see similar_classes().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.chunks import chunk_pairs, whole_buckets
from loomgraph.llm.components import FOREST_NODES, Forest, connected
from loomgraph.llm.substrings import flagged, mixed, perhaps_in, shingles, word_hashes
from loomgraph.session import ship, staged, tidy

WIDTH, RADIUS, BLOCKS, PIVOTS, SEED, CHUNK = 4, 4, 7, 16, 42, 4096
#: Buckets of up to so many rows are compared at once for a whole batch.
SMALL = 24


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each run of `width` words (fewer words: the whole sequence; none: nothing)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The text's fingerprint, unsigned; 0 without words. Long texts are summed in pieces."""
    hashes = shingle_hashes(text, width)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        piece = hashes[at : at + (1 << 15)]
        bits = np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32).astype(np.int64)
    return int(np.packbits(counts * 2 > max(len(hashes), 1), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): one row for each row of docs, fp as a signed 64-bit integer; a null text has none of the words."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = np.array([fingerprint(x, width) for x in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, fp long")


def masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """For each choice of blocks in which close fingerprints agree, the bits of those blocks."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("needs 0 <= radius < blocks <= 64")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    bits = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(bits, blocks - radius)]


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same on every machine."""
    return np.array([xxhash.xxh64_intdigest(k.to_bytes(4, "little"), SEED) for k in range(n)], np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances, a row for each fingerprint and a column for each reference."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def groups_within(fps: np.ndarray, radius: int = RADIUS, table: np.ndarray | None = None, wide: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning edges (positions) of the graph that links distinct fingerprints within the radius; table: their distances.

    With wide fingerprints, only those link that are within WIDE_NEAR too.
    """
    table = distance_table(fps, pivots()) if table is None else table
    order = np.argsort(table[:, 0], kind="stable")
    table, fps, left = table[order], fps[order], np.arange(len(fps))  # left: not yet reached, by first coordinate
    wide = wide if wide is None else wide[order]
    found: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            first = table[left, 0]
            lo, hi = np.searchsorted(first, (table[x, 0] - radius, table[x, 0] + radius + 1))
            near = left[lo:hi]
            for k in range(1, table.shape[1], 5):  # the largest coordinate difference, a few columns at a time
                if not len(near):
                    break
                near = near[(np.abs(table[near, k : k + 5] - table[x, k : k + 5]) <= radius).all(axis=1)]
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= radius]
            if wide is not None and len(near):
                near = near[bits_apart(wide[near], wide[x]) <= WIDE_NEAR]
            if len(near):
                found += [(int(order[x]), int(order[y])) for y in near]
                queue += near.tolist()
                left = left[~np.isin(left, near, assume_unique=True)]
    return found


def near_in_small(keys: np.ndarray, fps: np.ndarray, table: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bits that differ) of all pairs within the radius in buckets of up to SMALL rows; rows sorted by key."""
    starts = np.r_[0, np.flatnonzero(np.diff(keys)) + 1]
    sizes = np.diff(np.r_[starts, len(keys)])
    size = np.repeat(sizes, sizes)
    for off in range(1, min(SMALL, int(sizes.max()))):
        i = np.flatnonzero((keys[off:] == keys[:-off]) & (size[off:] <= SMALL))
        i = i[(np.abs(table[i] - table[i + off]) <= radius).all(axis=1)]
        apart = np.bitwise_count(fps[i] ^ fps[i + off])
        i, apart = i[apart <= radius], apart[apart <= radius]
        yield i, i + off, apart


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    refs = pivots()
    for batch in batches:
        table = distance_table(batch.column(0).to_numpy().view(np.uint64), refs)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in table], pa.binary())], names=["fp", "distances"])


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key: each run of a key is one bucket."""
        forest = Forest()

        def flush() -> pa.RecordBatch:
            a, b = (pa.array(np.array(v, np.uint64).view(np.int64)) for v in forest.edges())
            forest.up.clear()
            return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        for columns in whole_buckets(batches):
            keys, fps = columns[0].to_numpy(), columns[1].to_numpy().view(np.uint64)
            table = np.frombuffer(b"".join(columns[2].to_pylist()), np.int8).reshape(len(keys), -1)
            for i, j, _ in near_in_small(keys, fps, table, radius):
                for x, y in zip(fps[i].tolist(), fps[j].tolist(), strict=True):
                    forest.join(x, y)
            starts = np.r_[0, np.flatnonzero(np.diff(keys)) + 1]
            ends = np.r_[starts[1:], len(keys)]
            for k in np.flatnonzero(ends - starts > SMALL).tolist():
                part = slice(starts[k], ends[k])
                for i, j in groups_within(fps[part], radius, table[part]):
                    forest.join(int(fps[part][i]), int(fps[part][j]))
            if len(forest.up) > FOREST_NODES:
                yield flush()
        yield flush()

    return run


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): spanning edges between the distinct fingerprints of column fp (a written table)."""
    ship(distinct.sparkSession)
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for k, m in enumerate(masks(radius, blocks))]
    known = staged(distinct.select("fp").mapInArrow(tidy(_tables), "fp long, distances binary"), "distances")
    large = distinct.select(F.explode(F.array(*keys)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk)
    large = staged(large.select("key", F.ceil(F.col("n") / chunk).cast("int").alias("m")), "large")
    rows = known.select("fp", "distances", F.explode(F.array(*keys)).alias("key"))
    rows = rows.join(large, "key", "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    key = F.when(F.col("m") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "with"), F.greatest("own", "with")))
    rows = rows.select(key.alias("key"), "fp", "distances")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_link(radius)), "a long, b long").where("a <> b")


def classes(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of docs.

    component_id is the smallest doc_id reachable. Null and wordless texts have fingerprint 0 and link like any other;
    equal doc_ids give equal rows; rows of a null doc_id get a class but never name one; an empty table gives no row;
    other columns are not read.
    """
    fps = staged(fingerprints(docs, width), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected(links(distinct, radius, blocks))
    if found is None:
        owner = distinct.select("fp", F.col("least").alias("component_id"))
    else:
        linked = staged(distinct.withColumn("node", F.xxhash64("fp")).join(found, "node").select("fp", "root", "least"), "linked")
        top = staged(linked.groupBy("root").agg(F.min("least").alias("top")), "tops")
        top = linked.join(top, "root").select("fp", "top")
        owner = distinct.join(top, "fp", "left").select("fp", F.coalesce("top", "least").alias("component_id"))
    owner = staged(owner, "owners")
    return fps.join(owner, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- near-duplicates by exact similarity, found through wide fingerprints ----

#: A wide fingerprint has 4 times 64 bits. In the first 64, texts of similarity 0.8 differ in NEAR bits at most.
WIDE, NEAR, CLOSE, MISSED, LEAST_BITS = 4, 17, 6, 0.02, 18
#: Pairs that differ in more of all bits are not proposed: five standard deviations more than texts of similarity 0.8.
WIDE_NEAR = 80


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits wide fingerprints (rows) differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def key_bits(texts: int, similarity: float = 0.8) -> list[list[int]]:
    """The bits of each key under which wide fingerprints meet.

    Keys have LEAST_BITS random bits, and one more for each fourfold number of texts, so that unrelated texts seldom meet
    and keys do not multiply. Texts of the similarity
    differ in angle / pi of their bits on average, where cos(angle) = 2s / (1 + s); there are so many keys that even with
    one standard deviation more they share none in MISSED of all cases only, whatever the number of texts.
    """
    size = LEAST_BITS + max(0, int(texts).bit_length() - LEAST_BITS) // 2
    differ = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    agree = (1 - differ - np.sqrt(differ * (1 - differ) / (64 * WIDE))) ** size
    keys = int(np.ceil(np.log(MISSED) / np.log1p(-agree)))
    rnd = np.random.default_rng(SEED)
    return [sorted(rnd.choice(64 * WIDE, size, replace=False).tolist()) for _ in range(keys)]


def shingle_set(text: str | bytes | None, width: int) -> np.ndarray:
    """The distinct shingles of a text, hashed and sorted (fewer words than width: the whole sequence; none: nothing)."""
    words = word_hashes(text)
    return np.unique(shingles(words, min(width, len(words)))) if len(words) else np.empty(0, np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE numbers of 64 bits; the bits of many hash functions of each shingle, by majority."""
    counts = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        piece = hashes[at : at + (1 << 13)]
        with np.errstate(over="ignore"):
            many = mixed(piece[:, None] + np.arange(1, WIDE + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
        bits = np.unpackbits(many.view(np.uint8).reshape(len(piece), -1), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32).astype(np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def _wide(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                f = np.array([wide_fingerprint(shingle_set(x, width)) for x in part.column(2).to_pylist()], np.uint64).reshape(-1, WIDE).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(WIDE))], names=["doc_id", "uid", *(f"f{k}" for k in range(WIDE))])

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, uid, f0, f1, ...) sorted by key: as few pairs as connect what is near in each bucket, and the bits they differ in.

    Near is what is within NEAR bits of f0 and within WIDE_NEAR of all. The nearest come first, each only if the task's
    pairs so far don't connect it. Pairs may fail when sets are compared; what they connect is then compared as a whole,
    by _crossing().
    """
    refs, forest = pivots(), Forest()
    out: list[tuple[int, int, int]] = []

    def flush() -> pa.RecordBatch:
        pairs = np.array(out, np.int64).reshape(-1, 3)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (1, 2, 0)], names=["a", "b", "apart"])

    def joining(pairs: list[tuple[int, int, int]]) -> None:
        out.extend((n, min(a, b), max(a, b)) for n, a, b in pairs if forest.join(a, b))

    def close(keys: np.ndarray, uid: np.ndarray, wide: np.ndarray) -> None:
        starts, fps = np.r_[0, np.flatnonzero(np.diff(keys)) + 1], np.ascontiguousarray(wide[:, 0])
        sizes, table, more = np.diff(np.r_[starts, len(keys)]), distance_table(fps, refs), []
        for i, j, _ in near_in_small(keys, fps, table, NEAR):
            apart = bits_apart(wide[i], wide[j])
            i, j, apart = (x[apart <= WIDE_NEAR] for x in (i, j, apart))
            more += zip(apart.tolist(), uid[i].tolist(), uid[j].tolist(), strict=True)
        joining(sorted(more))
        for k in np.flatnonzero(sizes > SMALL).tolist():
            part = slice(starts[k], starts[k] + sizes[k])
            u, f, t, w = uid[part], fps[part], table[part], wide[part]
            for radius in (CLOSE, NEAR):
                found = np.array(groups_within(f, radius, t, w), np.int64).reshape(-1, 2)
                i, j = found[:, 0], found[:, 1]
                joining(list(zip(bits_apart(w[i], w[j]).tolist(), u[i].tolist(), u[j].tolist(), strict=True)))

    for columns in whole_buckets(batches):
        keys, uid, *fps = (c.to_numpy() for c in columns)
        close(keys, uid, np.stack(fps, axis=1).view(np.uint64))
        if len(out) > 200_000:
            yield flush()
        if len(forest.up) > FOREST_NODES:
            forest.up.clear()
    yield flush()


def _fewest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs sorted by the bits they differ in: those that connect what the ones before don't.

    Every task of _candidates() connects a group anew, by pairs of its own; all of them are near, so any forest will do.
    """
    forest = Forest()
    for batch in batches:
        keep = [forest.join(a, b) for a, b in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_()))
        if len(forest.up) > FOREST_NODES:
            forest.up.clear()


def _crossing(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, side, uid, class, shingles) sorted by key and side: the sets of different classes are compared, those of
        one side if there is but one, and those of one side with those of the other. Links come out as a forest of classes."""
        for columns in whole_buckets(batches):
            keys, side, uid, cls = (c.to_numpy() for c in columns[:4])
            cuts = np.r_[0, np.flatnonzero(np.diff(keys)) + 1, len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                found = linked_sets([np.frombuffer(x, np.uint32) for x in columns[4].slice(lo, hi - lo).to_pylist()], side[lo:hi], cls[lo:hi], similarity)
                if found:
                    i, j = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(uid[lo:hi][i]), pa.array(uid[lo:hi][j])], names=["a", "b"])

    return run


def linked_sets(sets: list[np.ndarray], side: np.ndarray, cls: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs (positions) of similar sets that join all classes which similar sets join; sides as _crossing() has them."""
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes + 1)))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if sizes.sum() else np.empty(0, np.int64)
    flat, at = np.full(ends[-1], len(ids)), 0  # each set ends with a number that no set has, so that none is empty
    for k, n in enumerate(sizes.tolist()):
        flat[ends[k] : ends[k] + n] = ids[at : at + n]
        at += n
    mark = np.zeros(len(ids) + 1, bool)
    forest, found = Forest(), []
    second = int(np.searchsorted(side, 1))
    for x in range(second):
        first = second if second < len(sets) else x + 1
        if first == len(sets) or (cls[first:] == cls[x]).all():
            continue
        own = flat[ends[x] : ends[x + 1] - 1]
        mark[own] = True
        common = np.add.reduceat(mark[flat[ends[first] :]], ends[first:-1] - ends[first], dtype=np.int64)
        mark[own] = False
        good = (common >= similarity * (sizes[x] + sizes[first:] - common) - 1e-9) & (cls[first:] != cls[x])
        for y in (np.flatnonzero(good) + first).tolist():
            if forest.join(int(cls[x]), int(cls[y])):
                found.append((x, y))
    return found


#: Rows and bytes of sets that _crossing() compares with as many others, on average.
CROSS_ROWS, CROSS_BYTES = 512, 1 << 23


def crossing(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between the classes of each group, of rows (group, class, uid, shingles; a written table).

    Each is compared in pairs of chunks, as chunk_pairs() makes them.
    """
    dealt = chunk_pairs(rows.withColumn("bytes", F.length("shingles")), CROSS_ROWS, CROSS_BYTES).select("key", "side", "uid", "class", "shingles")
    return dealt.repartition("key").sortWithinPartitions("key", "side").mapInArrow(tidy(_crossing(similarity)), "a long, b long")


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.unique((shingle_set(x, width) >> np.uint64(32)).astype(np.uint32)).tobytes() for x in part.column(1).to_pylist()], pa.binary())], names=["uid", "shingles"])

    return run


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            keep = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1)], names=["a", "b"])

    return run


def similar_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): one row for each row of docs; documents link if their sets of shingles have the similarity.

    Fingerprints propose, sets decide: texts that share a key and are within NEAR bits are connected by proposed pairs, whose
    sets are compared; where some fail, all that the proposals connect is compared across its classes. A set has 32 bits of each shingle's hash: two texts of 1000 shingles have one
    by chance in common in 1 of 4000 cases, which is 0.001 of their similarity at most. Equal texts are one; texts without words link with each other. component_id
    is the smallest doc_id reachable; rows of a null doc_id get a class but never name one.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("uid"), F.col("text").cast("string").cast("binary").alias("raw"))
    names = [f"f{k}" for k in range(WIDE)]
    prints = staged(d.mapInArrow(tidy(_wide(width)), "doc_id long, uid long, " + ", ".join(f"{x} long" for x in names)), "wide")
    distinct = staged(prints.groupBy("uid").agg(F.min("doc_id").alias("least"), *(F.max(x).alias(x) for x in names)), "distinct")
    keys = []
    for k, bits in enumerate(key_bits(distinct.count(), similarity)):
        parts = [np.array(sum(1 << b % 64 for b in bits if b // 64 == w), np.uint64).astype(np.int64).item() for w in range(WIDE)]
        keys.append(F.xxhash64(F.lit(k), *(F.col(x).bitwiseAND(F.lit(m)) for x, m in zip(names, parts, strict=True) if m)))
    rows = distinct.select("uid", *names, F.explode(F.array(*keys)).alias("key")).select("key", "uid", *names)
    pairs = staged(rows.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_candidates), "a long, b long, apart long"), "proposed")
    for _ in range(2):  # what many tasks proposed is read by few, of so many rows, and what they keep by fewer
        few = pairs.coalesce(pairs.count() // FOREST_NODES + 1)
        pairs = staged(few.sortWithinPartitions("apart", "a", "b").mapInArrow(tidy(_fewest), "a long, b long, apart long"), "pairs")
    some = staged(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct(), "asked")
    reader = staged(prints.groupBy("uid").agg(F.min("doc_id").alias("doc_id")).join(some, "uid", "left_semi"), "readers")
    texts = perhaps_in(d, "uid", reader)
    texts = texts.join(reader, (texts["uid"] == reader["uid"]) & texts["doc_id"].eqNullSafe(reader["doc_id"]), "left_semi").select("uid", "raw")
    sets = staged(texts.mapInArrow(tidy(_sets(width)), "uid long, shingles binary").dropDuplicates(["uid"]), "sets")
    one, two = sets.select(F.col("uid").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("uid").alias("b"), F.col("shingles").alias("y"))
    links_ = staged(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(tidy(_similar(similarity)), "a long, b long"), "similar")
    found, group = connected(links_), connected(pairs)
    # a proposed pair may fail that stands for others: what proposals connect and verified links don't is compared as a whole
    if group is not None:
        nodes = group.select("node", F.col("root").alias("group"))
        nodes = nodes.join(found, "node", "left") if found is not None else nodes.withColumn("root", F.col("node"))
        nodes = staged(nodes.select("node", "group", F.coalesce("root", "node").alias("class")), "nodes")
        open_ = nodes.groupBy("group").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("group")
        rows = sets.withColumn("node", F.xxhash64("uid")).join(nodes, "node").join(open_, "group", "left_semi").select("group", "class", "uid", "shingles")
        more = staged(crossing(staged(rows, "open"), similarity), "crossing")
        if not more.isEmpty():
            found = connected(links_.union(more))
    if found is None:
        owner = distinct.select("uid", F.col("least").alias("component_id"))
    else:
        linked = staged(distinct.withColumn("node", F.xxhash64("uid")).join(found, "node").select("uid", "root", "least"), "linked")
        top = staged(linked.groupBy("root").agg(F.min("least").alias("top")), "tops")
        owner = distinct.join(linked.join(top, "root").select("uid", "top"), "uid", "left").select("uid", F.coalesce("top", "least").alias("component_id"))
    return prints.select("doc_id", "uid").join(staged(owner, "owners"), "uid").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the near-duplicates: of each class of similar_classes(), the row of its smallest doc_id stays.

    Of rows that repeat a doc_id, all stay or all go. Rows of a null doc_id stay.
    """
    found = similar_classes(docs, width, similarity).where("doc_id <> component_id").select("doc_id").distinct()
    found = staged(found.withColumn("id_hash_", F.xxhash64("doc_id")), "dropped")
    # most rows are surely none of these and go by without a shuffle
    rows = docs.select(F.struct("*").alias("row_"), F.xxhash64(F.col("doc_id").cast("long")).alias("id_hash_"))
    rows = flagged(rows, "id_hash_", found, "perhaps_dropped_")
    rest = rows.where("perhaps_dropped_").join(found.select("id_hash_"), "id_hash_", "left_anti")
    return rows.where("not perhaps_dropped_").select("row_.*").unionByName(rest.select("row_.*"))

"""Passages that repeat across documents, nearly or exactly, by compact windows.

A text is a sequence of shingles of `WIDTH` lower-cased words. For each of `HASHES` hash functions, the Cartesian tree over
the hash values of its shingles has a node for each position c, which is the minimum of all subsequences [i, j] with
l <= i <= c <= j <= r: a compact window (l, c, r). Windows of at least `LEAST_WORDS` words are all that matter, and only
they are made. An interval join of the windows of several hash functions gives, for each stretch of places at which
a subsequence may start, the minima that it shares; groups of equal minima across documents are candidates: four pairs of
hash functions find near-duplicates (similarity 0.8: 64 % for each pair and place, 98 % for one of them). One more function
hashes runs of nearly as many words as a passage has: equal passages share its minima whatever frequent line they hold, and
whoever shares such a run is alike.

Members of a group are aligned with its first member. Aligned stretches that touch are one, and every place in them is
verified by the shingles that both sides have. Where some are not alike to the first, the group's members are compared with
each other, but for those of one class. Equal texts are worked on once. Keys are dealt out by the bucket: a row has all of a
bucket that a task made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.chunks import chunk_pairs, whole_buckets
from loomgraph.session import ship, staged, tidy

WIDTH, LEAST_WORDS, SIMILARITY, HASHES = 5, 50, 0.8, 8
#: Words by which a long run is shorter than a passage: a window that shares one has a similarity of 0.8 at least.
SLACK = 5
#: Which hash functions make a key together; the last function is that of long runs.
BANDS = ((0, 1), (2, 3), (4, 5), (6, 7), (HASHES,))
#: Starts of a subsequence that one row has.
STARTS = 4096
SCHEMA = "doc_id long, start_word int, end_word int, class_doc_id long, class_start int"


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def word_hashes(text: str | bytes | None) -> np.ndarray:
    """A hash of each word (a run of characters other than ASCII white space, A-Z in lower case)."""
    raw = (text or b"") if not isinstance(text, str) else text.encode("utf-8", "surrogatepass")
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, raw.lower().split())), ">u8").astype(np.uint64)


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash of each run of width words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            x = x * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mixed(x)


def shingles_of(texts: list[bytes | None]) -> list[np.ndarray]:
    """The shingles of each text, made of all their words at once."""
    words = [word_hashes(x) for x in texts]
    ends = np.cumsum([len(x) for x in words]).tolist()
    every = shingles(np.concatenate(words)) if words else np.empty(0, np.uint64)
    return [every[b - len(x) : max(b - WIDTH + 1, b - len(x))] for x, b in zip(words, ends, strict=True)]


def lots(texts: list[bytes | None]) -> Iterator[slice]:
    """Runs of texts of LOCAL_BYTES together, or of one text."""
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to] or b"") < LOCAL_BYTES):
            size += len(texts[to] or b"")
            to += 1
        yield slice(at, to)
        at = to


def sliding_minima(keys: np.ndarray, t: int) -> np.ndarray:
    """The minimum of each run of t keys: minima of runs of 2, 4, 8, ... of them, and of two such runs that cover t."""
    n = len(keys) - t + 1
    if n <= 0:
        return keys[:0]
    size = 1
    while 2 * size <= t:
        keys, size = np.minimum(keys[:-size], keys[size:]), 2 * size
    return np.minimum(keys[:n], keys[t - size : t - size + n])


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """Values with their places in the low bits: no two are equal, and the leftmost of equal values is least."""
    b = np.uint64(bits)
    return (values >> b << b) | np.arange(len(values), dtype=np.uint64)


def compact_windows(values: np.ndarray, t: int) -> list[tuple[int, int, int]]:
    """(l, c, r), by c, of the Cartesian tree's nodes that cover t places or more.

    Such a node is the minimum of some run of t places, and so are its nearest smaller neighbours, unless they lie beyond
    the ends: the tree of the sliding minima has the same wide nodes.
    """
    bits = max(8, int(len(values)).bit_length())
    low = sliding_minima(_packed(values, bits), t)
    if not len(low):
        return []
    keep = np.concatenate(([True], low[1:] != low[:-1]))
    nodes = np.unique(low[keep])
    at = (nodes & np.uint64((1 << bits) - 1)).astype(np.int64)
    order = np.argsort(at)
    at, key = at[order].tolist(), nodes[order].tolist()
    left, right, stack = [0] * len(at), [len(values) - 1] * len(at), []
    for k, x in enumerate(key):
        while stack and key[stack[-1]] > x:
            right[stack.pop()] = at[k] - 1
        left[k] = at[stack[-1]] + 1 if stack else 0
        stack.append(k)
    return [(a, c, b) for a, c, b in zip(left, at, right, strict=True) if b - a + 1 >= t]


def long_runs(flat: np.ndarray, barrier: np.ndarray, t: int) -> np.ndarray:
    """A hash of the words of each run of t - SLACK shingles; 0 where a barrier is among them."""
    size = max(1, t - SLACK)
    n = len(flat) - size + 1
    if n <= 0:
        return flat[:0]
    x = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in [*range(0, size - 1, WIDTH), size - 1]:
            x = x * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + n]
    seen = np.concatenate(([0], np.cumsum(barrier)))
    return np.where(seen[size:] == seen[:-size], mixed(x), np.uint64(0))


def starts_of(values: np.ndarray, t: int, bits: int) -> np.ndarray:
    """For each start of a run of t places, the place of its minimum: the compact window that it belongs to.

    All starts of one compact window (l, c, r) are the interval from max(l, c - t + 1) to min(c, r - t + 1).
    """
    return (sliding_minima(_packed(values, bits), t) & np.uint64((1 << bits) - 1)).astype(np.int64)


def signatures(texts: list[np.ndarray], t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, place, low, high): for each band and each joint interval of starts, what its subsequences share.

    texts: shingles of each. place is that of the first function's minimum; low and high bound the starts. Texts are
    worked on side by side, parted by barriers that are less than any hash value.
    """
    texts = [x if len(x) >= t else x[:0] for x in texts]
    sizes = np.array([len(x) for x in texts], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64) + 1 if len(texts) else sizes
    total = int((sizes + 1).sum()) + 1
    flat, barrier = np.zeros(total, np.uint64), np.ones(total, bool)
    owner = np.zeros(total, np.int64)
    for k, (a, x) in enumerate(zip(begins.tolist(), texts, strict=True)):
        flat[a : a + len(x)], barrier[a : a + len(x)], owner[a : a + len(x)] = x, False, k
    bits = max(8, total.bit_length())
    least = np.uint64(1 << bits)
    hashed, minima = [], []
    for h in range(HASHES):
        with np.errstate(over="ignore"):
            v = mixed(flat + np.uint64(0xD6E8FEB86659FD93) * np.uint64(h + 1))
        hashed.append(v)
        minima.append(starts_of(np.where(barrier, np.uint64(0), np.maximum(v, least)), t, bits))
    v = long_runs(flat, barrier, t)
    hashed.append(v)
    minima.append(starts_of(np.where(v == 0, v, np.maximum(v, least)), t - max(1, t - SLACK) + 1, bits))
    if not len(minima[0]):
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty, empty, empty
    inside = ~barrier[minima[0]]
    out = []
    for b, band in enumerate(BANDS):
        changes = np.ones(len(inside), bool)
        changes[1:] = False
        for h in band:
            changes[1:] |= minima[h][1:] != minima[h][:-1]
        first = np.flatnonzero(changes)
        last = np.concatenate((first[1:], [len(inside)])) - 1
        keep = inside[first]
        first, last = first[keep], last[keep]
        key = np.full(len(first), b + 1, np.uint64)
        with np.errstate(over="ignore"):
            for h in band:
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + hashed[h][minima[h][first]])
        who = owner[first]
        # a repeated word or line moves the place of a minimum, not its value: such neighbours are one stretch
        new = np.ones(len(first), bool)
        new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1]) | (first[1:] != last[:-1] + 1)
        stop = np.concatenate((np.flatnonzero(new)[1:], [len(first)])) - 1 if len(first) else np.empty(0, np.int64)
        last, first, key, who = last[stop], first[new], key[new], who[new]
        # a row has 12 bits for its starts: a longer stretch is several rows
        parts = (last - first) // STARTS + 1
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        last, first, key, who = (np.repeat(x, parts) for x in (last, first, key, who))
        first = first + nth * STARTS
        last = np.minimum(last, first + STARTS - 1)
        base = begins[who]
        out.append((key, who, minima[band[0]][first] - base, first - base, last - base))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(5))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the number of their words in their place."""
    for batch in batches:
        n = [len(x.split()) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32())], names=["doc_id", "uid", "n_words"])


#: Rows whose groups a task makes by itself before they are dealt out, and bytes of text whose signatures are made together.
LOCAL_ROWS, LOCAL_BYTES = 500_000, 300_000
#: A bucket of keys has BUCKET_ROWS or so. There are FEW_BUCKETS at least, and over MANY_BUCKETS only where they would have over MOST_ROWS.
BUCKET_ROWS, MOST_ROWS, FEW_BUCKETS, MANY_BUCKETS = 100_000, 1_000_000, 1024, 4096
_ROWS = "bucket int, n_columns int, rows binary"


def buckets_of(n_words: int) -> int:
    """In how many buckets the keys of texts of so many words, which have about as many rows, are dealt out."""
    return max(FEW_BUCKETS, min(MANY_BUCKETS, n_words // BUCKET_ROWS), n_words // MOST_ROWS)


def packed_rows(columns: np.ndarray) -> bytes:
    """64-bit columns as bytes, first all lowest bytes of a column, then all second ones: what is small or sorted compresses."""
    return columns.view(np.uint8).reshape(*columns.shape, 8).transpose(0, 2, 1).tobytes()


def unpacked_rows(rows: bytes, n_columns: int) -> np.ndarray:
    planes = np.frombuffer(rows, np.uint8).reshape(n_columns, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(n_columns, -1).view(np.int64)


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key, where groups start in it, how large they are)."""
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return order, starts, np.diff(np.r_[starts, len(key)])


def _first_of(key: np.ndarray, uid: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of all rows that share their key, the least uid there, the least pos of that, whether a row is the first of its group)."""
    order, starts, sizes = _grouped(key)
    many = sizes > 1
    at = order[np.repeat(many, sizes)]
    if not len(at):
        return at, at, at, at.astype(bool)
    sizes = sizes[many]
    starts = np.cumsum(sizes) - sizes
    rep = np.repeat(np.minimum.reduceat(uid[at], starts), sizes)
    own = np.where(uid[at] == rep, pos[at], np.iinfo(np.int64).max)
    rep_pos = np.repeat(np.minimum.reduceat(own, starts), sizes)
    first = np.zeros(len(at), bool)
    same = np.flatnonzero(own == rep_pos)
    group = np.repeat(starts, sizes)[same]
    first[same[np.r_[True, group[1:] != group[:-1]]]] = True
    return at, rep, rep_pos, first


def _local(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """The first row of each group of a key, and the others, aligned with it: further places of the first one's own text too.

    A row of the result has all rows of a bucket, of three columns, or of five if they are aligned. Aligned rows are dealt out
    by their own hash, not by their key. So a group of any size sends one row from here to its key's bucket.
    """
    key, uid, pos = (np.concatenate([p[k] for p in parts]) for k in range(3))
    at, rep, rep_pos, first = _first_of(key, uid, pos)
    others = at[~first]
    single = np.ones(len(key), bool)
    single[others] = False
    firsts = np.flatnonzero(single)
    with np.errstate(over="ignore"):
        dealt = mixed(uid[others].view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * pos[others].view(np.uint64))
    out: list[tuple[int, int, bytes]] = []
    for by, columns in (
        (key[firsts].view(np.uint64), np.stack([key[firsts], uid[firsts], pos[firsts]])),
        (dealt, np.stack([key[others], uid[others], rep[~first], pos[others], rep_pos[~first]])),
    ):
        order = np.argsort(by)
        bucket = (by[order] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        columns = columns[:, order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True][: len(bucket) + 1]) if len(bucket) else bucket
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            out.append((int(bucket[a]), len(columns), packed_rows(np.ascontiguousarray(columns[:, a:b]))))
    columns_ = list(zip(*out, strict=True)) or [[]] * 3
    types = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns_, types, strict=True)], names=["bucket", "n_columns", "rows"])


def _emit(t: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_rows = 0
        seen: set[int] = set()
        for batch in batches:
            fresh = []  # a task works on equal texts once; copies in other tasks give the same rows again
            for k, x in enumerate(batch.column(0).to_pylist()):
                if x not in seen:
                    seen.add(x)
                    fresh.append(k)
            batch = batch.take(pa.array(fresh, pa.int64()))
            uid = batch.column(0).to_numpy()
            raw = batch.column(1).to_pylist()
            for lot in lots(raw):
                key, who, place, low, high = signatures(shingles_of(raw[lot]), t)
                parts.append((key.view(np.int64), uid[lot][who], place - low << 52 | (high - low) << 40 | low))
                n_rows += len(key)
                if n_rows > LOCAL_ROWS:
                    yield _local(parts, buckets)
                    parts, n_rows = [], 0
        if parts:
            yield _local(parts, buckets)

    return run


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: each row but its group's first (the least uid and pos) and that one's copies is aligned with the first.

    Rows that are aligned already pass through.
    """
    names = ["key", "uid", "rep", "pos", "rep_pos"]
    for columns in whole_buckets(batches):
        bucket = columns[0].to_numpy()
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            parts: dict[int, list[np.ndarray]] = {3: [], 5: []}
            for n, x in zip(*(c.slice(a, b - a).to_pylist() for c in columns[1:]), strict=True):
                parts[n].append(unpacked_rows(x, n))
            if parts[5]:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(parts[5], axis=1)], names=names)
            if parts[3]:
                key, uid, pos = np.concatenate(parts[3], axis=1)
                at, rep, rep_pos, _ = _first_of(key, uid, pos)
                key, uid, pos = key[at], uid[at], pos[at]
                other = (uid != rep) | (pos != rep_pos)
                yield pa.RecordBatch.from_arrays([pa.array(x[other]) for x in (key, uid, rep, pos, rep_pos)], names=names)


#: Starts that are verified together, and the grid on which the stretches that they need are shared.
PIECE, GRID = 128, 16


def _cover(t: int):
    names, types = ("uid", "a", "b", "rep", "shift"), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())

    def pieces(uid: np.ndarray, rep: np.ndarray, shift: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        parts = (b - a) // PIECE + 1
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        uid, rep, shift, a, b = (np.repeat(x, parts) for x in (uid, rep, shift, a, b))
        a = a + nth * PIECE
        columns = (uid, a, np.minimum(a + PIECE - 1, b), rep, shift)
        return pa.RecordBatch.from_arrays([pa.array(c).cast(x) for c, x in zip(columns, types, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by uid, rep, shift and low: touching intervals of starts are one, and come out in pieces."""
        last = [np.empty(0, np.int64)] * 5
        for batch in batches:
            if not batch.num_rows:
                continue
            uid, rep, shift, lo, hi = (np.concatenate((x, batch.column(k).to_numpy().astype(np.int64))) for k, x in enumerate(last))
            new = np.r_[True, (uid[1:] != uid[:-1]) | (rep[1:] != rep[:-1]) | (shift[1:] != shift[:-1])]
            reach = np.maximum.accumulate((np.cumsum(new) << 40) + hi) & ((1 << 40) - 1)  # the end of what came so far
            new[1:] |= lo[1:] > reach[:-1] + t
            first = np.flatnonzero(new)
            merged = [x[first] for x in (uid, rep, shift, lo)] + [reach[np.r_[first[1:], len(uid)] - 1]]
            yield pieces(*(x[:-1] for x in merged))
            last = [x[-1:] for x in merged]
        yield pieces(*last)

    return run


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """(uids, what is wanted of each, texts), lot by lot; of equal texts the first."""
    seen: set[int] = set()
    for batch in batches:
        rows = []
        for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if row[0] not in seen:
                seen.add(row[0])
                rows.append(row)
        for lot in lots([row[2] for row in rows]):
            uids, wanted, texts = map(list, zip(*rows[lot], strict=True))
            yield uids, wanted, texts


def _stretches(t: int):
    size = PIECE + t + 2 * GRID

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles from each wanted place on; 32 bits of a hash are enough to tell a few hundred apart."""
        for uids, wanted, texts in _fresh(batches):
            uid, at, rows = [], [], []
            for own, starts, x in zip(uids, wanted, shingles_of(texts), strict=True):
                sh = (x >> np.uint64(32)).astype(np.uint32)
                uid += [own] * len(starts)
                at += starts
                rows += [sh[k : k + size].tobytes() for k in starts]
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(at, pa.int32()), pa.array(rows, pa.binary())], names=["uid", "at", "shingles"])

    return run


def alike(own: np.ndarray, other: np.ndarray, shift: int, starts: np.ndarray, t: int, similarity: float) -> np.ndarray:
    """Which of the starts begin t shingles of own that are similar enough to other's at start + shift (any integer).

    Shingles that are equal place by place decide for all starts at once. Where they are too few, as beside an insertion,
    the start with most shingles that other has anywhere near is decided by the exact similarity of both sides' sets.
    """
    n = len(own)
    place = np.arange(n) + shift
    inside = (place >= 0) & (place < len(other))
    same = np.zeros(n + t + 1, np.int64)
    same[1 : n + 1] = inside & (own == other[np.clip(place, 0, max(len(other) - 1, 0))]) if len(other) else 0
    same = np.cumsum(same)
    enough = 2 * t * similarity / (1 + similarity)  # common shingles that make the similarity
    ok = (starts >= 0) & (starts + t <= n)
    hits = same[np.clip(starts, 0, n) + t] - same[np.clip(starts, 0, n)]
    good = ok & (hits >= enough - 1e-9)
    if not good.any() and ok.any() and (best := by_sets(own, other, shift, starts[ok], t, similarity)) >= 0:
        good[np.flatnonzero(ok)[best]] = True
    return good


def by_sets(own: np.ndarray, other: np.ndarray, shift: int, starts: np.ndarray, t: int, similarity: float) -> int:
    """Which of the starts (each has t shingles of own) begins most shingles that other has; -1 if their sets are not similar enough."""
    have = set(other.tolist())
    known = np.zeros(len(own) + 1, np.int64)
    np.cumsum(np.fromiter(map(have.__contains__, own.tolist()), bool, len(own)), out=known[1:])
    near = known[starts + t] - known[starts]
    best = int(np.argmax(near))
    if near[best] < 2 * t * similarity / (1 + similarity) - 1e-9:
        return -1
    s = int(starts[best])
    x, y = set(own[s : s + t].tolist()), set(other[max(s + shift, 0) : max(s + shift, 0) + t].tolist())
    return best if len(x & y) >= similarity * len(x | y) else -1


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of all rows of a binary column, where each row's begin and the last ones end)."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) // 4
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint32)[ends[0] : ends[-1]] if data else np.empty(0, np.uint32), ends - ends[0]


def _verify(t: int, similarity: float):
    enough = 2 * t * similarity / (1 + similarity) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("uid", "at", "to", "rep", "rep_at", "rep_to")
        for batch in batches:
            if not batch.num_rows:
                continue
            uid, a, b, rep, shift, at, rep_at = (batch.column(k).to_numpy().astype(np.int64) for k in range(7))
            (x, ends), (y, rep_ends) = _lines(batch.column(7)), _lines(batch.column(8))
            n, m = np.diff(ends), np.diff(rep_ends)
            # place by place, for all rows at once, as alike() does
            place = np.arange(max(int(n.max()), 1))
            there = place + (at - shift - rep_at)[:, None]
            inside = (place < n[:, None]) & (there >= 0) & (there < m[:, None])
            same = np.zeros(inside.shape, bool)
            same[inside] = x[(place + ends[:-1, None])[inside]] == y[(there + rep_ends[:-1, None])[inside]]
            sums = np.zeros((len(uid), len(place) + t + 1), np.int32)
            np.cumsum(same, axis=1, out=sums[:, 1 : len(place) + 1])
            sums[:, len(place) + 1 :] = sums[:, len(place), None]
            starts = (a - at)[:, None] + np.arange(int((b - a).max()) + 1)
            ok = (starts <= (b - at)[:, None]) & (starts >= 0) & (starts + t <= n[:, None])
            starts = np.clip(starts, 0, len(place))
            good = ok & (np.take_along_axis(sums, starts + t, axis=1) - np.take_along_axis(sums, starts, axis=1) >= enough)
            for k in np.flatnonzero(ok.any(axis=1) & ~good.any(axis=1)).tolist():
                own, other = x[ends[k] : ends[k + 1]], y[rep_ends[k] : rep_ends[k + 1]]
                nth = np.flatnonzero(ok[k])
                if (best := by_sets(own, other, int(at[k] - shift[k] - rep_at[k]), starts[k, nth], t, similarity)) >= 0:
                    good[k, nth[best]] = True
            row, nth = np.nonzero(good)
            new = np.r_[True, (row[1:] != row[:-1]) | (np.diff(nth) > t)][: len(row)]
            first, row = np.flatnonzero(new), row[new]
            lo, hi = a[row] + nth[first], a[row] + nth[np.r_[first[1:], len(nth)][: len(first)] - 1] + t + WIDTH - 1
            columns = (uid[row], lo, hi, rep[row], np.maximum(lo - shift[row], 0), np.maximum(hi - shift[row], 0))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, types, strict=True)], names=list(names))

    return run


def _passages() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by uid and start: verified windows that touch are one passage, of its least class."""
        now: list | None = None
        out: list[list] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            batch = pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types, strict=True)], names=["uid", "start_word", "end_word", "class_doc_id", "rep_at"])
            out.clear()
            return batch

        for batch in batches:
            for uid, at, to, rep, rep_at in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if now is not None and now[0] == uid and at <= now[2]:
                    now[2] = max(now[2], to)
                    now[3:] = min(now[3:], [rep, rep_at])
                else:
                    if now is not None:
                        out.append(now)
                    now = [uid, at, to, rep, rep_at]
            if len(out) > 20_000:
                yield flush()
        if now is not None:
            out.append(now)
        yield flush()

    return run


def flagged(rows: DataFrame, key: str, some: DataFrame, name: str = "perhaps_", most_bits: int = 27) -> DataFrame:
    """rows with a flag: false if its key (a 64-bit hash) is surely not among some's (a written table).

    A bitmap goes to the rows, so that texts that no join needs are not shuffled: 32 bits for each of some's rows, but at
    most 2^most_bits (16 MB). Beyond 2^most_bits rows it is full, and every row is flagged.
    """
    log_bits = min(most_bits, max(20, (32 * some.count()).bit_length()))
    place = F.pmod(F.col(key), F.lit(1 << log_bits))
    bits = some.select(F.shiftright(place, 15).alias("part_"), place.bitwiseAND(F.lit(32767)).alias("bit_"))
    bits = bits.groupBy("part_").agg(F.bitmap_construct_agg("bit_").alias("bits_"))
    bit = place.bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring("bits_", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (bit % 8 + 1).cast("int"))
    out = rows.withColumn("part_", F.shiftright(place, 15)).join(F.broadcast(staged(bits, "bitmap")), "part_", "left")
    return out.select(*rows.columns, F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False)).alias(name))


def perhaps_in(rows: DataFrame, key: str, some: DataFrame) -> DataFrame:
    """rows without most of those that a join with some would drop."""
    return flagged(rows, key, some).where("perhaps_").drop("perhaps_")


def _places(edges: DataFrame) -> DataFrame:
    """edges with shift, and lo and hi, the starts that both sides have."""

    def part(name: str, shift: int, bits: int) -> F.Column:
        return F.shiftright(F.col(name), shift).bitwiseAND(F.lit((1 << bits) - 1))

    for end, name in (("", "pos"), ("rep_", "rep_pos")):
        low = part(name, 0, 40)
        edges = edges.withColumns({f"{end}low": low, f"{end}high": low + part(name, 40, 12), f"{end}place": low + part(name, 52, 12)})
    shift = F.col("place") - F.col("rep_place")
    a, b = F.greatest("low", F.col("rep_low") + shift), F.least("high", F.col("rep_high") + shift)
    meet = {"shift": F.when(a <= b, shift).otherwise(F.col("low") - F.col("rep_low")), "lo": F.when(a <= b, a).otherwise(F.col("low")), "hi": F.when(a <= b, b).otherwise(F.col("low"))}
    return edges.withColumns(meet)


def _verified(met: DataFrame, every: DataFrame, t: int, similarity: float) -> DataFrame:
    """(uid, at, to, rep, rep_at, rep_to): what is alike of met (uid, rep, shift, lo, hi), that is starts lo to hi of uid beside those of rep."""
    asked = met.repartition("uid").sortWithinPartitions("uid", "rep", "shift", "lo")
    asked = asked.mapInArrow(tidy(_cover(t)), "uid long, a int, b int, rep long, shift int").distinct()
    grid = lambda x: F.greatest(x - F.pmod(x, F.lit(GRID)), F.lit(0))
    asked = staged(asked.withColumn("at", grid(F.col("a"))).withColumn("rep_at", grid(F.col("a") - F.col("shift"))), "asked")

    # the stretches of shingles that both sides need: on a grid, so that a text has no more of them than places
    wanted = asked.select("uid", "at").union(asked.select("rep", "rep_at")).distinct().groupBy("uid").agg(F.collect_list("at").alias("starts"))
    wanted = staged(wanted, "wanted")
    texts_ = perhaps_in(every, "uid", wanted).join(wanted, "uid").select("uid", "starts", "raw")
    shown = staged(texts_.mapInArrow(tidy(_stretches(t)), "uid long, at int, shingles binary"), "stretches")  # a repeat does no harm
    other = shown.select(F.col("uid").alias("rep"), F.col("at").alias("rep_at"), F.col("shingles").alias("rep_shingles"))
    both = asked.join(shown, ["uid", "at"]).join(other, ["rep", "rep_at"])
    both = both.select("uid", "a", "b", "rep", "shift", "at", "rep_at", "shingles", "rep_shingles")
    return staged(both.mapInArrow(tidy(_verify(t, similarity)), "uid long, at int, to int, rep long, rep_at int, rep_to int"), "verified")


#: Members of a group that are compared with as many others, on average, and bytes of their shingles.
CROSS_ROWS, CROSS_BYTES = 512, 1 << 23
#: Shingles that are looked up at a time.
ACROSS = 1 << 17


def linked_windows(shown: list[np.ndarray], before: np.ndarray, side: np.ndarray, cls: np.ndarray, t: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs (positions) of members with alike windows that join all classes which such pairs join.

    shown: the shingles of each, from its first start on; before: how many of them come before the place at which members are
    aligned. If there is a side 1, members of side 0 are compared with those of side 1, else with each other.
    """
    sizes = np.array([len(x) for x in shown], np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    values, flat = np.unique(np.concatenate(shown), return_inverse=True)
    label, found = np.unique(cls, return_inverse=True)[1], []
    ahead = int(before.max())
    lined = np.full((len(shown), int((ahead - before + sizes).max())), len(values))  # a row for each, by distance from the place
    lined[np.repeat(np.arange(len(shown)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] + before - ahead, sizes)] = flat
    enough = 2 * t * similarity / (1 + similarity) - 1e-9

    if lined.shape[1] < t:
        return []

    def windows(hits: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(hits), hits.shape[1] + 1), np.int32)
        np.cumsum(hits, axis=1, out=sums[:, 1:])
        return sums[:, t:] - sums[:, :-t]

    second = int(np.searchsorted(side, 1))
    from_ = second if second < len(shown) else 0
    step = max(1, min(ACROSS // max(len(flat), len(values)), ACROSS // max(1, lined.size)))
    for k in range(0, second, step):  # so many members of side 0 at a time; what they join spares the next ones' pairs
        xs = np.arange(k, min(k + step, second))
        first = max(from_, k + 1 if second == len(shown) else 0)
        if first == len(shown):
            break
        differ = label[xs][:, None] != label[None, first:]
        if second == len(shown):
            differ &= xs[:, None] < np.arange(first, len(shown))
        if not differ.any():
            continue
        mark = np.zeros((len(xs), len(values) + 1), bool)
        mark[np.repeat(np.arange(len(xs)), sizes[xs]), flat[ends[k] : ends[xs[-1] + 1]]] = True
        known = np.add.reduceat(mark[:, flat[ends[first] :]], ends[first:-1] - ends[first], axis=1, dtype=np.int32)
        i, near = np.nonzero(differ & (known >= enough))
        near += first
        beside = lined[near]
        # place by place; else the window with most shingles that the other has anywhere is decided by sets, as alike() does
        good = (windows((beside == lined[xs[i]]) & (beside < len(values))) >= enough).any(axis=1)
        perhaps = np.flatnonzero(~good)
        there = windows(mark[i[perhaps, None], beside[perhaps]])
        some = (there >= enough).any(axis=1)
        there = dict(zip(perhaps[some].tolist(), there[some], strict=True))
        good[list(there)] = True
        for p in np.flatnonzero(good).tolist():
            x, y = int(xs[i[p]]), int(near[p])
            if label[x] == label[y]:
                continue
            if p in there:
                begin = ahead - before[y]
                own = there[p][begin : begin + max(sizes[y] - t + 1, 0)]
                best = int(np.argmax(own)) if len(own) else 0
                if not len(own) or own[best] < enough:
                    continue
                at = max(best + before[x] - before[y], 0)
                one, two = set(flat[ends[y] + best : ends[y] + best + t].tolist()), set(flat[ends[x] + at : ends[x + 1]][:t].tolist())
                if len(one & two) < similarity * len(one | two):
                    continue
            label[label == label[y]] = label[x]
            found.append((x, y))
    return found


def _crossing(t: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, side, uid, class, place, low, high, shingles) sorted by key and side: what of one of them begins in another."""
        for columns in whole_buckets(batches):
            keys, side, uid, cls, place, low, high = (c.to_numpy() for c in columns[:7])
            cuts, rows = np.r_[0, np.flatnonzero(np.diff(keys)) + 1, len(keys)], []
            for k, to in zip(cuts, cuts[1:], strict=False):
                if (cls[k:to] == cls[k]).all():
                    continue
                shown = [np.frombuffer(x, np.uint32) for x in columns[7].slice(k, to - k).to_pylist()]
                for x, y in linked_windows(shown, (place - low)[k:to], side[k:to], cls[k:to], t, similarity):
                    x, y = x + k, y + k
                    shift = place[y] - place[x]
                    rows.append((uid[y], uid[x], shift, max(low[y], low[x] + shift), min(high[y], high[x] + shift)))
                    if rows[-1][3] > rows[-1][4]:
                        rows[-1] = (uid[y], uid[x], shift, low[y], high[y])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*rows, strict=True)], names=["uid", "rep", "shift", "lo", "hi"])

    return run


def _regions(t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles of all windows that begin from low to high."""
        for uids, wanted, texts in _fresh(batches):
            uid, low, high, rows = [], [], [], []
            for own, regions, x in zip(uids, wanted, shingles_of(texts), strict=True):
                sh = (x >> np.uint64(32)).astype(np.uint32)
                uid += [own] * len(regions)
                low += [r["low"] for r in regions]
                high += [r["high"] for r in regions]
                rows += [sh[r["low"] : r["high"] + t].tobytes() for r in regions]
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(rows, pa.binary())], names=["uid", "low", "high", "shingles"])

    return run


def _unsettled(met: DataFrame, sure: DataFrame, every: DataFrame, t: int, similarity: float) -> DataFrame:
    """(uid, rep, shift, lo, hi): pairs that connect what is alike in each group beside its first members.

    Members that are alike to the one they were aligned with are of its class. The classes of each group of three or more are
    compared with each other, all members of one with all of the other. Groups that have the same members, classes and shifts are one.
    """
    here = (F.col("met.uid") == F.col("sure.uid")) & (F.col("met.rep") == F.col("sure.rep"))
    here &= (F.col("hi") >= F.col("at")) & (F.col("lo") <= F.col("to") - F.lit(t + WIDTH - 1))
    open_ = staged(met.alias("met").join(sure.alias("sure"), here, "left_anti").select("key", "uid", "pos", "rep", "rep_pos"), "open")
    some = perhaps_in(met, "key", open_)
    some = some.join(some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key", "left_semi")
    some = some.join(open_.select("key").distinct(), "key", "left_semi")
    some = some.join(open_.distinct().withColumn("open", F.lit(1)), ["key", "uid", "pos", "rep", "rep_pos"], "left")
    some = staged(some.select("key", "uid", "place", "low", "high", "rep", "rep_place", "rep_low", "rep_high", F.coalesce("open", F.lit(0)).alias("open")), "crowded")

    all_ = some.select("key", "uid", "place", "low", "high", "open", F.when(F.col("open") == 1, F.struct("uid", "place")).otherwise(F.struct(F.col("rep").alias("uid"), F.col("rep_place").alias("place"))).alias("of"))
    reps = some.select("key", F.col("rep").alias("uid"), F.col("rep_place").alias("place"), F.col("rep_low").alias("low"), F.col("rep_high").alias("high"), F.lit(2).alias("open"), F.struct(F.col("rep").alias("uid"), F.col("rep_place").alias("place")).alias("of"))
    all_ = all_.union(reps).groupBy("key", "uid", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.struct("open", "of")).alias("best"))
    all_ = staged(all_.select("key", "uid", "place", "low", "high", "best.of"), "members")
    # the first of a task's rows may be of the class of the first of all
    top = all_.select("key", F.struct("uid", "place").alias("of"), F.col("of").alias("top"))
    all_ = all_.join(top, ["key", "of"], "left").withColumn("of", F.coalesce("top", "of")).drop("top")
    all_ = all_.join(all_.groupBy("key").agg(F.min(F.struct("uid", "place")).alias("at")), "key")
    since = lambda place: F.col(place) - F.col("at.place")
    all_ = all_.select("key", "at", "uid", "place", "low", "high", since("place").alias("since"), F.xxhash64("of.uid", since("of.place")).alias("class"))
    # a group's members, wherever in a stretch of 64 places its key lies
    row = F.xxhash64("uid", "since", "class").cast("decimal(38,0)")
    all_ = staged(all_, "placed")
    group = all_.groupBy("key").agg(F.first("at").alias("at"), F.sum(row).alias("rows"), F.count(F.lit(1)).alias("n"), F.min("class").alias("one"), F.max("class").alias("other")).where("one <> other")
    group = group.select("key", F.xxhash64(F.col("at.uid"), F.shiftright(F.col("at.place"), 6), F.col("rows").cast("string"), F.col("n")).alias("group"))
    all_ = all_.join(group, "key").groupBy("group", "uid", "since").agg(F.min("place").alias("place"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("class").alias("class"))
    all_ = staged(all_.withColumn("bytes", 4 * (F.col("high") - F.col("low") + t)), "to-compare")
    dealt = staged(chunk_pairs(all_, CROSS_ROWS, CROSS_BYTES), "dealt")
    wanted = staged(dealt.select("uid", "low", "high").distinct().groupBy("uid").agg(F.collect_list(F.struct("low", "high")).alias("wanted")), "regions-wanted")
    texts = perhaps_in(every, "uid", wanted).join(wanted, "uid").select("uid", "wanted", "raw")
    shown = staged(texts.mapInArrow(tidy(_regions(t)), "uid long, low long, high long, shingles binary").dropDuplicates(["uid", "low", "high"]), "regions")
    dealt = dealt.join(shown, ["uid", "low", "high"]).select("key", "side", "uid", "class", "place", "low", "high", "shingles")
    found = dealt.repartition("key").sortWithinPartitions("key", "side").mapInArrow(tidy(_crossing(t, similarity)), "uid long, rep long, shift long, lo long, hi long")
    return staged(found, "crossing")


def passages(docs: DataFrame, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, start_word, end_word, class_doc_id, class_start: a row for each passage that another document has too.

    Words count from 0, end_word is exclusive. class_doc_id is the smallest doc_id whose text the passage was verified
    against (its own for the first of a class), class_start the place there. A document of least_words or more whose
    whole text occurs again has a row for the whole of it, of the class of the smallest doc_id with that text. Null and
    short texts have no passage; repeated rows count as documents of their own and each get their rows; rows of a null
    doc_id take part and are returned. Repeats within one text alone do not count;
    each place of a text that repeats a passage which another has too does. Other columns are not read. Texts are
    told apart by a 64-bit hash.
    """
    ship(docs.sparkSession)
    t = least_words - WIDTH + 1
    if not WIDTH < least_words <= 4000:
        raise ValueError(f"least_words must be over {WIDTH} and at most 4000")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    ids = d.select("doc_id", F.xxhash64("text").alias("uid"), F.col("text").cast("binary").alias("raw"))
    ids = staged(ids.mapInArrow(tidy(_counted), "doc_id long, uid long, n_words int"), "texts")
    texts = staged(ids.groupBy("uid").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("n_words").alias("n_words")), "distinct")
    every = d.select(F.xxhash64("text").alias("uid"), F.col("text").cast("binary").alias("raw"))

    buckets = buckets_of(ids.agg(F.sum(F.col("n_words").cast("long"))).first()[0] or 0)
    rows = every.mapInArrow(tidy(_emit(t, buckets)), _ROWS).repartition("bucket").sortWithinPartitions("bucket")
    aligned = rows.mapInArrow(tidy(_align), "key long, uid long, rep long, pos long, rep_pos long")

    same = "uid = rep and pos = rep_pos"
    edges = staged(aligned.where(f"not ({same})"), "aligned")
    met = _places(edges).where("uid <> rep or shift <> 0")
    sure = _verified(met.select("uid", "rep", "shift", "lo", "hi"), every, t, similarity)
    sure = sure.union(_verified(_unsettled(met, sure, every, t, similarity), every, t, similarity))

    none = F.lit((1 << 63) - 1)
    first = texts.select(F.col("uid").alias("rep"), F.coalesce("first", none).alias("class_doc_id"))
    within, sure = sure.where("uid = rep"), sure.where("uid <> rep")
    own = sure.select(F.col("rep").alias("uid"), F.col("rep_at").alias("at"), F.col("rep_to").alias("to"), "rep", "rep_at").distinct()
    merged = sure.select(own.columns).union(own).join(first, "rep").select("uid", "at", "to", "class_doc_id", "rep_at")

    def joined(rows: DataFrame) -> DataFrame:
        rows = rows.repartition("uid").sortWithinPartitions("uid", "at", "to", "class_doc_id", "rep_at")
        return rows.mapInArrow(tidy(_passages()), "uid long, start_word int, end_word int, class_doc_id long, rep_at int")

    # a text's places that repeat what it shares with another text, as far as it shares it
    merged = staged(joined(merged), "shared")
    within = within.select("uid", "at", "to", "rep_at", "rep_to").union(within.select("uid", "rep_at", "rep_to", "at", "to")).withColumnRenamed("rep_at", "here")
    shared = merged.withColumnRenamed("rep_at", "there")
    lo, hi = F.greatest("here", "start_word"), F.least("rep_to", "end_word")
    more = within.join(shared, "uid").where(hi - lo >= least_words)
    more = more.select("uid", (F.col("at") + lo - F.col("here")).alias("at"), (F.col("at") + hi - F.col("here")).alias("to"), "class_doc_id", (F.col("there") + lo - F.col("start_word")).alias("rep_at"))
    merged = joined(merged.select("uid", F.col("start_word").alias("at"), F.col("end_word").alias("to"), "class_doc_id", "rep_at").union(more))
    merged = staged(merged.withColumn("class_doc_id", F.nullif("class_doc_id", none)), "passages")
    found = ids.join(merged, "uid").select("doc_id", "start_word", F.least("end_word", "n_words").alias("end_word"), "class_doc_id", F.col("rep_at").alias("class_start"))
    copies = texts.where((F.col("n") > 1) & (F.col("n_words") >= least_words)).select("uid", F.col("first").alias("class_doc_id"))
    whole = ids.join(copies, "uid").select("doc_id", F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"), "class_doc_id", F.lit(0).alias("class_start"))
    return found.union(whole)

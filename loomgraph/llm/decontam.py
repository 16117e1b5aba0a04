"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Texts are sequences of lower-cased words (runs of letters and digits). An item of n words is found where a stretch of
the document is within k = floor(n / 5) word insertions, deletions and substitutions of it (similarity 0.8 or more).

Item-sized windows are embedded by CGK random walks: a walk reads the window from its start, writes the word it stands
at and goes on to the next word or not, by a random bit of (word, step). Windows at a small edit distance give outputs at
a small Hamming distance. Each of `REPEATS` walks is sampled at `SAMPLED` steps: the samples of a walk are a key of the
hash table that the items of a length are in, once for each walk. A window's keys are looked up there; the items it meets
are its candidates, and exact edit distance decides. The walks and samples are enough for a recall of 0.99 of
passages at the full distance, and more nearer by (tests measure it over all windows).

Not all windows need be walked over: of k + 1 pieces of an item, k edits leave one whole, so only windows that hold a piece
of some item of their length in its place are looked up, which loses nothing. Items are a stated query set: they meet all documents in blocks of
at most `BLOCK_BYTES`, each sent to the executors.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import ship, tidy

LEAST_WORDS, REPEATS, SAMPLED, BLOCK_BYTES = 5, 64, 2, 4 << 20
SCHEMA = "doc_id long, item_id long, start_word int, end_word int, distance int, item_words int"
_word = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


def allowed(n: int) -> int:
    return n // 5


def pieces(n: int) -> list[tuple[int, int]]:
    """(offset, length) of the allowed(n) + 1 pieces of an item of n words."""
    parts = allowed(n) + 1
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def sample_steps(n: int, repeats: int = REPEATS, sampled: int = SAMPLED) -> np.ndarray:
    """(repeats, sampled) steps at which walks over n words are read: within the 2n steps that a walk needs on average."""
    return np.random.default_rng((n, repeats, sampled)).integers(0, 2 * n, (repeats, sampled))


def walks(windows: np.ndarray, repeats: int = REPEATS, sampled: int = SAMPLED) -> np.ndarray:
    """(rows, repeats, sampled): the words that CGK walks over each row of windows (ids of equal numbers of words) write."""
    rows, n = windows.shape
    steps = sample_steps(n, repeats, sampled)
    padded = np.concatenate((windows, np.full((rows, 1), -1, windows.dtype)), axis=1)
    place = np.zeros((rows, repeats), np.int64)
    walk = _mix(np.arange(repeats, dtype=np.uint64) + np.uint64(1))
    out = np.empty((rows, repeats, sampled), windows.dtype)
    line = np.arange(rows)[:, None]
    for step in range(int(steps.max()) + 1):
        at = padded[line, place]
        for c in range(sampled):
            here = steps[:, c] == step
            if here.any():
                out[:, here, c] = at[:, here]
        with np.errstate(over="ignore"):
            bit = _mix(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + walk + np.uint64(step) * np.uint64(0xD6E8FEB86659FD93)) & np.uint64(1)
        place = np.minimum(place + bit.astype(np.int64), n)
    return out


def walk_keys(windows: np.ndarray, repeats: int = REPEATS, sampled: int = SAMPLED) -> np.ndarray:
    """(rows, repeats): the key of each walk over each row of windows, of its samples and the walk's number."""
    seen = walks(windows, repeats, sampled)
    key = np.broadcast_to(np.arange(1, repeats + 1, dtype=np.uint64), seen.shape[:2])
    for c in range(sampled):
        with np.errstate(over="ignore"):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + seen[:, :, c].astype(np.uint64))
    return key


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of text nearest to item: least distance, then least end, then largest start."""
    m = len(text)
    cost, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    big = m + len(item) + 2
    every = np.arange(m + 1)
    for k, w in enumerate(item, 1):
        # cost and start as one number, so that ties go to the larger start
        both = cost * big - start
        other = np.empty(m + 1, np.int64)
        other[0] = k * big
        other[1:] = np.minimum(both[:-1] + (text != w) * big, both[1:] + big)
        other = np.minimum.accumulate(other - every * big) + every * big  # insertions along the text
        cost = -(-other // big)
        start = cost * big - other
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class Items:
    """Benchmark items of one block, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str | None]], least: int = LEAST_WORDS) -> None:
        self.items: list[tuple[int, np.ndarray]] = []
        self.ids: dict[str, int] = {}
        grams: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            w = words_of(text)
            if item_id is None or len(w) < least:
                continue
            ids = np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in w], np.int64)
            for offset, length in pieces(len(w)):
                grams[length][int(self._gram(ids[offset : offset + length], length)[0])].add((len(w), offset))
            self.items.append((item_id, ids))
        self.grams = {n: (np.array(sorted(g), np.uint64), {x: sorted(y) for x, y in g.items()}) for n, g in grams.items()}
        self.tables = {n: self._table(n) for n in sorted({len(ids) for _, ids in self.items})}

    @staticmethod
    def _gram(ids: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = np.zeros(len(ids) - n + 1, np.uint64)
            for k in range(n):
                x = x * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k].astype(np.uint64)
            return _mix(x)

    def _table(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash table of the items of n words: keys of all walks in order, and the item of each."""
        which = np.array([k for k, (_, ids) in enumerate(self.items) if len(ids) == n])
        keys = walk_keys(np.array([self.items[k][1] for k in which]))
        order = np.argsort(keys.reshape(-1), kind="stable")
        return keys.reshape(-1)[order], np.repeat(which, keys.shape[1])[order]

    def places(self, ids: np.ndarray) -> dict[int, list[int]]:
        """For each length of items, the window starts at which a piece of such an item stands in its place."""
        found: dict[int, set[int]] = defaultdict(set)
        for length, (sorted_grams, where) in self.grams.items():
            if len(ids) < length:
                continue
            known = np.cumsum(np.concatenate(([0], ids > 0)))
            at = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(at):
                continue
            g = self._gram(ids, length)[at]
            k = np.minimum(np.searchsorted(sorted_grams, g), len(sorted_grams) - 1)
            hit = sorted_grams[k] == g
            for p, x in zip(at[hit].tolist(), g[hit].tolist(), strict=True):
                for n, offset in where[x]:
                    found[n].add(p - offset)
        return {n: sorted(x) for n, x in found.items()}

    def candidates(self, n: int, ids: np.ndarray, starts: list[int]) -> dict[int, list[int]]:
        """For each item of n words, the starts whose windows meet it under a key."""
        keys, which = self.tables[n]
        out: dict[int, list[int]] = defaultdict(list)
        for at in range(0, len(starts), 256):
            part = np.array(starts[at : at + 256])
            place = part[:, None] + np.arange(n)[None, :]
            inside = (place >= 0) & (place < len(ids))
            mine = walk_keys(np.where(inside, ids[np.clip(place, 0, len(ids) - 1)], -1)).reshape(-1)
            lo, hi = np.searchsorted(keys, mine), np.searchsorted(keys, mine, side="right")
            met = np.flatnonzero(hi > lo)
            repeats = len(mine) // len(part)
            for s, item in sorted({(int(part[m // repeats]), int(x)) for m in met.tolist() for x in which[lo[m] : hi[m]]}):
                out[item].append(s)
        return out

    def search(self, text: str | None, everywhere: bool = False) -> list[tuple[int, int, int, int, int]]:
        """(item_id, start, end, distance, words of the item), words of the text: one for each stretch that is an item's copy.

        everywhere: all windows of the text are looked up, not just those that hold a piece.
        """
        get = self.ids.get
        words = words_of(text)
        if not words or not self.items:
            return []
        ids = np.array([get(w, 0) for w in words], np.int64)
        unknown = np.cumsum(np.concatenate(([0], ids == 0)))
        found = []
        placed = {n: list(range(-allowed(n), len(ids))) for n in self.tables} if everywhere else self.places(ids)
        for n, starts in placed.items():
            k, at = allowed(n), np.array(starts)
            # a window needs n - k words of the item's; what is unknown is in no item
            odd = unknown[np.clip(at + n, 0, len(ids))] - unknown[np.clip(at, 0, len(ids))]
            for item, near in self.candidates(n, ids, at[(odd <= 2 * k) & (at + n > 0)].tolist()).items():
                item_id, target = self.items[item]
                region: list[list[int]] = []
                for s in near:
                    if region and s <= region[-1][1] + 2 * k:
                        region[-1][1] = s
                    else:
                        region.append([s, s])
                for a, b in region:
                    lo, hi = max(0, a - k), min(len(ids), b + n + k)
                    while hi - lo >= n - k:
                        d, x, y = best_match(target, ids[lo:hi])
                        if d > k:
                            break
                        found.append((item_id, lo + x, lo + y, d, n))
                        lo += max(y, 1)  # another copy may follow in the same region
        return sorted(set(found))


def _search(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *f) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in items.search(t)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "start_word", "end_word", "distance", "item_words"])

    return run


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, each collected when it is its turn."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = b.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        if rows := sorted((r["item_id"], r["text"]) for r in part.collect()):
            yield rows


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, end_word (exclusive), distance, item_words: a row for each copy of an item in a document.

    Items under LEAST_WORDS words, and null ids or texts, are not searched for; items that repeat an id count each. Null and
    empty documents have no copy; repeated documents repeat their rows. Other columns are not read. Empty tables give no row.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for part in blocks(benchmark):
        found = rows.mapInArrow(tidy(_search(Items(part))), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return rows.mapInArrow(tidy(_search(Items([]))), SCHEMA).limit(0) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that hold a copy of an item. Verdicts are made from a row's own text."""
    ship(docs.sparkSession)
    at, schema = docs.columns.index("text"), docs.schema
    for part in blocks(benchmark):
        items = Items(part)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not items.search(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), schema)
    return docs



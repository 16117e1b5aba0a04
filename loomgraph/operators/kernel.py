"""The window join of two series in numpy: many pairs of short series of the same shape at a time, long pairs one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from loomgraph.operators import search
from loomgraph.operators.relations import Relation
from loomgraph.operators.search import Windows, rounded

#: Doubles in one working array, about: whatever the length of a series, some ten such arrays are all that a join holds.
ROOM = 2_000_000
#: Window pairs of two series from which they are searched by bounds instead of one matrix product.
LONG = 4_000_000


def z_windows(values: np.ndarray, m: int) -> np.ndarray:
    """(pairs, windows, m): z-normalised windows of each row of values; windows of equal values are zeros.

    Sums run from left to right, as in SQL.
    """
    w = np.lib.stride_tricks.sliding_window_view(values, m, axis=1)
    total = np.zeros(w.shape[:2])
    for k in range(m):
        total += w[:, :, k]
    with np.errstate(invalid="ignore"):
        centred = w - (total / m)[:, :, None]
    square = np.zeros(w.shape[:2])
    for k in range(m):
        square += centred[:, :, k] ** 2
    sd = np.sqrt(square / m)
    with np.errstate(invalid="ignore", divide="ignore"):
        z = centred / sd[:, :, None]
    z[sd == 0] = 0
    return z


def lengths(z: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("...k,...k->...", z, z))


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = lengths(a) * lengths(b)
    dot = np.einsum("...k,...k->...", a, b)
    return np.where(size > 0, dot / np.where(size > 0, size, 1), 0.0)


class Best:
    """For each pair the least distance, then the largest source window, then the smallest target window."""

    def __init__(self, pairs: int) -> None:
        self.dist, self.i, self.j = np.full(pairs, np.inf), np.full(pairs, -1), np.full(pairs, -1)

    def offer(self, p: np.ndarray, dist: np.ndarray, i: np.ndarray, j: np.ndarray, last: bool = True) -> None:
        """Candidates of pairs p; last=False prefers the smallest source window."""
        if not len(p):
            return
        order = np.lexsort((j, -i if last else i, dist, p))
        p, dist, i, j = p[order], dist[order], i[order], j[order]
        first = np.concatenate(([True], p[1:] != p[:-1]))
        p, dist, i, j = p[first], dist[first], i[first], j[first]
        near = (i > self.i[p]) if last else (i < self.i[p])
        better = (dist < self.dist[p]) | (dist == self.dist[p]) & (near | (i == self.i[p]) & (j < self.j[p]))
        better &= np.isfinite(dist)
        self.dist[p[better]], self.i[p[better]], self.j[p[better]] = dist[better], i[better], j[better]


def _shifted(za: np.ndarray, zb: np.ndarray, shift: int, threshold: float, best: Best, base: int) -> None:
    """Offers all (i, i + shift)."""
    lo, hi = max(0, -shift), min(za.shape[1], zb.shape[1] - shift)
    if lo >= hi:
        return
    a, b = za[:, lo:hi], zb[:, lo + shift : hi + shift]
    ok = _cosine(a, b) >= threshold
    p, k = np.nonzero(ok)
    dist = rounded(np.sqrt(((a[p, k] - b[p, k]) ** 2).sum(axis=1)))
    best.offer(p + base, dist, k + lo, k + lo + shift)


def _matrix(za: np.ndarray, zb: np.ndarray, allowed: np.ndarray, threshold: float | None, best: Best, base: int, by_source: bool = False) -> None:
    """Offers the allowed (i, j) (a mask for all pairs or one for each): by a product first, and exactly where that is least."""
    na, nb = lengths(za), lengths(zb)
    product = za @ zb.transpose(0, 2, 1)
    size = na[:, :, None] * nb[:, None, :]
    ok = np.broadcast_to(allowed, product.shape) & np.isfinite(product)
    if threshold is not None:
        with np.errstate(invalid="ignore", divide="ignore"):
            near = np.where(size > 0, product / size, 0.0)
        ok = ok & (near >= threshold - 1e-9)
    square = (na**2)[:, :, None] + (nb**2)[:, None, :] - 2 * product
    about = np.where(ok, np.sqrt(np.maximum(square, 0)), np.inf)
    least = about.min(axis=2, keepdims=True) if by_source else about.min(axis=(1, 2), keepdims=True)
    # the product is right to about 1e-7 even where distances vanish; rounding is to 1e-5
    p, i, j = np.nonzero((about <= least + 3e-5) & np.isfinite(about))
    for lo in range(0, len(p), 1 << 16):
        q = slice(lo, lo + (1 << 16))
        a, b = za[p[q], i[q]], zb[p[q], j[q]]
        dist = rounded(np.sqrt(((a - b) ** 2).sum(axis=1)))
        sure = np.ones(len(dist), bool) if threshold is None else _cosine(a, b) >= threshold
        best.offer(p[q][sure] + base, dist[sure], i[q][sure], j[q][sure])
    if threshold is not None and len(p):  # a least one that fails the exact threshold hides the next: look again without it
        lost = np.unique(p)[~np.isfinite(best.dist[np.unique(p) + base])]
        for k in lost.tolist():
            i, j = np.nonzero(ok[k])
            sure = _cosine(za[k, i], zb[k, j]) >= threshold
            dist = rounded(np.sqrt(((za[k, i] - zb[k, j]) ** 2).sum(axis=1)))
            best.offer(np.full(int(sure.sum()), k + base), dist[sure], i[sure], j[sure])


def _tiles(n_a: int, n_b: int) -> Iterator[tuple[int, int]]:
    """Source windows in runs whose pairs with all target windows fit into a working array."""
    step = max(1, ROOM // max(n_b, 1))
    for lo in range(0, n_a, step):
        yield lo, min(lo + step, n_a)


def _long(a: np.ndarray, b: np.ndarray, m: int, relation: Relation, offset: int, threshold: float) -> tuple[int, int, float] | None:
    """grid_join of one pair of long series, in memory that grows with neither window length nor pairs of windows."""
    if relation in (Relation.BEFORE, Relation.NONE):
        return search.pruned(Windows(a, m), Windows(b, m), m + offset if relation is Relation.BEFORE else None, threshold)[0]
    n_a, n_b = len(a) - m + 1, len(b) - m + 1
    near, far = {Relation.EQUAL: (0, 0), Relation.MEETS: (m, m), Relation.OVERLAPS: (1, m - 2)}[relation]
    step, best = max(1, ROOM // (2 * m)), Best(1)
    for lo in range(0, n_a, step):
        hi = min(lo + step, n_a)
        x, y = max(0, lo + offset + near), min(n_b, hi + offset + far)
        if x < y:
            part = grid_join(a[None, lo : hi + m - 1], b[None, x : y + m - 1], m, relation, offset + lo - x, threshold)
            best.offer(np.zeros(1, int), part.dist, part.i + lo, part.j + x)
    return (int(best.i[0]), int(best.j[0]), float(best.dist[0])) if np.isfinite(best.dist[0]) else None


def grid_join(a: np.ndarray, b: np.ndarray, m: int, relation: Relation, offset: int, threshold: float, ia: np.ndarray | None = None, ib: np.ndarray | None = None) -> Best:
    """Pairs of series (rows ia of a with rows ib of b; without them, row by row) whose grids are `offset` steps apart."""
    ia, ib = (np.arange(len(x)) if k is None else k for x, k in ((a, ia), (b, ib)))
    best, n_a, n_b = Best(len(ia)), a.shape[1] - m + 1, b.shape[1] - m + 1
    wide = relation in (Relation.BEFORE, Relation.NONE)
    if n_a * n_b > LONG if wide else max(n_a, n_b) > max(4 * m, ROOM // m):  # parts of a long pair are no longer than that
        for p in range(len(ia)):
            if (row := _long(a[ia[p]], b[ib[p]], m, relation, offset, threshold)) is not None:
                best.i[p], best.j[p], best.dist[p] = row
        return best
    step = max(1, ROOM // (max(n_a, n_b) * m + (n_a * n_b if wide else 0)))
    for lo in range(0, len(ia), step):
        # a series of several pairs is normalised once
        (ua, at_a), (ub, at_b) = (np.unique(k[lo : lo + step], return_inverse=True) for k in (ia, ib))
        za, zb = z_windows(a[ua], m), z_windows(b[ub], m)
        za, zb = (z if len(u) == len(at) and (at[1:] > at[:-1]).all() else z[at] for z, u, at in ((za, ua, at_a), (zb, ub, at_b)))
        if relation is Relation.EQUAL:
            _shifted(za, zb, offset, threshold, best, lo)
        elif relation is Relation.MEETS:
            _shifted(za, zb, offset + m, threshold, best, lo)
        elif relation is Relation.OVERLAPS:
            for k in range(1, m - 1):
                _shifted(za, zb, offset + k, threshold, best, lo)
        else:
            for x, y in _tiles(n_a, n_b):
                if relation is Relation.BEFORE:
                    allowed = np.arange(n_b)[None, :] >= np.arange(x, y)[:, None] + m + offset
                    if not allowed.any():
                        continue
                else:
                    allowed = np.ones((1, 1), bool)
                part = Best(len(za))
                _matrix(za[:, x:y], zb, allowed[None], threshold, part, 0)
                best.offer(np.arange(len(za)) + lo, part.dist, part.i + x, part.j)
    return best


#: What finding one pair's best windows costs, in pairs whose one cosine is taken by a matrix product.
DEAR = 1 << 13
#: Sources and targets of which all pairs are looked at together: two arrays of floats that stay in a core's cache.
SIDE = 512


def _places(n_a: int, n_b: int, m: int, relation: Relation, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): the windows of two series that stand in the relation, in an order without a pattern."""
    i = np.arange(n_a)
    if relation in (Relation.BEFORE, Relation.NONE):
        i, j = np.nonzero(np.ones((n_a, n_b), bool) if relation is Relation.NONE else np.arange(n_b)[None, :] >= i[:, None] + m + offset)
    else:
        near, far = {Relation.EQUAL: (0, 0), Relation.MEETS: (m, m), Relation.OVERLAPS: (1, m - 2)}[relation]
        shifts = np.arange(near, far + 1) + offset
        i, j = np.repeat(i, len(shifts)), (i[:, None] + shifts[None, :]).ravel()
        i, j = i[(j >= 0) & (j < n_b)], j[(j >= 0) & (j < n_b)]
    order = np.random.default_rng(0).permutation(len(i))
    return i[order], j[order]


def _units(values: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, series, m): windows of length 1 as floats, constant ones 0; and which series have windows without a length."""
    z = z_windows(values, m)
    size = lengths(z)[:, :, None]
    with np.errstate(invalid="ignore"):
        u = np.where(size > 0, z / np.where(size > 0, size, 1), 0.0).astype(np.float32)
    return np.ascontiguousarray(u.transpose(1, 0, 2)), ~np.isfinite(z).all(axis=(1, 2))


def grid_match(a: np.ndarray, b: np.ndarray, m: int, relation: Relation, offset: int, threshold: float) -> np.ndarray:
    """(series of a, series of b): whether grid_join() finds windows of the pair, for all pairs.

    Cosines of one place of all pairs are one matrix product of floats; what lies within its rounding errors of the threshold,
    and what is left when few pairs are, is looked up by grid_join().
    """
    found = np.zeros((len(a), len(b)), bool)
    n_a, n_b = a.shape[1] - m + 1, b.shape[1] - m + 1
    if n_a < 1 or n_b < 1:
        return found
    long = n_a * n_b > LONG or max(n_a, n_b) * m > ROOM
    side = max(1, min(SIDE, ROOM // (max(n_a, n_b) * m)))
    at, to = (np.empty(0, int),) * 2 if long else _places(n_a, n_b, m, relation, offset)
    slack = np.float32((m + 8) * 1.2e-7)
    for y in range(0, len(b), side):
        ub, odd_b = (None, None) if long else _units(b[y : y + side], m)
        for x in range(0, len(a), side):
            part = found[x : x + side, y : y + side]
            if long:
                unsure = np.ones(part.shape, bool)
            else:
                ua, odd_a = _units(a[x : x + side], m)
                best, now = np.full(part.shape, -np.inf, np.float32), np.empty(part.shape, np.float32)
                low = np.float32(threshold) - slack
                for k, (i, j) in enumerate(zip(at.tolist(), to.tolist(), strict=True)):
                    np.maximum(best, np.matmul(ua[i], ub[j].T, out=now), out=best)
                    if k % 8 == 7 and np.count_nonzero(best < threshold + slack) * DEAR <= best.size * (len(at) - k):
                        low = np.float32(-np.inf)
                        break
                odd = odd_a[:, None] | odd_b[None, :]
                part |= (best >= threshold + slack) & ~odd
                unsure = odd | ((best >= low) & ~part)
            p, q = np.nonzero(unsure)
            for lo in range(0, len(p), 4096):
                r, s = p[lo : lo + 4096], q[lo : lo + 4096]
                part[r, s] = grid_join(a, b, m, relation, offset, threshold, r + x, s + y).i >= 0
    return found


def related(name: str, sa: np.ndarray, ea: np.ndarray, sb: np.ndarray, eb: np.ndarray) -> np.ndarray:
    """Which source windows (start, end) and target windows are in a relation that the baselines read off timestamps.

    crosses is overlaps with those that start together."""
    if name == "equal":
        return (sa == sb) & (ea == eb)
    if name == "meets":
        return sb == ea + 1_000_000
    if name == "before":
        return ea < sb
    return (sa < eb) & (ea > sb) & ((sa != sb) | (name == "crosses"))


def related_between(name: str, sa: tuple[int, int], ea: tuple[int, int], sb: tuple[int, int], eb: tuple[int, int]) -> bool | None:
    """Whether all windows with times in these ranges are before or overlap each other (True), none does (False), or some may (None)."""
    if name == "before":
        return True if ea[1] < sb[0] else None if ea[0] < sb[1] else False
    if not (sa[0] < eb[1] and ea[1] > sb[0]):
        return False
    return True if sa[1] < eb[0] and ea[0] > sb[1] and (sa[1] < sb[0] or sb[1] < sa[0]) else None


def _direct(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray, relation: Relation) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of equal or meeting windows, by one lookup of each source's time among the target's start times.

    Of repeated start times the last target stands."""
    order = np.argsort(start_b, kind="stable")
    starts, wanted = start_b[order], start_a if relation is Relation.EQUAL else end_a + 1_000_000
    at = np.searchsorted(starts, wanted, side="right") - 1
    i = np.flatnonzero((at >= 0) & (starts[np.maximum(at, 0)] == wanted)) if len(starts) else np.empty(0, np.int64)
    j = order[at[i]]
    if relation is Relation.EQUAL:
        same = end_a[i] == end_b[j]
        i, j = i[same], j[same]
    return i, j


def profile_join(a: np.ndarray, ta: np.ndarray, b: np.ndarray, tb: np.ndarray, m: int, relation: Relation, method: str = "stamp", part: int = 0, parts: int = 1) -> tuple[int, int, float] | None:
    """The matrix-profile baseline for one pair of series: timestamps decide, without a threshold.

    equal and meets: of all sources the first with the least distance (of repeated start times the last target stands).
    overlaps and before: as the grid join, the last source wins a tie; stamp goes window by window, stomp along diagonals,
    of which it may take a share. none never matches.
    """
    if relation is Relation.NONE:
        return None
    times = ta[: len(a) - m + 1], ta[m - 1 :], tb[: len(b) - m + 1], tb[m - 1 :]
    wa, wb = Windows(a, m), Windows(b, m)
    if relation in (Relation.EQUAL, Relation.MEETS):
        i, j = _direct(*times, relation)
        best, step = Best(1), max(1, ROOM // m)
        best.i[:] = len(a)
        for lo in range(0, len(i), step):
            x, y = i[lo : lo + step], j[lo : lo + step]
            dist = rounded(np.sqrt(((wa.rows(x) - wb.rows(y)) ** 2).sum(axis=1)))
            best.offer(np.zeros(len(x), int), dist, x, y, last=False)
        return None if not np.isfinite(best.dist[0]) else (int(best.i[0]), int(best.j[0]), float(best.dist[0]))
    allowed = lambda *t: related(relation.value, *t)
    if method == "stomp":
        return search.by_diagonals(wa, wb, times, allowed, None, part, parts, lambda *t: related_between(relation.value, *t))
    return search.by_fft(wa, wb, times, allowed)


def classified(a: np.ndarray, ta: np.ndarray, b: np.ndarray, tb: np.ndarray, m: int) -> dict[str, tuple[int, float]]:
    """By relation, the window pairs (how many, least distance) of which it is the first that holds."""
    times = ta[: len(a) - m + 1], ta[m - 1 :], tb[: len(b) - m + 1], tb[m - 1 :]
    wa, wb = Windows(a, m), Windows(b, m)
    found: dict[str, tuple[int, float]] = {}
    for x, y in _tiles(wa.n, wb.n):
        left = np.ones((y - x, wb.n), bool)
        for name in ("equal", "meets", "overlaps", "before"):
            # what starts together but ends apart overlaps here
            mask = related("crosses" if name == "overlaps" else name, times[0][x:y, None], times[1][x:y, None], times[2][None], times[3][None]) & left
            left &= ~mask
            i, j = np.nonzero(mask)
            if len(i):
                n, least = found.get(name, (0, np.inf))
                step = max(1, ROOM // m)
                for q in range(0, len(i), step):
                    apart = wa.rows(i[q : q + step] + x) - wb.rows(j[q : q + step])
                    least = min(least, float(rounded(np.sqrt((apart**2).sum(axis=1))).min()))
                found[name] = (n + len(i), least)
    return found

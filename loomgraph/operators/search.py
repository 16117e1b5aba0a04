"""The nearest windows of one pair of long series, exactly, in memory that grows with their length.

Three ways to look: runs of windows bounded by piecewise means, best first (the window join); sliding products by FFT, source
window by source window (STAMP); sliding products along diagonals, of which a task may take a share (STOMP). Each gives lower bounds
of distances, its rounding errors taken off; what a bound leaves open is computed again from the windows themselves. So all
ways find the same row: least rounded distance, then the last source window, then the first target window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Doubles in one working array, about.
ROOM = 1_000_000
#: Half a step of rounded distances, and what an exact distance may differ from its bound by.
HALF, TINY = 5e-6, 1e-9
EPS = float(np.finfo(float).eps)

#: Least and largest of each of those four times -> whether all (True) or none (False) may be paired, or that depends (None).
Between = Callable[..., bool | None]
#: (start, end) of source windows, then of target windows -> which of them may be paired, by broadcasting.
Allowed = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e5 + 0.5) / 1e5


class Windows:
    """Means and deviations of the windows of m points of a series; the windows themselves only when asked for.

    Sums run from left to right. flat: windows of equal values, zeros when normalised. ok: windows without NaN or infinity.
    """

    def __init__(self, values: np.ndarray, m: int) -> None:
        self.x, self.m, self.n = values, m, len(values) - m + 1
        total, square = np.zeros(self.n), np.zeros(self.n)
        with np.errstate(invalid="ignore", over="ignore"):
            for k in range(m):
                total += values[k : k + self.n]
            self.mean = total / m
            for k in range(m):
                square += (values[k : k + self.n] - self.mean) ** 2
            self.sd = np.sqrt(square / m)
        self.ok = ~np.isnan(self.sd)
        self.flat = (self.sd == 0) | np.isinf(self.sd)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.inverse = np.where(self.flat | ~self.ok, 0.0, 1 / self.sd)
        #: Squared lengths of the normalised windows, less what rounding of a mean far from 0 may change in a squared distance.
        self.largest = float(np.abs(values[np.isfinite(values)]).max(initial=0))
        self.size = np.where(self.flat, 0.0, m - 4 * m * (m + 4) * EPS * self.largest * self.inverse)

    def rows(self, i: np.ndarray) -> np.ndarray:
        """Normalised windows i."""
        with np.errstate(invalid="ignore", divide="ignore"):
            z = (self.x[i[:, None] + np.arange(self.m)] - self.mean[i, None]) / self.sd[i, None]
        z[self.sd[i] == 0] = 0
        return z

    def piece_means(self, pieces: int) -> np.ndarray:
        """(windows, pieces): the mean of each piece of each normalised window, times the root of its points."""
        ends = np.linspace(0, self.m, pieces + 1).round().astype(int)
        out = np.zeros((self.n, pieces))
        with np.errstate(invalid="ignore", divide="ignore"):
            for p in range(pieces):
                for k in range(ends[p], ends[p + 1]):
                    out[:, p] += (self.x[k : k + self.n] - self.mean) / self.sd
                out[:, p] /= np.sqrt(ends[p + 1] - ends[p])
        out[self.sd == 0] = 0
        return out

    def filled(self) -> tuple[np.ndarray, float]:
        """The series less its mean, and the mean; points that are no numbers are 0."""
        seen = np.isfinite(self.x)
        middle = float(self.x[seen].mean()) if seen.any() else 0.0
        return np.where(seen, self.x - middle, 0.0), middle


class Nearest:
    """The best pair of windows so far. threshold: the least cosine, or None for any."""

    def __init__(self, a: Windows, b: Windows, threshold: float | None = None) -> None:
        self.a, self.b, self.threshold = a, b, threshold
        self.dist, self.i, self.j = np.inf, -1, -1
        self.farthest = np.inf if threshold is None else 2 * a.m * (1 - threshold + TINY)

    def usable(self, w: Windows) -> np.ndarray:
        """Windows that can be in a pair; a flat one has cosine 0 to all."""
        return w.ok & ~w.flat if self.threshold is not None and self.threshold > 0 else w.ok

    def limit(self) -> float:
        """Squared distances over it are out."""
        near = (self.dist + HALF + TINY) ** 2 if np.isfinite(self.dist) else np.inf
        flat = self.threshold is not None and self.threshold <= 0
        return min(near, max(self.farthest, self.a.m * (1 + TINY)) if flat else self.farthest)

    def open(self, low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of at least these distances could still be better."""
        later = (i > self.i) | ((i == self.i) & (j < self.j))
        return (low <= self.dist - HALF + TINY) | (later & (low <= self.dist + HALF + TINY))

    def offer(self, i: np.ndarray, j: np.ndarray, low: np.ndarray) -> None:
        """Candidates and lower bounds of their squared distances: computed exactly as far as needed, nearest and last first."""
        low, many = np.sqrt(np.maximum(low, 0)), 64
        while True:
            keep = self.open(low, i, j)
            i, j, low = i[keep], j[keep], low[keep]
            if not len(i):
                return
            take = np.argpartition(low, many)[:many] if len(low) > many else np.arange(len(low))
            last = np.flatnonzero(i == i.max())
            take = np.union1d(take, last[j[last].argmin()])
            self._exact(i[take], j[take])
            left = np.ones(len(i), bool)
            left[take] = False
            i, j, low, many = i[left], j[left], low[left], min(many * 2, max(64, ROOM // self.a.m))

    def _exact(self, i: np.ndarray, j: np.ndarray) -> None:
        za, zb = self.a.rows(i), self.b.rows(j)
        dist = rounded(np.sqrt(((za - zb) ** 2).sum(axis=1)))
        good = np.isfinite(dist)
        if self.threshold is not None:
            size = np.sqrt(np.einsum("ij,ij->i", za, za)) * np.sqrt(np.einsum("ij,ij->i", zb, zb))
            dot = np.einsum("ij,ij->i", za, zb)
            good &= np.where(size > 0, dot / np.where(size > 0, size, 1), 0.0) >= self.threshold
        if good.any():
            i, j, dist = i[good], j[good], dist[good]
            k = np.lexsort((j, -i, dist))[0]
            if (dist[k], -i[k], j[k]) < (self.dist, -self.i, self.j):
                self.dist, self.i, self.j = float(dist[k]), int(i[k]), int(j[k])

    def offer_tile(self, low: np.ndarray, i: Callable[[np.ndarray], np.ndarray], j: Callable[[np.ndarray], np.ndarray]) -> None:
        """A working array of lower bounds (infinite: no pair); i and j give the windows of flat places."""
        flat = low.ravel()
        k = int(flat.argmin())
        if not (np.isfinite(flat[k]) and flat[k] <= self.limit()):
            return
        first = np.array([k])
        self.offer(i(first), j(first), flat[first])
        rest = np.flatnonzero(flat <= min(self.limit(), np.finfo(float).max))
        self.offer(i(rest), j(rest), flat[rest])

    def row(self) -> tuple[int, int, float] | None:
        return (self.i, self.j, self.dist) if np.isfinite(self.dist) else None


#: Where boxes leave more than this part of the pairs open, FFTs are quicker.
OPEN_SHARE = 1 / 16


def pruned(a: Windows, b: Windows, first: int | None, threshold: float, pieces: int = 5) -> tuple[tuple[int, int, float] | None, float]:
    """(the nearest pair, the share of allowed pairs that was looked at). first: pairs have j >= i + first; None: all pairs.

    Runs of neighbouring windows have a box around their piece means; the gap of two boxes is under every distance between
    the runs. The runs of least gap are compared first; then whatever gap is not over the best distance so far, nearest
    first. Boxes are compared in strips, so memory grows with the length alone.
    """
    best, m = Nearest(a, b, threshold), a.m
    pieces, run = min(pieces, m), max(2, m // 6, (a.n + b.n) // 40_000)
    use_a, use_b = best.usable(a), best.usable(b)

    def boxes(w: Windows, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        means, short = w.piece_means(pieces), -w.n % run
        ends = [np.concatenate([np.where(use[:, None], means, x), np.full((short, pieces), x)]).reshape(-1, run, pieces) for x in (np.inf, -np.inf)]
        return (ends[0].min(axis=1) - TINY).astype(np.float32), (ends[1].max(axis=1) + TINY).astype(np.float32)

    (la, ha), (lb, hb) = boxes(a, use_a), boxes(b, use_b)
    at_a, at_b, inside = np.arange(len(la)) * run, np.arange(len(lb)) * run, np.arange(run)
    last_b = np.minimum(at_b + run, b.n) - 1

    def gaps(runs: np.ndarray) -> np.ndarray:
        out = np.zeros((len(runs), len(lb)), np.float32)
        for p in range(pieces):
            gap = np.maximum(la[runs, p, None] - hb[None, :, p], lb[None, :, p] - ha[runs, p, None])
            out += np.maximum(gap, 0, out=gap) ** 2
        out *= 1 - 1e-5  # single precision
        if first is not None:
            out[last_b[None, :] < at_a[runs, None] + first] = np.inf
        return out

    def compare(ra: np.ndarray, rb: np.ndarray) -> None:
        i, j = at_a[ra][:, None] + inside, at_b[rb][:, None] + inside
        ok = (i < a.n)[:, :, None] & (j < b.n)[:, None, :]
        i, j = np.minimum(i, a.n - 1), np.minimum(j, b.n - 1)
        ok &= use_a[i][:, :, None] & use_b[j][:, None, :]
        if first is not None:
            ok &= j[:, None, :] >= i[:, :, None] + first
        za, zb = a.rows(i.ravel()).reshape(*i.shape, m), b.rows(j.ravel()).reshape(*j.shape, m)
        low = a.size[i][:, :, None] + b.size[j][:, None, :] - 2 * (za @ zb.transpose(0, 2, 1)) - 64 * EPS * m
        low[~ok] = np.inf
        best.offer_tile(low, lambda k: i[k // run**2, k // run % run], lambda k: j[k // run**2, k % run])

    strip, most = max(1, ROOM // len(lb)), max(1, ROOM // (2 * run * m))
    some = np.unique(np.linspace(0, len(la) - 1, min(len(la), 64)).astype(int))
    for lo in range(0, len(some), strip):  # a good distance to begin with
        runs = some[lo : lo + strip]
        gap = gaps(runs)
        near = gap.argmin(axis=1)
        fine = np.isfinite(gap[np.arange(len(runs)), near])
        if fine.any():
            compare(runs[fine], near[fine])
    allowed = still = 0
    for lo in range(0, len(some), strip):
        gap = gaps(some[lo : lo + strip])
        allowed += int(np.isfinite(gap).sum())
        still += int((gap <= best.limit()).sum()) if np.isfinite(best.limit()) else gap.size
    if still > OPEN_SHARE * allowed:
        index = np.arange(max(a.n, b.n))
        times = index[: a.n], index[: a.n], index[: b.n], index[: b.n]
        return by_fft(a, b, times, None if first is None else lambda sa, ea, sb, eb: sb >= sa + first, threshold), 1.0
    allowed = seen = 0
    for hi in range(len(la), 0, -strip):
        runs = np.arange(max(0, hi - strip), hi)
        gap = gaps(runs)
        allowed += int(np.isfinite(gap).sum())
        batch = 64
        places = np.flatnonzero(gap <= best.limit()) if np.isfinite(best.limit()) else np.flatnonzero(np.isfinite(gap))
        bound = gap.ravel()[places].astype(float)
        order = np.argsort(bound, kind="stable")
        places, bound = places[order], bound[order]
        while len(places):
            ra, rb = np.divmod(places, len(lb))
            low = np.sqrt(bound)
            keep = bound <= best.limit()
            if np.isfinite(best.dist):  # runs of earlier windows must be strictly nearer
                keep &= (low <= best.dist - HALF + TINY) | (at_a[runs[ra]] + run > best.i)
            ra, rb, places, bound = ra[keep], rb[keep], places[keep], bound[keep]
            if len(ra):
                compare(runs[ra[:batch]], rb[:batch])
                seen += len(ra[:batch])
            places, bound = places[batch:], bound[batch:]
            batch = min(batch * 2, most)
    return best.row(), seen / max(allowed, 1)


def _fits(allowed: Allowed | None, times: tuple[np.ndarray, ...], i: slice, j: slice) -> np.ndarray | None:
    if allowed is None:
        return None
    return allowed(times[0][i, None], times[1][i, None], times[2][None, j], times[3][None, j])


def by_fft(a: Windows, b: Windows, times: tuple[np.ndarray, ...], allowed: Allowed | None = None, threshold: float | None = None) -> tuple[int, int, float] | None:
    """The nearest allowed pair: products of each source window with all target windows, by FFTs of short blocks."""
    best, m = Nearest(a, b, threshold), a.m
    use_a, use_b = best.usable(a), best.usable(b)
    size = 1 << max(8, int(np.ceil(np.log2(4 * m))))
    step = size - m + 1
    blocks = -(-b.n // step)
    x = np.where(np.isfinite(b.x), b.x, np.nan)
    cut = np.full((blocks, size), np.nan)
    for k in range(blocks):
        part = x[k * step : k * step + size]
        cut[k, : len(part)] = part
    seen = np.isfinite(cut)
    middle = np.where(seen, cut, 0).sum(axis=1) / np.maximum(seen.sum(axis=1), 1)
    cut = np.where(seen, cut - middle[:, None], 0.0)  # a normalised window's products do not see a constant
    spectra = np.fft.rfft(cut, axis=1)
    by = np.zeros(blocks * step)
    by[: b.n] = b.inverse
    error = 32 * EPS * np.sqrt(m) * np.repeat(np.sqrt((cut**2).sum(axis=1)) + np.abs(middle), step) * by
    nb = np.full(blocks * step, np.inf)
    nb[: b.n] = np.where(use_b, b.size, np.inf)
    nb -= 2 * error + 64 * EPS * m
    rows = max(1, ROOM // (blocks * size))
    for hi in range(a.n, 0, -rows):
        lo = max(0, hi - rows)
        mask = _fits(allowed, times, slice(lo, hi), slice(0, b.n))
        from_block, to_block = 0, blocks
        if mask is not None:
            columns = np.flatnonzero(mask.any(axis=0))
            if not len(columns):
                continue
            from_block, to_block = int(columns[0]) // step, int(columns[-1]) // step + 1
        z = np.where(use_a[lo:hi, None], a.rows(np.arange(lo, hi)), 0.0)
        z -= z.mean(axis=1, keepdims=True)  # what rounding left of a mean would meet the target's slope
        own = np.fft.rfft(z[:, ::-1], size, axis=1)
        products = np.fft.irfft(own[:, None, :] * spectra[None, from_block:to_block], size, axis=2)[:, :, m - 1 :].reshape(hi - lo, -1)
        j0, j1 = from_block * step, to_block * step
        low = products
        low *= -2 * by[None, j0:j1]
        low += nb[None, j0:j1]
        low += np.where(use_a[lo:hi], a.size[lo:hi], np.inf)[:, None]
        if mask is not None:
            low[:, : b.n - j0][~mask[:, j0:j1]] = np.inf
        width = j1 - j0
        best.offer_tile(low, lambda k: lo + k // width, lambda k: j0 + k % width)  # noqa: B023
    return best.row()


def diagonals(n_a: int, n_b: int) -> Iterator[tuple[int, int]]:
    """(first, after the last) of the diagonals j - i of all windows, a working block at a time."""
    many = max(1, min(64, SEGMENT * 4 // max(1, min(n_a, SEGMENT))))
    for k in range(1 - n_a, n_b, many):
        yield k, min(k + many, n_b)


#: Windows of a diagonal whose products are summed from a new start.
SEGMENT = 8192


def _shifts(v: np.ndarray, at: int, count: int, width: int) -> np.ndarray:
    """(count, width) without a copy: width values of v from at on, from at + 1 on, ..."""
    return np.ndarray((count, width), v.dtype, v, at * v.itemsize, (v.itemsize, v.itemsize))


def by_diagonals(a: Windows, b: Windows, times: tuple[np.ndarray, ...], allowed: Allowed | None = None, threshold: float | None = None, part: int = 0, parts: int = 1, between: Between | None = None) -> tuple[int, int, float] | None:
    """The nearest allowed pair, or that of every parts-th block of diagonals from `part` on: a product is its neighbour's on the
    diagonal, less the pair of points that leaves and with the one that enters, as differences of running sums. between tells of
    ranges of times what allowed tells of times."""
    best, m = Nearest(a, b, threshold), a.m
    (x, cx), (y, cy) = a.filled(), b.filled()
    pad = a.n + 64
    zeros = np.zeros(pad)
    y = np.concatenate([zeros, y, zeros])
    wide = lambda v, fill: np.concatenate([np.full(pad, fill, v.dtype), v, np.full(pad, fill, v.dtype)])
    use_a, use_b = best.usable(a), wide(best.usable(b), False)
    ma, mb = np.where(use_a, a.mean - cx, 0.0) * m, wide(np.where(b.ok, b.mean - cy, 0.0), 0.0)
    ia, ib = -2 * a.inverse, wide(b.inverse, 0.0)
    na, nb = np.where(use_a, a.size, np.inf) - 64 * EPS * m, np.where(use_b, wide(b.size, 0.0), np.inf)
    sb, eb = wide(times[2], 0), wide(times[3], 0)
    top_a, top_b = float(np.abs(ma).max(initial=0)), float(np.abs(mb).max(initial=0))
    most = top_a * top_b + top_a * b.largest + top_b * a.largest  # means are rounded in proportion to the series itself
    for number, (k0, k1) in enumerate(diagonals(a.n, b.n)):
        if number % parts != part:
            continue
        count = k1 - k0
        for lo in range(max(0, 1 - k1), min(a.n, b.n - k0), SEGMENT):
            hi = min(lo + SEGMENT, a.n, b.n - k0)
            width, at = hi - lo, lo + k0 + pad
            part_of = lambda v: _shifts(v, at, count, width)  # noqa: B023, E731
            ok, all_of = None, allowed is None
            if between is not None:
                j = slice(max(0, lo + k0), min(b.n, hi + k1 - 1))
                ranges = [(t[r].min(), t[r].max()) for t, r in zip(times, (slice(lo, hi), slice(lo, hi), j, j), strict=True)]
                all_of = between(*ranges)
                if all_of is False:
                    continue
            if not all_of:
                ok = allowed(times[0][None, lo:hi], times[1][None, lo:hi], part_of(sb), part_of(eb))
                if not ok.any():
                    continue
            sums = np.cumsum(x[None, lo : hi + m - 1] * _shifts(y, at, count, width + m - 1), axis=1)
            slack = 4 * m * EPS * (float(max(sums.max(), -sums.min())) + most)
            low = sums[:, m - 1 :].copy()
            low[:, 1:] -= sums[:, :-m]
            low -= ma[None, lo:hi] * part_of(mb)
            low += slack
            low *= ia[None, lo:hi]
            low *= part_of(ib)
            low += na[None, lo:hi]
            low += part_of(nb)
            if ok is not None and not ok.all():
                low[~ok] = np.inf
            best.offer_tile(low, lambda k: lo + k % width, lambda k: lo + k % width + k0 + k // width)  # noqa: B023
    return best.row()

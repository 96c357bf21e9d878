"""Runs of bins in which two tracks are close, for all pairs of two groups of tracks.

A group pair is looked at in blocks of bounded size. A first pass over the bins only counts, for each pair of a block and in single precision with a margin, the
hits of its current run; the runs themselves are made, in full precision, for the pairs whose count gets to the least one, which are few."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa

# Tracks of one side of a block, numbers of a block's arrays for the other side, numbers of the hits of pairs looked at together.
SIDE, BLOCK, HITS = 128, 500_000, 2_000_000


def squared_limit(metres: float) -> float:
    """The largest square whose root is no more than `metres`, so that squares can be compared for roots."""
    s = metres * metres
    while math.sqrt(s) > metres:
        s = math.nextafter(s, 0.0)
    while math.sqrt(math.nextafter(s, math.inf)) <= metres:
        s = math.nextafter(s, math.inf)
    return s


class _Tracks:
    """Tracks of one group: ids, and for each its bins, places and (only where one of them changes it) routes."""

    def __init__(self, rows: pa.Table, route: object) -> None:
        rows = rows.combine_chunks()
        lists = rows["bins"].combine_chunks()
        self.ids = rows["veh"].to_numpy()
        self.sizes = np.diff(lists.offsets.to_numpy())
        self.bins, self.x, self.y = (rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("bins", "xs", "ys"))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.routes = {i: r for i, r in enumerate(rows["routes"].to_pylist()) if r} if rows["routes"].null_count < len(rows) else {}
        self.route = route

    def grid(self, first: int, last: int, bins: np.ndarray, codes: dict | None) -> tuple[np.ndarray, ...]:
        """x and y (nan where there is no report) and, with codes, routes of the tracks first to last in the given bins: a row for each bin."""
        part = slice(self.starts[first], self.starts[last])
        at, who = self.bins[part], np.repeat(np.arange(last - first), self.sizes[first:last])
        row = np.minimum(np.searchsorted(bins, at), len(bins) - 1)
        fits = bins[row] == at
        row, who = row[fits], who[fits]
        out = []
        for values in (self.x[part], self.y[part]):
            grid = np.full((len(bins), last - first), np.nan)
            grid[row, who] = values[fits]
            out.append(grid)
        if codes is None:
            return *out, None
        own = np.full(self.starts[last] - self.starts[first], codes.setdefault(self.route, len(codes)))
        for i in range(first, last):
            if i in self.routes:
                own[self.starts[i] - self.starts[first] : self.starts[i + 1] - self.starts[first]] = [codes.setdefault(r, len(codes)) for r in self.routes[i]]
        grid = np.full((len(bins), last - first), -1)
        grid[row, who] = own[fits]
        return *out, grid


def _rough(a: tuple, b: tuple, metres: float) -> tuple[tuple, tuple, float]:
    """a and b in single precision about a common middle, and a limit of squares so much larger that no hit is lost; as they are where numbers are too large."""
    out, most = [], 0.0
    for u, v in zip(a[:2], b[:2], strict=True):
        known = np.concatenate([w[np.isfinite(w)] for w in (u, v)])
        low, high = (known.min(), known.max()) if len(known) else (0.0, 0.0)
        middle = low / 2 + high / 2
        most = max(most, high - low, abs(middle) * 2.0**-24)
        out.append((u - middle, v - middle))
    if not most + metres < 1e15:
        return a, b, squared_limit(metres)
    limit = (metres + most * 2.0**-21) ** 2 * (1 + 2.0**-20)
    x, y = ([w.astype(np.float32) for w in pair] for pair in out)
    return (x[0], y[0], a[2]), (x[1], y[1], b[2]), np.nextafter(np.float32(limit), np.float32(np.inf))


def _often(a: tuple, b: tuple, bins: np.ndarray, metres: float, least: int, skip: int) -> np.ndarray:
    """Whether the track of the row and that of the column may have a run of at least `least` (255 at most) hits: true for all that have one."""
    a, b, limit = _rough(a, b, metres)
    shape = (a[0].shape[1], b[0].shape[1])
    d, e = np.empty(shape, a[0].dtype), np.empty(shape, a[0].dtype)
    count, found, recent = np.zeros(shape, np.uint8), np.zeros(shape, bool), []
    for k, now in enumerate(bins.tolist()):
        np.subtract(a[0][k][:, None], b[0][k], out=d)
        np.multiply(d, d, out=d)
        np.subtract(a[1][k][:, None], b[1][k], out=e)
        np.multiply(e, e, out=e)
        np.add(d, e, out=d)
        hit = d <= limit
        if a[2] is not None:
            hit &= a[2][k][:, None] == b[2][k]
        recent = [(at, h) for at, h in recent if now - at <= 1 + skip]
        goes_on = np.zeros(shape, bool)
        for _, h in recent:
            goes_on |= h
        count *= goes_on.view(np.uint8)
        count += hit.view(np.uint8)  # may start again from 0 where it has long been found
        found |= count == least
        recent.append((now, hit))
    return found


def _runs(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, bins: np.ndarray, limit: float, least: int, skip: int, span: tuple[int, int], open_: bool) -> tuple[np.ndarray, ...]:
    """For the runs of pairs i, j: the pair's place in i, first and last hit and number of hits within span; those that go on beyond it (open_), or the others."""
    dx, dy = a[0][:, i] - b[0][:, j], a[1][:, i] - b[1][:, j]
    hit = dx * dx + dy * dy <= limit
    if a[2] is not None:
        hit &= a[2][:, i] == b[2][:, j]
    pair, k = np.nonzero(hit.T)
    at = bins[k]
    new = np.ones(len(at), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (at[1:] - at[:-1] > 1 + skip)
    starts = np.flatnonzero(new)
    if not len(starts):
        return (starts,) * 4
    ends = np.append(starts[1:], len(at)) - 1
    inside = (at >= span[0]) & (at < span[1])
    n = np.add.reduceat(inside.astype(np.int64), starts)
    first = np.minimum.reduceat(np.where(inside, at, span[1]), starts)
    last = np.maximum.reduceat(np.where(inside, at, span[0] - 1), starts)
    beyond = (at[starts] < span[0]) | (at[ends] >= span[1])
    keep = (ends - starts + 1 >= least) & (n > 0) & (beyond == open_)
    return pair[starts][keep], first[keep], last[keep], n[keep]


def runs_of_groups(metres: float, least: int, skip: int, width: int, open_: bool, schema: pa.Schema) -> Callable:
    """A function for applyInArrow by route, chunk, p and q over tracks (g, veh, bins, xs, ys, routes) of the groups p and q."""
    limit = squared_limit(metres)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, chunk, p, q = (k.as_py() for k in key)
        span = (chunk * width, (chunk + 1) * width)
        rows = pa.Table.from_batches(list(batches))
        group = rows["g"].to_numpy()
        left = _Tracks(rows.filter(pa.array(group == p)), route)
        right = left if p == q else _Tracks(rows.filter(pa.array(group == q)), route)
        bins = np.intersect1d(left.bins, right.bins)
        if len(bins) < least:
            return
        codes = {} if left.routes or right.routes else None
        wide = max(16, min(512, BLOCK // len(bins)))
        cut = lambda n, size: list(pairwise([*range(0, n, size), n]))
        for b0, b1 in cut(len(right.ids), wide):
            b = right.grid(b0, b1, bins, codes)
            for a0, a1 in cut(len(left.ids), SIDE):
                if left is right and a0 >= b1:
                    continue
                a = left.grid(a0, a1, bins, codes)
                i, j = np.nonzero(_often(a, b, bins, metres, least, skip))
                if left is right:
                    once = i + a0 < j + b0
                    i, j = i[once], j[once]
                if left.routes and right.routes:  # a pair that shares several routes is told by the least of them
                    shared = lambda s, t: min(set(left.routes.get(s, [route])) & set(right.routes.get(t, [route])))
                    mine = np.array([shared(s + a0, t + b0) == route for s, t in zip(i, j, strict=True)], bool)
                    i, j = i[mine], j[mine]
                for c0, c1 in cut(len(i), max(1, HITS // len(bins))):
                    pair, first, last, n = _runs(a, b, i[c0:c1], j[c0:c1], bins, limit, least, skip, span, open_)
                    if len(pair):
                        one, two = left.ids[a0 + i[c0:c1][pair]], right.ids[b0 + j[c0:c1][pair]]
                        low = one < two
                        values = (np.where(low, one, two), np.where(low, two, one), first, last, n)
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    return run

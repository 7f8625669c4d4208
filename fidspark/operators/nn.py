"""Nearest-neighbour core (J3, J5, T3, F2) and the privacy metrics built on it.

Exact k-NN as a pruned block join; no row passes through the driver but a
bounded sample of pivots:

* base rows go to the cell of their nearest pivot; a cell that is larger than a
  block is several blocks. By the triangle inequality a block's distances to
  its pivot bound from below how near it can come to a query row;
* each query row visits a block of its own cell first, which bounds its k-th
  distance, then only blocks whose lower bound does not exceed that;
* ``cogroup`` brings a block and its visitors into one task, in parts where
  they are many. The task prunes once more in the same way, by cells of its own
  rows, nearest cells first, and emits only its top-k per query row;
* a window over k x (visited blocks) rows per query row merges the lists.

A base of one block needs no pivots and one visit. From ``DENSE`` numbers on,
where little can be pruned, all blocks are visited, as exact neighbours then
require: matrix products find the candidates of a block, and their distances
are then taken as everywhere else.
Ball counts for precision/recall (A31) use the same kernel with a per-base-row
radius; with many numbers, the balls of both sides and the nearest rows come
from one look at each pair. Keys must be distinct within a side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidspark.operators import cdf
from fidspark.session import default_buckets, kept, one_row

BLOCK_BYTES = 32 << 20
BLOCK_ROWS = 1 << 16  # rows of a block, at most, below DENSE numbers: the work of a query row grows with its block
DENSE = 16  # from so many numbers on, blocks meet by matrix products
MIN_QUERY_ROWS = 256  # query rows of a block, at least, where blocks are cut finer to use all cores
FULL_QUERY_ROWS = 1 << 14  # query rows of a block whose work, with DENSE numbers, is large beside what brings it there
SLICE_CELLS = 1_000_000  # query rows x base rows of one numpy slice
SLICE_ROWS = 512  # query rows of a matrix product
EPS = np.finfo(np.float64).eps
MAX_PIVOTS = 4096  # rows that the driver holds as pivots, at most
CELLS_PER_BLOCK = 8  # pivots per block's worth of base rows
SLACK = 1e-9  # relative; lower bounds give way by it, for rounding
NO_VALUE = np.finfo(np.float64).max  # distance of a pair with a null coordinate: after all others


@dataclass
class Space:
    """How rows become coordinates.

    euclidean: sqrt(sum ((x - mu) / sd)^2) over ``num`` (mu/sd given per side),
    the one-hot blocks of ``cat`` counted as coordinates.
    l1: sum |x - y| / range over ``num`` + one-hot L1 over ``cat`` (2 when two
    known categories differ, 1 when one side is unknown).
    """

    num: Sequence[str]
    cat: Sequence[str] = ()
    metric: str = "euclidean"
    scale: dict | None = None  # column -> divisor (or (mu, sd) for z-score)


def zscore_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population std with 0 -> 1) per column; one aggregate, one row."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"] or 0.0, (row[f"s_{c}"] or 0.0) or 1.0) for c in cols}


def _project(df: DataFrame, key: str, space: Space, zs: dict | None, keep: Sequence[str] = ()) -> DataFrame:
    cols = [F.col(key).cast("long").alias("_key"), *keep]
    for c in space.num:
        x = F.col(c).cast("double")
        if zs is not None:
            mu, sd = zs[c]
            x = (x - F.lit(mu)) / F.lit(sd)
        elif space.scale and c in space.scale:
            x = x / F.lit(space.scale[c])
        cols.append(x.alias(f"_n_{c}"))
    for c in space.cat:
        cols.append(F.col(c).cast("string").alias(f"_c_{c}"))
    return df.select(*cols)


def _mask_unknown(rows: DataFrame, space: Space, known: DataFrame) -> DataFrame:
    """Categories that ``known`` does not hold become null; the planner chooses how to join the distinct values."""
    for c in space.cat:
        values = known.select(F.col(c).cast("string").alias("_v")).where("_v IS NOT NULL").distinct()
        rows = rows.join(values, F.col(f"_c_{c}") == F.col("_v"), "left").withColumn(f"_c_{c}", F.col("_v")).drop("_v")
    return rows


def _numbers(pdf: pd.DataFrame, space: Space) -> np.ndarray:
    return np.stack([pdf[f"_n_{c}"].to_numpy(dtype=np.float64) for c in space.num], axis=1) if space.num else np.zeros((len(pdf), 0))


def _categories(q: pd.DataFrame, b: pd.DataFrame, space: Space) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per category column the codes of both blocks (null: -1), numbered over the two blocks."""
    out = []
    for c in space.cat:
        codes, _ = pd.factorize(pd.concat([q[f"_c_{c}"], b[f"_c_{c}"]], ignore_index=True))
        out.append((codes[:len(q)], codes[len(q):]))
    return out


def _distances(qn: np.ndarray, bn: np.ndarray, cats: list, metric: str) -> np.ndarray:
    d = np.zeros((len(qn), len(bn)))
    for j in range(qn.shape[1]):
        diff = qn[:, j, None] - bn[None, :, j]
        d += diff * diff if metric == "euclidean" else np.abs(diff)
    for qc, bc in cats:
        a, b = qc[:, None], bc[None, :]
        d += np.where(a != b, np.where((a < 0) | (b < 0), 1.0, 2.0), 0.0)
    if metric == "euclidean":
        np.sqrt(d, out=d)
    return np.where(np.isnan(d), NO_VALUE, d)


KNN_SCHEMA = "q_key long, rank int, dist double, b_key long"


def _lower_bound(to_pivot: np.ndarray, nearest_: np.ndarray, farthest: np.ndarray) -> np.ndarray:
    """How near rows of a cell (columns) can be to a query row, given the query's and the cell's distances to the pivot."""
    return np.maximum(0.0, np.maximum(to_pivot - farthest, nearest_ - to_pivot) - SLACK * (to_pivot + farthest))


class _Cells:
    """The base rows of a block by the nearest of a few of them, for best-first search; rows ordered by key within a cell."""

    def __init__(self, numbers: np.ndarray, cats: list, metric: str):
        n = len(numbers) if len(numbers) or not cats else len(cats[0][1])
        self.metric, self.numbers, self.cats = metric, numbers, [c for _, c in cats]
        count = int(min(256, max(1, np.sqrt(n))))
        self.pivots = np.unique(np.linspace(0, n - 1, count).astype(np.int64))
        cell, off = np.zeros(n, np.int64), np.zeros(n)
        step = max(1, SLICE_CELLS // len(self.pivots))
        for lo in range(0, n, step):
            d = self.distances(numbers[lo:lo + step], [c[lo:lo + step] for c in self.cats], self.pivots)
            cell[lo:lo + step] = d.argmin(axis=1)
            off[lo:lo + step] = d.min(axis=1)
        self.order = np.argsort(cell, kind="stable")
        cuts = np.searchsorted(cell[self.order], np.arange(len(self.pivots) + 1))
        full = np.diff(cuts) > 0
        self.rows = [self.order[a:b] for a, b in zip(cuts[:-1][full], cuts[1:][full])]
        self.pivots = self.pivots[full]
        self.nearest = np.array([off[r].min() for r in self.rows])
        self.farthest = np.array([off[r].max() for r in self.rows])

    def distances(self, numbers: np.ndarray, cats: list, rows: np.ndarray) -> np.ndarray:
        return _distances(numbers, self.numbers[rows], [(q, c[rows]) for q, c in zip(cats, self.cats)], self.metric)

    def bounds(self, numbers: np.ndarray, cats: list) -> tuple[np.ndarray, np.ndarray]:
        to_pivot = self.distances(numbers, cats, self.pivots)
        return to_pivot, _lower_bound(to_pivot, self.nearest[None, :], self.farthest[None, :])


def _merged(dist: np.ndarray, key: np.ndarray, d: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least (distance, key) of lists (rows of ``dist``, ``key``) and of all distances ``d`` to rows ``keys``, which rise."""
    row, found_d, found_k = np.arange(len(d)), [dist], [key]
    for _ in range(min(k, d.shape[1])):
        at = d.argmin(axis=1)
        found_d.append(d[row, at][:, None])
        found_k.append(keys[at][:, None])
        d[row, at] = np.inf
    all_d, all_k = np.concatenate(found_d, axis=1), np.concatenate(found_k, axis=1)
    by = np.lexsort((all_k, all_d), axis=1)[:, :k]
    return np.take_along_axis(all_d, by, 1), np.take_along_axis(all_k, by, 1)


def _top(cells: _Cells, bk: np.ndarray, qk: np.ndarray, qn: np.ndarray, qc: list, k: int, exclude_self: bool,
         limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distances, keys), k per query row without nulls: the two nearest cells first, then every cell that may hold a nearer row.

    ``limit``: the k-th distance of each query row elsewhere, beyond which no row is looked for.
    """
    limit = np.full(len(qk), np.inf) if limit is None else limit
    dist, key = np.full((len(qk), k), np.inf), np.full((len(qk), k), np.iinfo(np.int64).max)
    to_pivot, bound = cells.bounds(qn, qc)
    left = np.ones(bound.shape, bool)

    def visit(c: int, who: np.ndarray) -> None:
        rows = cells.rows[c]
        left[who, c] = False
        step = max(1, SLICE_CELLS // len(rows))
        for lo in range(0, len(who), step):
            w = who[lo:lo + step]
            d = cells.distances(qn[w], [x[w] for x in qc], rows)
            if exclude_self:
                d[qk[w][:, None] == bk[rows][None, :]] = np.inf
            dist[w], key[w] = _merged(dist[w], key[w], d, bk[rows], k)

    for _ in range(min(2, len(cells.rows))):
        first = np.where(left, to_pivot, np.inf).argmin(axis=1)
        for c in np.unique(first):
            visit(c, np.flatnonzero((first == c) & (bound[:, c] <= np.minimum(dist[:, -1], limit))))
    for c in np.argsort(bound.min(axis=0), kind="stable"):
        visit(c, np.flatnonzero(left[:, c] & (bound[:, c] <= np.minimum(dist[:, -1], limit))))
    return dist, key


def _inside(cells: _Cells, radius: np.ndarray, qn: np.ndarray, qc: list) -> np.ndarray:
    """In how many of the base rows' balls each query row lies."""
    out, (_, bound) = np.zeros(len(qn)), cells.bounds(qn, qc)
    for c, rows in enumerate(cells.rows):
        who = np.flatnonzero(bound[:, c] <= np.nanmax(np.append(radius[rows], -1.0)))
        step = max(1, SLICE_CELLS // len(rows))
        for lo in range(0, len(who), step):
            w = who[lo:lo + step]
            out[w] += (cells.distances(qn[w], [x[w] for x in qc], rows) < radius[rows][None, :]).sum(axis=1)
    return out


class _Dense:
    """The base rows of a block of many numbers; matrix products tell squared distances but for a slack.

    A product gives y^2 - 2xy, a slice of query and base rows at a time, and the least of each query row tells whether its
    slice holds anything of interest; only then are single pairs looked at.
    """

    def __init__(self, numbers: np.ndarray, shift: np.ndarray | None = None):
        """``shift``: taken from the squared distances to each base row."""
        self.turned = np.ascontiguousarray(numbers.T)
        self.square = np.einsum("ij,ij->i", numbers, numbers)
        self.most = self.square.max(initial=0.0)
        self.product = np.concatenate([-2.0 * self.turned, (self.square if shift is None else self.square - shift)[None, :]])

    def queries(self, qn: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(query rows, these with a 1, their squares, the slack of each)."""
        for lo in range(0, len(qn), SLICE_ROWS):
            x = np.concatenate([qn[lo:lo + SLICE_ROWS], np.ones((len(qn[lo:lo + SLICE_ROWS]), 1))], axis=1)
            own = np.einsum("ij,ij->i", x[:, :-1], x[:, :-1])
            yield slice(lo, lo + len(x)), x, own, 16 * (qn.shape[1] + 8) * EPS * (own + self.most)

    def slices(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(the first base row, y^2 - 2xy, the least of each query row); the array is used again."""
        n = self.product.shape[1]
        step = max(1, SLICE_CELLS // 2 // max(len(x), 1))
        room = np.empty((len(x), min(step, n)))
        for lo in range(0, n, step):
            cut = self.product[:, lo:lo + step]
            rough = np.matmul(x, cut, out=room if cut.shape[1] == room.shape[1] else None)
            yield lo, rough, rough.min(axis=1)

    def exact(self, qn: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Distances of pairs, added up in the order of ``_distances``."""
        d = np.zeros(len(row))
        for j in range(qn.shape[1]):
            diff = qn[row, j] - self.turned[j, col]
            d += diff * diff
        return np.sqrt(d)

    def nearer(self, x: np.ndarray, own: np.ndarray, slack: np.ndarray, lo: int, rough: np.ndarray, low: np.ndarray,
               bk: np.ndarray, dist: np.ndarray, key: np.ndarray) -> None:
        """The lists (rows of ``dist``, ``key``) with the base rows of a slice that belong to them; ``bk``: the keys of all base rows."""
        k = dist.shape[1]
        kth = dist[:, -1]
        most = kth * kth * (1 + 8 * EPS) + 2 * slack - own
        open_ = np.flatnonzero(np.isinf(kth))  # lists that are not full take the first of the slice
        if len(open_):
            least = min(k, rough.shape[1])
            some = rough[open_]
            first = some.min(axis=1) if least == 1 else np.partition(some, least - 1, axis=1)[:, least - 1]
            most[open_] = first + 2 * slack[open_]
        np.minimum(most, NO_VALUE, out=most)  # the row itself, at inf, is no neighbour
        rows = np.flatnonzero(low <= most)
        if not len(rows):
            return
        at, col = np.nonzero((rough if len(rows) == len(rough) else rough[rows]) <= most[rows][:, None])
        found = self.exact(x[:, :-1], rows[at], lo + col)
        at = np.concatenate([np.repeat(np.arange(len(rows)), k), at])
        d = np.concatenate([dist[rows].ravel(), found])
        b = np.concatenate([key[rows].ravel(), bk[lo + col]])
        by = np.lexsort((b, d, at))
        at, d, b = at[by], d[by], b[by]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        at, d, b, place = (z[place < k] for z in (at, d, b, place))
        dist[rows[at], place], key[rows[at], place] = d, b

    def top(self, bk: np.ndarray, qk: np.ndarray, qn: np.ndarray, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of each query row; ``bk`` rises."""
        dist, key = np.full((len(qk), k), np.inf), np.full((len(qk), k), np.iinfo(np.int64).max)
        same = np.minimum(np.searchsorted(bk, qk), len(bk) - 1)
        same = np.where(exclude_self & (bk[same] == qk), same, -1)
        for part, x, own, slack in self.queries(qn):
            self_at = same[part]
            for lo, rough, low in self.slices(x):
                rows = np.flatnonzero((self_at >= lo) & (self_at < lo + rough.shape[1]))
                if len(rows):
                    rough[rows, self_at[rows] - lo] = np.inf
                    low[rows] = rough[rows].min(axis=1)
                self.nearer(x, own, slack, lo, rough, low, bk, dist[part], key[part])
        return dist, key

    def inside(self, radius: np.ndarray, qn: np.ndarray) -> np.ndarray:
        """In how many of the base rows' balls each query row lies."""
        out, ball = np.zeros(len(qn)), np.flatnonzero(radius > 0)
        held = _Dense(self.turned[:, ball].T, radius[ball] * radius[ball])
        for part, x, own, slack in held.queries(qn):
            for lo, rough, low in held.slices(x):
                held.in_balls(x, own, slack, lo, rough, low, radius[ball], out[part])
        return out

    def in_balls(self, x: np.ndarray, own: np.ndarray, slack: np.ndarray, lo: int, rough: np.ndarray, low: np.ndarray,
                 radius: np.ndarray, out: np.ndarray) -> None:
        """Adds to ``out`` in how many balls of a slice each query row lies; ``rough`` and ``low`` are without the squared radii."""
        rad = radius[lo:lo + rough.shape[1]]
        unsure = 8 * EPS * rad * rad
        rows = np.flatnonzero(low <= 2 * slack + unsure.max(initial=0.0) - own)
        if len(rows):
            off = rough[rows] + own[rows][:, None]
            unsure = 2 * slack[rows][:, None] + unsure[None, :]
            at, col = np.nonzero(np.abs(off) <= unsure)
            true = self.exact(x[:, :-1], rows[at], lo + col) < rad[col]
            out[rows] += (off < -unsure).sum(axis=1) + np.bincount(at[true], minlength=len(rows))

    def mutual(self, bk: np.ndarray, radius: np.ndarray, q_radius: np.ndarray, qn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From one product of each pair: the nearest base row's distance of each query row, in how many of the base rows'
        balls it lies, and in how many of the query rows' balls each base row lies."""
        dist, key, inside, held = np.full((len(qn), 1), np.inf), np.full((len(qn), 1), np.iinfo(np.int64).max), np.zeros(len(qn)), np.zeros(len(bk))
        rad = np.where(radius > 0, radius, 0.0)  # of a point: nothing is nearer than 0
        for part, x, own, slack in self.queries(qn):
            mine = q_radius[part]
            unsure = 2 * slack + 8 * EPS * mine * mine
            for lo, rough, low in self.slices(x):
                self.nearer(x, own, slack, lo, rough, low, bk, dist[part], key[part])
                rows = np.flatnonzero(low <= mine * mine + unsure - own)  # a ball without a radius (NaN) holds none
                if len(rows):
                    off = rough[rows] + (own - mine * mine)[rows][:, None]
                    at, col = np.nonzero(np.abs(off) <= unsure[rows][:, None])
                    true = self.exact(x[:, :-1], rows[at], lo + col) < mine[rows[at]]
                    held[lo:lo + rough.shape[1]] += (off < -unsure[rows][:, None]).sum(axis=0) + np.bincount(col[true], minlength=rough.shape[1])
                rough -= (rad * rad)[None, lo:lo + rough.shape[1]]
                self.in_balls(x, own, slack, lo, rough, rough.min(axis=1), rad, inside[part])
        return dist[:, 0], inside, held


def _tame(*sides: np.ndarray) -> bool:
    """Whether the squares of all numbers are far from overflow."""
    return all(bool((np.abs(n) < 1e150).all()) for n in sides)


def _block_kernel(space: Space, k: int, exclude_self: bool, mode: str):
    """One pair of blocks: the k nearest base rows per query row, ties by key, or the number of balls it lies in.

    Pairs with a null coordinate come after all others, by key, at NO_VALUE.
    """
    def run(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)], [np.zeros(0, np.int64)]
        if len(q) and (len(b) or mode == "ball"):
            b = b.sort_values("_key", kind="stable")  # the first of equal distances has the smallest key
            qk, bk = q["_key"].to_numpy(dtype=np.int64), b["_key"].to_numpy(dtype=np.int64)
            qn, bn, cats = _numbers(q, space), _numbers(b, space), _categories(q, b, space)
            q_null, b_null = np.isnan(qn).any(axis=1), np.isnan(bn).any(axis=1)
            full = np.flatnonzero(~b_null)
            dense = _is_dense(space) and len(full) > 0 and _tame(bn[full], qn[~q_null])
            held = _Dense(bn[full]) if dense else None
            cells = _Cells(bn[full], [(x, y[full]) for x, y in cats], space.metric) if len(full) and not dense else None
            limit = np.nan_to_num(q["_kth"].to_numpy(dtype=np.float64), nan=np.inf) if "_kth" in q else np.full(len(q), np.inf)
            radius = b["_rad"].to_numpy(dtype=np.float64) if mode == "ball" else None
            for s in range(0, len(qk), 4096):
                part = np.arange(s, min(s + 4096, len(qk)))
                some = part[~q_null[part]]
                if mode == "ball":
                    inside = np.zeros(len(part))
                    if dense:
                        inside[~q_null[part]] = held.inside(radius[full], qn[some])
                    if cells is not None:
                        inside[~q_null[part]] = _inside(cells, radius[full], qn[some], [x[some] for x, _ in cats])
                    found = [(qk[part], 0, inside, np.full(len(part), -1))]
                else:
                    dist = np.full((len(part), k), np.inf)
                    key = np.full((len(part), k), np.iinfo(np.int64).max)
                    if dense and len(some):
                        rows = np.flatnonzero(~q_null[part])
                        dist[rows], key[rows] = held.top(bk[full], qk[some], qn[some], k, exclude_self)
                    if cells is not None and len(some):
                        rows = np.flatnonzero(~q_null[part])
                        dist[rows], key[rows] = _top(cells, bk[full], qk[some], qn[some], [x[some] for x, _ in cats], k, exclude_self, limit[some])
                    # rows that have no distance fill the lists that are not full, by key
                    for rows, tail in ((np.flatnonzero(~q_null[part]), bk[b_null][:k + 1]), (np.flatnonzero(q_null[part]), bk[:k + 1])):
                        if len(rows) and len(tail):
                            d = np.full((len(rows), len(tail)), NO_VALUE)
                            if exclude_self:
                                d[qk[part][rows][:, None] == tail[None, :]] = np.inf
                            dist[rows], key[rows] = _merged(dist[rows], key[rows], d, tail, k)
                    found = [(qk[part][dist[:, i] < np.inf], i + 1, dist[dist[:, i] < np.inf, i], key[dist[:, i] < np.inf, i]) for i in range(k)]
                for keys, rank, d, other in found:
                    for to, values in zip(parts, (keys, np.full(len(keys), rank, np.int32), d, other)):
                        to.append(values)
        return pd.DataFrame(dict(zip(("q_key", "rank", "dist", "b_key"), map(np.concatenate, parts))))

    return run


MUTUAL_SCHEMA = "side int, key long, balls double, nearest double, radius double"


def _mutual_kernel(space: Space):
    """One pair of blocks, each row with the radius of its ball (_rad): per query row (side 0) the nearest base row's distance
    and the number of base rows' balls it lies in, per base row (side 1) the number of query rows' balls."""
    def run(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("_key", kind="stable")
        (qn, q_rad), (bn, b_rad) = ((_numbers(x, space), x["_rad"].to_numpy(dtype=np.float64)) for x in (q, b))
        qs, bs = (np.flatnonzero(~np.isnan(n).any(axis=1)) for n in (qn, bn))
        bk, near, q_balls, b_balls = b["_key"].to_numpy(dtype=np.int64), np.full(len(q), np.nan), np.zeros(len(q)), np.zeros(len(b))
        if len(qs) and len(bs):
            if _tame(qn[qs], bn[bs]):
                near[qs], q_balls[qs], b_balls[bs] = _Dense(bn[bs]).mutual(bk[bs], b_rad[bs], q_rad[qs], qn[qs])
            else:
                qk, cells, own = q["_key"].to_numpy(dtype=np.int64), _Cells(bn[bs], [], space.metric), _Cells(qn[qs], [], space.metric)
                for s in range(0, len(qs), 4096):
                    some = qs[s:s + 4096]
                    near[some] = _top(cells, bk[bs], qk[some], qn[some], [], 1, False)[0][:, 0]
                    q_balls[some] = _inside(cells, b_rad[bs], qn[some], [])
                for s in range(0, len(bs), 4096):
                    b_balls[bs[s:s + 4096]] = _inside(own, q_rad[qs], bn[bs[s:s + 4096]], [])
                near[near >= NO_VALUE] = np.nan
        side = np.repeat(np.array([0, 1], np.int32), [len(q), len(b)])
        return pd.DataFrame({"side": side, "key": np.concatenate([q["_key"].to_numpy(dtype=np.int64), bk]), "balls": np.concatenate([q_balls, b_balls]),
                             "nearest": np.concatenate([near, np.full(len(b), np.nan)]), "radius": np.concatenate([q_rad, b_rad])})

    return run


def _is_dense(space: Space) -> bool:
    return len(space.num) >= DENSE and not space.cat and space.metric == "euclidean"


def _per_block(space: Space, block_bytes: int) -> int:
    rows = max(1, block_bytes // (8 * (2 + len(space.num)) + 32 * len(space.cat)))
    return rows if _is_dense(space) else min(rows, BLOCK_ROWS)


def _valid(space: Space) -> Column:
    """Whether a projected row has all coordinates."""
    return reduce(lambda a, b: a & b, [F.col(f"_n_{c}").isNotNull() & ~F.isnan(f"_n_{c}") for c in space.num], F.lit(True))


class _Pivots:
    """A bounded sample of base rows, the cells around them and the blocks of these cells."""

    def __init__(self, base: DataFrame, space: Space, n_blocks: int, per_block: int, k: int, groups: dict[int, int] | None = None):
        """``groups``: the sizes of groups (by _code), each of which has pivots and cells of its own."""
        self.space, self.per_block, self.least = space, per_block, k + 1
        wanted = min(MAX_PIVOTS, CELLS_PER_BLOCK * n_blocks)
        by_hash = [F.xxhash64("_key"), F.col("_key")]
        if groups is None:
            some = base.orderBy(*by_hash).limit(wanted)
        else:  # each group's first rows by hash, as many as its share asks for
            most = max(1, wanted // len(groups) * 4)
            first = base.withColumn("_rn", F.row_number().over(Window.partitionBy("_code").orderBy(*by_hash))).where(F.col("_rn") <= most)
            share = {c: max(1, wanted * n // sum(groups.values())) for c, n in groups.items()}
            some = reduce(lambda a, b: a | b, [(F.col("_code") == c) & (F.col("_rn") <= n) for c, n in share.items()])
            some = first.where(some).drop("_rn")
        self.rows = some.toPandas()  # MAX_PIVOTS rows at most, or one per group
        self.code = None if groups is None else self.rows["_code"].to_numpy(dtype=np.int64)
        self.base = self._near(base, None)
        found = self.base.groupBy("_cell").agg(F.count("*").alias("n"), F.min("_off").alias("lo"), F.max("_off").alias("hi")).collect()
        n = len(self.rows)  # one number each per pivot
        self.n, self.lo, self.hi = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for r in found:
            self.n[r["_cell"]], self.lo[r["_cell"]], self.hi[r["_cell"]] = r["n"], r["lo"], r["hi"]
        self.parts = -(-self.n // per_block)

    def _near(self, rows: DataFrame, least: int | None) -> DataFrame:
        """``rows`` with _cell, the nearest pivot's, and _off, the distance to it; ``least``: only cells of so many rows."""
        space, pivots = self.space, self.rows
        code = self.code
        if least is None:
            open_ = np.arange(len(pivots))
        elif code is None:
            open_ = np.flatnonzero(self.n >= min(least, self.n.max()))
        else:
            fullest = pd.Series(self.n).groupby(code).transform("max").to_numpy()
            open_ = np.flatnonzero(self.n >= np.minimum(least, fullest))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                d = _to_pivots(pdf, pivots.iloc[open_], space)
                if code is not None:
                    d[pdf["_code"].to_numpy(dtype=np.int64)[:, None] != code[open_][None, :]] = np.inf
                yield pdf.assign(_cell=open_[d.argmin(axis=1)].astype(np.int32) if len(d) else np.zeros(0, np.int32), _off=d.min(axis=1) if len(d) else np.zeros(0))

        return rows.mapInPandas(run, _schema(rows, "_cell int, _off double"))

    def home(self, query: DataFrame) -> DataFrame:
        """``query`` with the block (_cell, _part) that each row visits first."""
        return self._with_part(self._near(query, self.least).drop("_off"))

    def _with_part(self, rows: DataFrame) -> DataFrame:
        parts = F.get(F.array(*[F.lit(int(x)) for x in self.parts]), F.col("_cell"))
        return rows.withColumn("_part", F.pmod(F.xxhash64("_key"), parts).cast("int"))

    def further(self, query: DataFrame) -> DataFrame:
        """``query`` (with _cell, _part, its first block, and _kth, its k-th distance there) once for each other block it has to visit."""
        space, pivots, lo, hi, parts, live, code = self.space, self.rows, self.lo, self.hi, self.parts, self.n > 0, self.code

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for s in range(0, len(pdf), 4096):
                    some = pdf.iloc[s:s + 4096]
                    kth = some["_kth"].to_numpy(dtype=np.float64)
                    kth[np.isnan(kth)] = np.inf
                    bound = _lower_bound(_to_pivots(some, pivots, space), lo[None, :], hi[None, :])
                    visit = live[None, :] & (bound <= kth[:, None])
                    if code is not None:
                        visit &= some["_code"].to_numpy(dtype=np.int64)[:, None] == code[None, :]
                    row, cell = np.nonzero(visit)
                    row, cell = np.repeat(row, parts[cell]), np.repeat(cell, parts[cell])
                    same = np.append(False, (row[1:] == row[:-1]) & (cell[1:] == cell[:-1])) if len(row) else np.zeros(0, bool)
                    at = np.arange(len(row))
                    part = at - np.maximum.accumulate(np.where(same, 0, at)) if len(row) else at
                    new = ~((cell == some["_cell"].to_numpy()[row]) & (part == some["_part"].to_numpy()[row]))
                    yield some.iloc[row[new]].assign(_cell=cell[new].astype(np.int32), _part=part[new].astype(np.int32))

        return query.mapInPandas(run, query.schema)

    def meet(self, query: DataFrame, kernel) -> DataFrame:
        """The kernel over each block and its visitors, which are split where they are more than a block's rows."""
        visits = {r["_cell"]: r["n"] for r in query.groupBy("_cell", "_part").agg(F.count("*").alias("n")).groupBy("_cell").agg(F.max("n").alias("n")).collect()}
        split = F.get(F.array(*[F.lit(int(-(-visits.get(i, 0) // self.per_block))) for i in range(len(self.rows))]), F.col("_cell"))
        keys = ["_cell", "_part", "_turn"]
        asked = query.withColumn("_turn", F.pmod(F.xxhash64("_key", F.lit(1)), split).cast("int"))
        held = self._with_part(self.base.drop("_off")).where(split > 0).withColumn("_turn", F.explode(F.sequence(F.lit(0), split - 1)))
        return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(kernel, KNN_SCHEMA)


def _to_pivots(rows: pd.DataFrame, pivots: pd.DataFrame, space: Space) -> np.ndarray:
    return _distances(_numbers(rows, space), _numbers(pivots, space), _categories(rows, pivots, space), space.metric)


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + more


def size_of(df: DataFrame, space: Space) -> tuple[int, int]:
    """How many rows ``df`` has, and how many with all coordinates."""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in space.num], F.lit(True))
    return tuple(df.agg(F.count("*"), F.count_if(full)).first())


def _prepared(query: DataFrame, q_key: str, base: DataFrame, b_key: str, space: Space, q_stats, b_stats, known) -> tuple[DataFrame, DataFrame]:
    qp, bp = _project(query, q_key, space, q_stats), _project(base, b_key, space, b_stats)
    if space.cat:
        qp = _mask_unknown(qp, space, base if known is None else known)
    return qp, bp


def _merge(out: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q_key").orderBy("dist", "b_key")  # k rows per block visited
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(
    query: DataFrame, q_key: str, base: DataFrame, b_key: str, space: Space, k: int = 1,
    exclude_self: bool = False, q_stats: dict | None = None, b_stats: dict | None = None,
    known: DataFrame | None = None, block_bytes: int = BLOCK_BYTES, mode: str = "knn",
    radius: DataFrame | None = None, q_size: tuple[int, int] | None = None, b_size: tuple[int, int] | None = None,
) -> DataFrame:
    """Exact k nearest base rows per query row: (q_key, rank, dist, b_key); ties go to the smaller key.

    ``q_stats`` / ``b_stats``: z-score parameters for each side (euclidean).
    ``known``: rows whose categories count as known (default: ``base``).
    ``mode='ball'``: instead of neighbours, count base rows with dist < their
    radius (``radius``: (b_key, radius)); returned in ``dist`` with rank 0.
    ``q_size`` / ``b_size``: what ``size_of`` gives for a side, if known.
    A pair with a null coordinate comes after all others, with a null
    distance. An empty base gives no rows.
    """
    qp, bp = _prepared(query, q_key, base, b_key, space, q_stats, b_stats, known)
    n_query, _ = q_size or size_of(query, space)
    n_base, n_full = b_size or size_of(base, space)
    per_block = _per_block(space, block_bytes)
    b_blocks = max(1, -(-n_base // per_block))
    if radius is not None:
        bp = bp.join(radius.select(F.col(radius.columns[0]).cast("long").alias("_key"),
                                   F.col(radius.columns[1]).alias("_rad")), "_key", "left")
    kernel = _block_kernel(space, k, exclude_self, mode)
    if mode == "knn" and space.num and not _is_dense(space) and n_full > max(per_block, k + 1):  # so no list needs a row without a distance
        out = _pruned(qp, bp, space, k, exclude_self, kernel, b_blocks, max(per_block, k + 1))
        return out.withColumn("dist", F.when(F.col("dist") < float(NO_VALUE), F.col("dist")))
    out = _grid(qp, n_query, bp, n_base, per_block, _is_dense(space)).applyInPandas(kernel, KNN_SCHEMA)
    if mode == "ball":
        return out.groupBy("q_key").agg(F.lit(0).alias("rank"), F.sum("dist").alias("dist"), F.lit(-1).cast("long").alias("b_key"))
    if b_blocks > 1:
        out = _merge(out, k)
    return out.withColumn("dist", F.when(F.col("dist") < float(NO_VALUE), F.col("dist")))


def _grid(qp: DataFrame, n_query: int, bp: DataFrame, n_base: int, per_block: int, dense: bool):
    """Each block of query rows with each block of base rows, cogrouped.

    Every block of query rows gets the whole base, so there are no more of them than keep the cores busy: two tasks a core, and
    up to eight where a block's work is large beside what brings it there.
    """
    cores, b_blocks = qp.sparkSession.sparkContext.defaultParallelism, max(1, -(-n_base // per_block))
    fine = min(-(-2 * cores // b_blocks), -(-n_query // MIN_QUERY_ROWS))
    if dense:
        fine = max(fine, min(-(-8 * cores // b_blocks), -(-n_query // FULL_QUERY_ROWS)))
    q_blocks = max(1, -(-n_query // per_block), fine)

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("_key"), F.lit(blocks)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    pair = ["_qb", "_bb"]
    return dealt(qp, "_qb", q_blocks, "_bb", b_blocks).groupBy(*pair).cogroup(dealt(bp, "_bb", b_blocks, "_qb", q_blocks).groupBy(*pair))


def _visited(qp: DataFrame, bp: DataFrame, space: Space, k: int, kernel, b_blocks: int, per_block: int) -> tuple[_Pivots, DataFrame, DataFrame, DataFrame]:
    """Pivots, the query rows at their first blocks, what they find there, and the rows at the further blocks they visit."""
    pivots = _Pivots(bp.where(_valid(space)), space, b_blocks, per_block, k)
    query = qp.where(_valid(space))
    return pivots, pivots.home(query), *_first_and_further(pivots, query, k, kernel)


def _first_and_further(pivots: _Pivots, query: DataFrame, k: int, kernel) -> tuple[DataFrame, DataFrame]:
    """What query rows find at their first blocks, and the rows at the further blocks they visit."""
    home = pivots.home(query)
    first = kept(pivots.meet(home, kernel), "neighbours")  # needed to find the further visits, to count them and in the result
    kth = first.where(F.col("rank") == k).select(F.col("q_key").alias("_key"), F.col("dist").alias("_kth"))
    return first, pivots.further(home.join(kth, "_key", "left"))


def _pruned(qp: DataFrame, bp: DataFrame, space: Space, k: int, exclude_self: bool, kernel, b_blocks: int, per_block: int) -> DataFrame:
    """The block join over visited blocks only; there are more base rows with all coordinates than a block holds."""
    pivots, _, first, more = _visited(qp, bp, space, k, kernel, b_blocks, per_block)
    out = _merge(first.unionByName(pivots.meet(kept(more, "visits"), kernel)), k)
    # a query row without all coordinates is as far from any base row: the first keys are its neighbours
    keys = [r["_key"] for r in bp.select("_key").orderBy("_key").limit(k + 1).collect()]
    tail = qp.where(~_valid(space)).select(F.col("_key").alias("q_key"), F.posexplode(
        F.slice(F.filter(F.array(*[F.lit(x) for x in keys]), lambda x: x != F.col("_key")) if exclude_self else F.array(*[F.lit(x) for x in keys]), 1, k)).alias("rank", "b_key"))
    return out.unionByName(tail.select("q_key", F.col("rank") + 1, F.lit(float(NO_VALUE)).alias("dist"), "b_key").toDF("q_key", "rank", "dist", "b_key"))


def visit_counts(query: DataFrame, q_key: str, base: DataFrame, b_key: str, space: Space, k: int = 1, block_bytes: int = BLOCK_BYTES,
                 exclude_self: bool = False) -> tuple[int, int]:
    """(visits, rows x blocks): in how many blocks the pruned join looks for how many it could; to judge pruning on a table."""
    qp, bp = _prepared(query, q_key, base, b_key, space, None, None, None)
    per_block = max(_per_block(space, block_bytes), k + 1)
    kernel = _block_kernel(space, k, exclude_self, "knn")
    pivots, home, _, more = _visited(qp, bp, space, k, kernel, max(1, -(-bp.count() // per_block)), per_block)
    n = home.count()
    return n + more.count(), n * int(pivots.parts.sum())


def knn_within(df: DataFrame, key: str, group: str, space: Space, k: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact k nearest other rows of the same group: (q_key, rank, dist, b_key); one join for all groups.

    Groups of more than a block are one pruned join, in which each has pivots
    and cells of its own, so a group that holds most rows is many tasks and a
    row visits few blocks. Smaller groups share tasks. Rows without all
    coordinates, and groups with more of them than leave k others, meet all
    blocks of their group. Null is a group. Coordinates are taken as they are.
    """
    rows = _project(df.select("*", F.col(group).alias("_group")), key, space, None, ["_group"])
    per_block = max(_per_block(space, block_bytes), k + 1)
    if not space.num or _is_dense(space):
        return _within(rows, None, space, k, True, block_bytes)
    coded = rows.withColumn("_code", F.xxhash64("_group"))
    sizes = coded.groupBy("_code").agg(F.count("*").alias("n"), F.count_if(_valid(space)).alias("full"))
    large = {r["_code"]: r["full"] for r in sizes.where(F.col("full") > per_block).collect()}  # fewer than there are blocks
    if not large:
        return _within(rows, None, space, k, True, block_bytes)
    inside = F.col("_code").isin(list(large)) & _valid(space)  # these have k others with all coordinates
    base = coded.where(inside).drop("_group")
    pivots = _Pivots(base, space, -(-sum(large.values()) // per_block), per_block, k, large)
    kernel = _block_kernel(space, k, True, "knn")
    first, more = _first_and_further(pivots, base, k, kernel)
    found = _merge(first.unionByName(pivots.meet(kept(more, "visits"), kernel)), k)
    found = found.select("q_key", "rank", F.when(F.col("dist") < float(NO_VALUE), F.col("dist")).alias("dist"), "b_key")
    rest = coded.where(~F.col("_code").isin(list(large))).drop("_code")
    found = found.unionByName(_within(rest, None, space, k, True, block_bytes))
    if sizes.where((F.col("full") > per_block) & (F.col("full") < F.col("n"))).isEmpty():
        return found
    # a row without all coordinates is as far from any other: the first keys of its group are its neighbours
    by_key = Window.partitionBy("_code").orderBy("_key")
    first_keys = coded.where(F.col("_code").isin(list(large))).withColumn("_rn", F.row_number().over(by_key)).where(F.col("_rn") <= k + 1)
    keys = first_keys.groupBy("_code").agg(F.sort_array(F.collect_list("_key")).alias("_keys"))
    tail = coded.where(F.col("_code").isin(list(large)) & ~_valid(space)).join(F.broadcast(keys), "_code")
    near = F.slice(F.filter("_keys", lambda x: x != F.col("_key")), 1, k)
    return found.unionByName(tail.select(F.col("_key").alias("q_key"), F.posexplode(near).alias("_at", "b_key")).select(
        "q_key", (F.col("_at") + 1).alias("rank"), F.lit(None).cast("double").alias("dist"), "b_key"))


def _within(rows: DataFrame, query: DataFrame | None, space: Space, k: int, exclude_self: bool, block_bytes: int) -> DataFrame:
    """k nearest rows of the same _group, of ``rows`` for ``query`` (default: for themselves).

    Both sides of a group are split into blocks by their sizes; groups of one
    block share tasks, so that many small ones cost little.
    """
    per_block = _per_block(space, block_bytes)

    def blocks(of: DataFrame, name: str) -> DataFrame:
        return of.groupBy(F.col("_group").alias(f"_of{name}")).agg(F.ceil(F.count("*") / per_block).cast("int").alias(name))

    def sized(of: DataFrame, own: str, other: str) -> DataFrame:
        for x in sizes:
            of = of.join(x, F.col("_group").eqNullSafe(F.col(x.columns[0]))).drop(x.columns[0])
        small = (F.col("_qn") == 1) & (F.col("_bn") == 1)
        of = of.withColumn("_pack", F.when(small, F.pmod(F.xxhash64("_group"), F.lit(packs))).otherwise(F.xxhash64("_group", F.lit(1))))
        of = of.withColumn("_code", F.xxhash64("_group"))
        of = of.withColumn(f"{own[:2]}b", F.pmod(F.xxhash64("_key"), F.col(own)).cast("int"))
        return of.withColumn(f"{other[:2]}b", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_qn", "_bn")

    packs = 4 * default_buckets(rows.sparkSession)
    sizes = [blocks(rows if query is None else query, "_qn"), blocks(rows, "_bn")]
    base = sized(rows.select(*[F.col(c).alias(c) for c in rows.columns]), "_bn", "_qn")
    asked = sized(rows if query is None else query, "_qn", "_bn")
    keys = ["_pack", "_qb", "_bb"]
    out = asked.drop("_group").groupBy(*keys).cogroup(base.drop("_group").groupBy(*keys)).applyInPandas(
        _per_group(_block_kernel(space, k, exclude_self, "knn")), KNN_SCHEMA)
    if query is not None:  # a pair may meet in several groups
        out = out.groupBy("q_key", "b_key").agg(F.min("dist").alias("dist"))
    return _merge(out, k).select("q_key", "rank", F.when(F.col("dist") < float(NO_VALUE), F.col("dist")).alias("dist"), "b_key")


def _per_group(kernel):
    """``kernel`` for each _code that both sides hold."""
    def run(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ours, theirs = q.groupby("_code").indices, b.groupby("_code").indices
        return pd.concat([kernel(q.head(0), b.head(0)), *(kernel(q.iloc[rows], b.iloc[theirs[code]]) for code, rows in ours.items() if code in theirs)])

    return run


TABLES, PROJECTIONS, SAMPLE_ROWS = 10, 4, 4096


def bucket_width(query: DataFrame, q_key: str, base: DataFrame, b_key: str, space: Space, k: int = 1, q_stats: dict | None = None,
                 b_stats: dict | None = None, rows: int = SAMPLE_ROWS) -> float:
    """The median k-th distance between samples of at most ``rows`` base and 256 query rows, four times (l1: eight times).

    Sampled neighbours are farther than true ones, so buckets err to the wide side.
    """
    qp, bp = _prepared(query, q_key, base, b_key, space, q_stats, b_stats, None)
    some = [d.where(_valid(space)).orderBy(F.xxhash64("_key"), "_key").limit(n).toPandas() for d, n in ((qp, 256), (bp, rows))]
    if not len(some[0]) or len(some[1]) < 2:
        return 1.0
    d = _to_pivots(some[0], some[1], space)
    d[some[0]["_key"].to_numpy()[:, None] == some[1]["_key"].to_numpy()[None, :]] = np.inf
    kth = np.sort(d, axis=1)[:, min(k, d.shape[1]) - 1]
    return float({"euclidean": 4, "l1": 8}[space.metric] * np.median(kth[kth < np.inf])) if (kth < np.inf).any() and np.median(kth[kth < np.inf]) > 0 else 1.0


def knn_approximate(
    query: DataFrame, q_key: str, base: DataFrame, b_key: str, space: Space, k: int = 1, exclude_self: bool = False,
    q_stats: dict | None = None, b_stats: dict | None = None, width: float | None = None, tables: int = TABLES,
    projections: int = PROJECTIONS, seed: int = 0, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """K near base rows per query row, (q_key, rank, dist, b_key), by buckets of random projections.

    In each of ``tables`` tables, ``projections`` p-stable projections (normal
    for euclidean, Cauchy for l1), cut into steps of ``width``, name a bucket;
    rows that share a bucket in any table are candidates, and their true
    distances rank them. A bucket is split into blocks by its size, none is
    capped. A query row that finds fewer than k candidates, or lacks a
    coordinate, is answered by the exact join, so every list is full. Only
    numbers make buckets (``space.cat`` must be empty). Distances are exact;
    what may be missing is a neighbour that shares no bucket.
    """
    if space.cat:
        raise ValueError("buckets need numeric coordinates")
    if width is None:
        width = bucket_width(query, q_key, base, b_key, space, k, q_stats, b_stats)
    rng = np.random.default_rng(seed)
    shape = (len(space.num), tables * projections)
    axes = rng.normal(size=shape) if space.metric == "euclidean" else rng.standard_cauchy(size=shape)
    shift = rng.uniform(size=tables * projections)
    qp, bp = _prepared(query, q_key, base, b_key, space, q_stats, b_stats, None)

    def bucketed(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                steps = np.floor(_numbers(pdf, space) @ axes / width + shift).astype(np.int64).reshape(len(pdf), tables, projections)
                for t in range(tables):
                    yield pdf.assign(_table=np.int32(t), **{f"_p{i}": steps[:, t, i] for i in range(projections)})

        names = ["_table", *(f"_p{i}" for i in range(projections))]
        named = rows.where(_valid(space)).mapInPandas(run, _schema(rows, "_table int, " + ", ".join(f"{c} long" for c in names[1:])))
        return named.withColumn("_group", F.xxhash64(*names)).drop(*names)  # buckets of equal hash only add candidates

    found = _within(bucketed(bp), bucketed(qp), space, k, exclude_self, block_bytes)
    full = found.where(F.col("rank") == k).select(F.col("q_key").alias("_done"))
    rest = query.join(full, F.col(q_key).cast("long") == F.col("_done"), "left_anti")
    exact = knn(rest, q_key, base, b_key, space, k, exclude_self, q_stats, b_stats, block_bytes=block_bytes, q_size=size_of(query, space))
    return found.join(full, F.col("q_key") == F.col("_done"), "left_semi").unionByName(exact)


def nearest(query: DataFrame, q_key: str, base: DataFrame, b_key: str, space: Space, k: int = 2,
            **kw) -> DataFrame:
    """Wide form: (q_key, d1, d2.., nn1, nn2..)."""
    long = knn(query, q_key, base, b_key, space, k, **kw)
    return long.groupBy("q_key").agg(
        *[F.max(F.when(F.col("rank") == i, F.col("dist"))).alias(f"d{i}") for i in range(1, k + 1)],
        *[F.max(F.when(F.col("rank") == i, F.col("b_key"))).alias(f"nn{i}") for i in range(1, k + 1)],
    )


# --------------------------------------------------------------------------- metrics

def nn_distance(r: DataFrame, s: DataFrame, cols: Sequence[str], r_key: str, s_key: str,
                eps: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Per synthetic row the distance to the nearest real row after
    z-scoring both by the real mean / population std; and the summary
    (mean, median, p95, near-duplicate share)."""
    zs = zscore_stats(r, cols)
    sp = Space(num=cols, metric="euclidean")
    d = knn(s, s_key, r, r_key, sp, k=1, q_stats=zs, b_stats=zs).select(
        F.col("q_key").alias(s_key), F.col("dist").alias("nn_distance"))
    counts = d.groupBy("nn_distance").agg(F.count("*").alias("n")).where("nn_distance IS NOT NULL").persist()
    n, near = F.sum("n"), F.sum(F.when(F.col("nn_distance") < eps, F.col("n")).otherwise(0))
    means = counts.agg(F.try_divide(F.sum(F.col("nn_distance") * F.col("n")), n).alias("nn_distance_mean"),
                       F.try_divide(near, n).alias("nn_near_duplicate_rate"))
    return d, _one_row(_quantiles(counts, "nn_distance", {"nn_distance_median": 0.5, "nn_distance_p95": 0.95}), means)


def _quantiles(counts: DataFrame, value: str, names: dict[str, float]) -> DataFrame:
    """One row of exact quantiles of ``value``, occurring ``n`` times each, by prefix sums over its buckets."""
    found = cdf.quantiles(cdf.prefix_sums(counts.withColumn("_one", F.lit(1)), ["_one"], value, ["n"]), list(names.values()),
                          sides=("n",), keys=("_one",), order=value)
    return found.agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(name) for name, p in names.items()])


def _one_row(*parts: DataFrame) -> DataFrame:
    """The columns of frames of one row each, side by side."""
    out = parts[0].withColumn("_k", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def dcr(s: DataFrame, s_key: str, r: DataFrame, r_key: str, h: DataFrame, h_key: str,
        num: Sequence[str], cat: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Per synthetic row L1 distance (numerics / real range, one-hot categories)
    to the closest train row and to the closest holdout row; score = share strictly
    closer to train."""
    row = r.agg(*[(F.max(c) - F.min(c)).alias(c) for c in num]).first()
    rng = {c: (row[c] or 1.0) for c in num}
    sp = Space(num=num, cat=cat, metric="l1", scale=rng)
    known = r.select(*cat).unionByName(h.select(*cat))
    size = size_of(s, sp)
    dr = knn(s, s_key, r, r_key, sp, 1, known=known, q_size=size).select(F.col("q_key").alias(s_key), F.col("dist").alias("dcr_real"))
    dh = knn(s, s_key, h, h_key, sp, 1, known=known, q_size=size).select(F.col("q_key").alias(s_key), F.col("dist").alias("dcr_test"))
    rows = dr.join(dh, s_key)
    score = rows.agg(F.avg((F.col("dcr_real") < F.col("dcr_test")).cast("double")).alias("dcr_score"))
    return rows, score


def dcr_percentiles(r: DataFrame, s: DataFrame, cols: Sequence[str], r_key: str, s_key: str,
                    pct: float = 100.0, seed: int = 42, q: float = 0.05) -> DataFrame:
    """5th percentiles of nearest distance and of nearest/second-nearest ratio
    for real->synthetic, real->real (self excluded), synthetic->synthetic.

    Each table is de-duplicated (every copy dropped), optionally sampled
    (``pct`` < 100, hash of the key) and z-scored with its own statistics.
    0/0 ratios are null and skipped (the reference yields NaN).
    """
    from fidspark.operators.prep import sample_pct

    def prep(df, key):
        d = df.groupBy(*cols).agg(F.count("*").alias("_n"), F.min(key).alias(key)).where("_n = 1").drop("_n")
        return sample_pct(d, pct, key, seed) if pct < 100 else d

    rr_, ss_ = prep(r, r_key), prep(s, s_key)
    zr, zf = zscore_stats(rr_, cols), zscore_stats(ss_, cols)
    sp = Space(num=cols, metric="euclidean")
    nr, nf = size_of(rr_, sp), size_of(ss_, sp)
    held: list[DataFrame] = []

    def summarise(long: DataFrame, tag: str) -> DataFrame:
        w = long.groupBy("q_key").agg(F.max(F.when(F.col("rank") == 1, F.col("dist"))).alias("d1"),
                                      F.max(F.when(F.col("rank") == 2, F.col("dist"))).alias("d2"))
        w = w.select("d1", F.try_divide("d1", "d2").alias("ratio")).persist()
        held.append(w)
        return _one_row(*(_quantiles(w.groupBy(c).agg(F.count("*").alias("n")), c, {f"{name}_{tag}": q})
                          for c, name in (("d1", "dcr"), ("ratio", "nndr"))))

    rf = summarise(knn(rr_, r_key, ss_, s_key, sp, 2, q_stats=zr, b_stats=zf, q_size=nr, b_size=nf), "real_fake")
    rr = summarise(knn(rr_, r_key, rr_, r_key, sp, 2, exclude_self=True, q_stats=zr, b_stats=zr, q_size=nr, b_size=nr), "real_real")
    ff = summarise(knn(ss_, s_key, ss_, s_key, sp, 2, exclude_self=True, q_stats=zf, b_stats=zf, q_size=nf, b_size=nf), "fake_fake")
    out = one_row(_one_row(rf, rr, ff).select(
        "dcr_real_fake", "dcr_real_real", "dcr_fake_fake", "nndr_real_fake", "nndr_real_real", "nndr_fake_fake"))
    for w in held:
        w.unpersist()
    return out


def prdc(r: DataFrame, s: DataFrame, cols: Sequence[str], r_key: str, s_key: str, k: int = 5) -> DataFrame:
    """K-NN precision / recall / density / coverage (strict '<' as in the published code)."""
    sp = Space(num=cols, metric="euclidean")
    one = {c: (0.0, 1.0) for c in cols}
    nr, ns = size_of(r, sp), size_of(s, sp)
    rad_r = knn(r, r_key, r, r_key, sp, k, exclude_self=True, q_stats=one, b_stats=one, q_size=nr, b_size=nr).where(
        F.col("rank") == k).select(F.col("q_key").alias("key"), F.col("dist").alias("radius"))
    rad_s = knn(s, s_key, s, s_key, sp, k, exclude_self=True, q_stats=one, b_stats=one, q_size=ns, b_size=ns).where(
        F.col("rank") == k).select(F.col("q_key").alias("key"), F.col("dist").alias("radius"))
    if _is_dense(sp):
        return _mutual_balls(r, r_key, nr, rad_r, s, s_key, ns, rad_s, sp, k)
    # precision / density: for each synthetic row, real balls containing it
    in_real = knn(s, s_key, r, r_key, sp, mode="ball", radius=rad_r, q_stats=one, b_stats=one, q_size=ns, b_size=nr)
    prec = in_real.agg(F.avg((F.col("dist") > 0).cast("double")).alias("precision"),
                       (F.avg("dist") / k).alias("density")).withColumn("_k", F.lit(1))
    # recall: for each real row, synthetic balls containing it
    in_syn = knn(r, r_key, s, s_key, sp, mode="ball", radius=rad_s, q_stats=one, b_stats=one, q_size=nr, b_size=ns)
    rec = in_syn.agg(F.avg((F.col("dist") > 0).cast("double")).alias("recall")).withColumn("_k", F.lit(1))
    # coverage: real rows whose nearest synthetic row is inside the real ball
    nn_rs = knn(r, r_key, s, s_key, sp, 1, q_stats=one, b_stats=one, q_size=nr, b_size=ns).select(F.col("q_key").alias("key"), "dist")
    cov = nn_rs.join(rad_r, "key").agg(
        F.avg((F.col("dist") < F.col("radius")).cast("double")).alias("coverage")).withColumn("_k", F.lit(1))
    return prec.join(rec, "_k").join(cov, "_k").select("precision", "recall", "density", "coverage")


def _mutual_balls(r: DataFrame, r_key: str, nr: tuple[int, int], rad_r: DataFrame, s: DataFrame, s_key: str, ns: tuple[int, int], rad_s: DataFrame,
                  space: Space, k: int) -> DataFrame:
    """What :func:`prdc` counts, from one look at each pair of a real and a synthetic row instead of three."""
    sides = [_project(df, key, space, None).join(rad.select(F.col("key").alias("_key"), F.col("radius").alias("_rad")), "_key", "left")
             for df, key, rad in ((r, r_key, rad_r), (s, s_key, rad_s))]
    found = _grid(sides[0], nr[0], sides[1], ns[0], _per_block(space, BLOCK_BYTES), True).applyInPandas(_mutual_kernel(space), MUTUAL_SCHEMA)
    rows = found.groupBy("side", "key").agg(F.sum("balls").alias("balls"), F.min("nearest").alias("nearest"), F.max("radius").alias("radius"))
    real, syn = F.col("side") == 0, F.col("side") == 1
    full = real & F.col("nearest").isNotNull() & ~F.isnan("nearest") & F.col("radius").isNotNull() & ~F.isnan("radius")
    return rows.agg(F.avg(F.when(syn, (F.col("balls") > 0).cast("double"))).alias("precision"),
                    F.avg(F.when(real, (F.col("balls") > 0).cast("double"))).alias("recall"),
                    (F.avg(F.when(syn, F.col("balls"))) / k).alias("density"),
                    F.avg(F.when(full, (F.col("nearest") < F.col("radius")).cast("double"))).alias("coverage"))


def alpha_beta(r: DataFrame, s: DataFrame, cols: Sequence[str], r_key: str, s_key: str, levels: int = 30) -> DataFrame:
    """One row (delta_precision_alpha, delta_coverage_beta), 1 being best.

    Level a's ball around the real mean holds a share a of the real rows;
    alpha-precision is the share of synthetic rows in it. Beta-coverage is the
    share of real rows that have a synthetic row at most as far as the nearest
    other real row, that synthetic row lying in the level's ball around the
    synthetic mean (by quantiles over those nearest rows). The deltas are 1
    minus the sum of distances to the diagonal over the sum of the levels.
    """
    alphas = [i / (levels - 1) for i in range(levels)]
    means = [df.agg(*[F.avg(c).alias(c) for c in cols]).first() for df in (r, s)]

    def off(row) -> Column:  # distance to a mean
        return F.sqrt(sum((F.pow(F.col(c).cast("double") - F.lit(row[c]), 2) for c in cols), F.lit(0.0)))

    def radii(df: DataFrame, value: str) -> list[float]:
        names = {f"q{i}": a for i, a in enumerate(alphas)}
        row = _quantiles(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")), value, names).first()
        return [row[n] for n in names]

    one = {c: (0.0, 1.0) for c in cols}
    sp = Space(num=cols, metric="euclidean")
    balls = radii(r.select(off(means[0]).alias("d")), "d")
    own = knn(r, r_key, r, r_key, sp, 1, exclude_self=True, q_stats=one, b_stats=one).select("q_key", F.col("dist").alias("d_real"))
    syn = knn(r, r_key, s, s_key, sp, 1, q_stats=one, b_stats=one).select("q_key", "b_key", F.col("dist").alias("d_syn"))
    there = s.select(F.col(s_key).cast("long").alias("b_key"), off(means[1]).alias("d_centre"))
    near = syn.join(own, "q_key").join(there, "b_key").select(
        "d_centre", (F.col("d_syn") <= F.col("d_real")).alias("covered")).persist()
    shells = radii(near, "d_centre")
    precise = s.select(off(means[0]).alias("d")).agg(*[F.avg((F.col("d") <= F.lit(x)).cast("double")).alias(f"p{i}")
                                                       for i, x in enumerate(balls)]).first()
    covered = near.agg(*[F.avg((F.col("covered") & (F.col("d_centre") <= F.lit(x))).cast("double")).alias(f"p{i}")
                         for i, x in enumerate(shells)]).first()
    near.unpersist()
    deltas = [1 - sum(abs(a - curve[f"p{i}"]) for i, a in enumerate(alphas)) / sum(alphas) if curve["p0"] is not None else None
              for curve in (precise, covered)]
    return r.sparkSession.createDataFrame([tuple(deltas)], "delta_precision_alpha double, delta_coverage_beta double")

"""Exact tests of candidate pairs of geometries, on flat coordinate arrays of a whole Arrow batch at once.

A geometry is array<array<struct<x, y>>>: lines, or all rings of one or more polygons, holes included. The arrays of a batch
are used as they lie in Arrow's buffers: coordinates one after another, with offsets of parts and geometries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pairs of edges that are looked at together.
AT_ONCE = 1 << 20


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] of them, then those of the next."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


class Flat:
    """The edges of a batch of geometries; of a geometry they stand together, and so do the first points of its parts."""

    def __init__(self, x: np.ndarray, y: np.ndarray, part_first: np.ndarray, part_size: np.ndarray, part_of: np.ndarray, n: int, areal: bool):
        some = part_size > 0
        first, size, of = part_first[some], part_size[some], part_of[some]
        self.n = n
        self.px, self.py = x[first], y[first]
        self.point_count = np.bincount(of, minlength=n)
        self.point_first = np.cumsum(self.point_count) - self.point_count
        # a lone point is an edge of no length; a ring goes back to its start
        edges = np.where(size == 1, 1, size if areal else size - 1)
        a = _spread(first, edges)
        last = np.repeat(first + size - 1, edges)
        b = np.where(a < last, a + 1, np.repeat(first, edges))
        self.ax, self.ay, self.bx, self.by = x[a], y[a], x[b], y[b]
        self.count = np.bincount(of, weights=edges, minlength=n).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count

    @staticmethod
    def of(column: pa.Array, areal: bool) -> Flat:
        """Of a column array<array<struct<x, y>>>; null geometries and parts have no edges, null numbers are NaN."""
        n = len(column)
        offsets, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
        n_parts = np.where(valid, np.diff(offsets), 0)
        parts = column.values
        point_at = parts.offsets.to_numpy().astype(np.int64)
        size = np.where(parts.is_valid().to_numpy(zero_copy_only=False), np.diff(point_at), 0)
        use = _spread(offsets[:-1].astype(np.int64), n_parts)
        points = parts.values
        x, y = (points.field(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in ("x", "y"))
        return Flat(x, y, point_at[:-1][use], size[use], np.repeat(np.arange(n), n_parts), n, areal)

    @staticmethod
    def boxes(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> Flat:
        """Rings of boxes, one a geometry."""
        n = len(x0)
        x, y = np.stack([x0, x0, x1, x1], 1).ravel().astype(np.float64), np.stack([y0, y1, y1, y0], 1).ravel().astype(np.float64)
        return Flat(x, y, np.arange(n) * 4, np.full(n, 4), np.arange(n), n, True)

    def bounds(self) -> tuple[np.ndarray, ...]:
        """Least and greatest x and y of each geometry; without edges a box that meets nothing."""
        out = []
        some = np.flatnonzero(self.count)
        for f, empty, p, q in ((np.fmin, np.inf, self.ax, self.bx), (np.fmin, np.inf, self.ay, self.by), (np.fmax, -np.inf, self.ax, self.bx), (np.fmax, -np.inf, self.ay, self.by)):
            v = np.full(self.n, empty)
            if len(some):
                v[some] = f.reduceat(f(p, q), self.first[some])
            out.append(v)
        return tuple(out)

    def near(self, box: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edges, first, count): of each geometry the edges whose box meets its row of ``box``."""
        row = np.repeat(np.arange(self.n), self.count)
        x0, y0, x1, y1 = (v[row] for v in box)
        keep = (np.maximum(self.ax, self.bx) >= x0) & (np.minimum(self.ax, self.bx) <= x1) & (np.maximum(self.ay, self.by) >= y0) & (np.minimum(self.ay, self.by) <= y1)
        count = np.bincount(row[keep], minlength=self.n)
        return np.flatnonzero(keep), np.cumsum(count) - count, count


def _side(ax, ay, bx, by, x, y):
    return (bx - ax) * (y - ay) - (by - ay) * (x - ax)


def _chunks(work: np.ndarray):
    """Slices of units whose work adds up to AT_ONCE or little more."""
    ends = np.cumsum(work)
    at = 0
    while at < len(work):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield slice(at, stop)
        at = stop


def touching(a: Flat, b: Flat) -> np.ndarray:
    """Rows where an edge of a and an edge of b share a point: their boxes meet and neither lies on one side of the other's line."""
    hit = np.zeros(a.n, dtype=bool)
    one, _, n_one = a.near(b.bounds())
    two, first, n_two = b.near(a.bounds())
    row = np.repeat(np.arange(a.n), n_one)
    work = n_two[row]
    one, row, work = one[work > 0], row[work > 0], work[work > 0]
    for part in _chunks(work):
        r, e = row[part], one[part]
        open_ = ~hit[r]
        r, e = r[open_], e[open_]
        count = n_two[r]
        g = two[_spread(first[r], count)]
        r, e = np.repeat(r, count), np.repeat(e, count)
        eax, eay, ebx, eby = a.ax[e], a.ay[e], a.bx[e], a.by[e]
        gax, gay, gbx, gby = b.ax[g], b.ay[g], b.bx[g], b.by[g]
        met = ~((np.maximum(eax, ebx) < np.minimum(gax, gbx)) | (np.maximum(gax, gbx) < np.minimum(eax, ebx)) | (np.maximum(eay, eby) < np.minimum(gay, gby)) | (np.maximum(gay, gby) < np.minimum(eay, eby)))
        met &= _side(eax, eay, ebx, eby, gax, gay) * _side(eax, eay, ebx, eby, gbx, gby) <= 0
        met &= _side(gax, gay, gbx, gby, eax, eay) * _side(gax, gay, gbx, gby, ebx, eby) <= 0
        hit[r[met]] = True
    return hit


def starts_inside(a: Flat, b: Flat, rows: np.ndarray) -> np.ndarray:
    """Of the given rows, those where a part of a starts inside the area of b: even-odd over all of b's rings at once."""
    hit = np.zeros(a.n, dtype=bool)
    row = np.repeat(rows, a.point_count[rows])
    point = _spread(a.point_first[rows], a.point_count[rows])
    work = b.count[row]
    row, point, work = row[work > 0], point[work > 0], work[work > 0]
    for part in _chunks(work):
        r, p, count = row[part], point[part], work[part]
        g, unit = _spread(b.first[r], count), np.repeat(np.arange(len(r)), count)
        x, y = a.px[p][unit], a.py[p][unit]
        ax, ay, bx, by = b.ax[g], b.ay[g], b.bx[g], b.by[g]
        over = np.flatnonzero((ay > y) != (by > y))
        ax, ay, bx, by, x, y = (v[over] for v in (ax, ay, bx, by, x, y))
        cut = x < (bx - ax) * ((y - ay) / (by - ay)) + ax
        odd = np.bincount(unit[over[cut]], minlength=len(r)) % 2 == 1
        hit[r[odd]] = True
    return hit


def intersecting(a: Flat, b: Flat, a_areal: bool, b_areal: bool) -> np.ndarray:
    """Rows whose two geometries share a point: two edges touch, or a part of one starts inside the other's area."""
    hit = touching(a, b)
    if b_areal:
        hit |= starts_inside(a, b, np.flatnonzero(~hit))
    if a_areal:
        hit |= starts_inside(b, a, np.flatnonzero(~hit))
    return hit


def keep_intersecting(pairs: DataFrame, a: str, b: str, a_areal: bool, b_areal: bool, drop: bool = True) -> DataFrame:
    """The rows whose geometries in columns ``a`` and ``b`` share a point, without those two columns unless ``drop`` is off."""
    source = pairs.select(*[f"`{c}`" for c in pairs.columns if c not in (a, b)], a, b)
    kept = len(source.columns) - 2 * drop

    def run(batches):
        for batch in batches:
            n = batch.num_columns
            met = intersecting(Flat.of(batch.column(n - 2), a_areal), Flat.of(batch.column(n - 1), b_areal), a_areal, b_areal)
            yield batch.select(list(range(kept))).take(pa.array(np.flatnonzero(met)))

    return source.mapInArrow(run, T.StructType(source.schema.fields[:kept]))


def keep_on_tiles(hits: DataFrame, geom: str, size: float, areal: bool) -> DataFrame:
    """The rows whose geometry shares a point with its regular tile (columns tx, ty), borders included."""

    def run(batches):
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)).to_numpy() * float(size) for c in ("tx", "ty"))
            g = Flat.of(batch.column(batch.schema.get_field_index(geom)), areal)
            met = intersecting(g, Flat.boxes(x, y, x + size, y + size), areal, True)
            yield batch.take(pa.array(np.flatnonzero(met)))

    return hits.mapInArrow(run, hits.schema)

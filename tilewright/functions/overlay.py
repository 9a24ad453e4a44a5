"""Polygon overlay: difference, intersection and union of areas with holes and several parts, by the arrangement of their edges.

All edges are cut where they meet, equal pieces become one, and each piece is asked which of the areas lie on either side of it. Pieces
with the result on one side only are its border; they are walked to rings. Shared edges, corners on edges, and areas that touch
themselves need no special case. Plain numpy on one pair of geometries; Spark deals out the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tilewright.functions.geometry import bounds
from tilewright.functions.spatial import box_pairs, distinct_shapes
from tilewright.plans.staging import stage

Ring = np.ndarray
OPS = {"difference": lambda s, c: s & ~c, "intersection": lambda s, c: s & c, "union": lambda s, c: s | c}
#: Coordinates are rounded to this share of the extent, so that cuts of the same place are one point.
SNAP = 2.0**-40
#: And at least to this share of the greatest coordinate, a few times what doubles resolve.
ROUNDED = 2.0**-50
#: Times that edges are cut; then what is left is within roundings.
ROUNDS = 12
AT_ONCE = 1 << 20
#: Areas and covers a task.
TASK_SHAPES = 2000
#: Covers of one area that a task puts in order.
PART = 4096


def overlay(subject: list[Ring], clips: list[list[Ring]], op: str) -> list[list[Ring]]:
    """Polygons of the result, each its outer ring (counter-clockwise, y upwards) and then its holes (clockwise).

    ``subject`` is an area as rings, even-odd; ``clips`` are areas of which any counts. Rings are arrays [n, 2] without the closing point;
    those of fewer than three points are left out. An area without extent gives no polygon.
    """
    areas = [subject, *clips]
    edges, owner = [], []
    for k, rings in enumerate(areas):
        for r in rings:
            if len(r) >= 3:
                edges.append(np.concatenate([r, np.roll(r, -1, axis=0)], axis=1))
                owner.append(np.full(len(r), k))
    if not edges:
        return []
    e, own = np.concatenate(edges).astype(np.float64), np.concatenate(owner)
    low = e.reshape(-1, 2).min(axis=0)
    points = e.reshape(-1, 2)
    unit = max(float((points.max(axis=0) - low).max()) * SNAP, float(np.abs(points).max()) * ROUNDED, np.finfo(float).tiny)
    # whole numbers of units from here on: equal places are equal numbers
    e = np.round((e - np.tile(low, 2)) / unit)
    odd = np.zeros((len(e), len(areas)), dtype=bool)
    odd[np.arange(len(e)), own] = True
    distinct, odd = _merged(e, odd)
    # a cut is rounded and so bends an edge a little, which then may meet another one
    for _ in range(ROUNDS):
        before = len(distinct)
        if not before:
            return []
        cut, of = _cut(distinct)
        distinct, odd = _merged(cut, odd[of])
        if len(cut) == before:
            break
    if not len(distinct):
        return []
    right = _beyond(distinct, odd)
    left = right ^ odd
    inside = lambda s: OPS[op](s[:, 0], s[:, 1:].any(axis=1))
    on_left, on_right = inside(left), inside(right)
    border = on_left != on_right
    line, turn = distinct[border], on_right[border]
    line[turn] = line[turn][:, [2, 3, 0, 1]]
    return [[p * unit + low for p in rings] for rings in _polygons(_rings(line))]


def _merged(e: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal edges as one, the lower end first, with the areas that have it an odd number of times; without points and edges of no area."""
    swap = (e[:, 0] > e[:, 2]) | ((e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3]))
    e = np.where(swap[:, None], e[:, [2, 3, 0, 1]], e)
    distinct, at = np.unique(e, axis=0, return_inverse=True)
    count = np.zeros((len(distinct), odd.shape[1]), dtype=np.int64)
    np.add.at(count, at.ravel(), odd)
    odd = count % 2 == 1
    keep = odd.any(axis=1) & (distinct[:, :2] != distinct[:, 2:]).any(axis=1)
    return distinct[keep], odd[keep]


def _cut(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges cut at every point that another edge shares with them, and the number of each piece's edge."""
    box = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    n = len(e)
    at, share, place = [np.arange(n), np.arange(n)], [np.zeros(n), np.ones(n)], [e[:, :2], e[:, 2:]]
    step = max(1, AT_ONCE // n)
    d = e[:, 2:] - e[:, :2]
    size = np.maximum((d * d).sum(axis=1), 1.0)
    for start in range(0, n, step):
        i = np.arange(start, min(n, start + step))
        near = ((box[0][i, None] <= box[1][None] + 1) & (box[0][None] <= box[1][i, None] + 1)).all(axis=2)
        a, b = np.nonzero(near)
        a = a + start
        a, b = a[a != b], b[a != b]
        # ends of the other edge that lie on this one, within a unit's roundings
        for end in (e[b, :2], e[b, 2:]):
            v = end - e[a, :2]
            t = (v * d[a]).sum(axis=1) / size[a]
            off = np.abs(v - t[:, None] * d[a]).max(axis=1)
            on = (off <= 0.75) & (t > 0) & (t < 1)
            at.append(a[on])
            share.append(t[on])
            place.append(end[on])
        # proper crossings
        cross = d[a, 0] * d[b, 1] - d[a, 1] * d[b, 0]
        v = e[b, :2] - e[a, :2]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (v[:, 0] * d[b, 1] - v[:, 1] * d[b, 0]) / cross
            u = (v[:, 0] * d[a, 1] - v[:, 1] * d[a, 0]) / cross
        on = (cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        a, b, t, u = a[on], b[on], t[on], u[on]
        # the same point for both edges, whichever is looked at: taken along the one of lower number
        first = a < b
        p = np.where(first[:, None], e[a, :2] + t[:, None] * d[a], e[b, :2] + u[:, None] * d[b])
        at.append(a)
        share.append(t)
        place.append(np.round(p))
    at, share, place = np.concatenate(at), np.concatenate(share), np.concatenate(place)
    order = np.lexsort((share, at))
    at, place = at[order], place[order]
    same = (at[1:] == at[:-1]) & (place[1:] != place[:-1]).any(axis=1)
    return np.concatenate([place[:-1], place[1:]], axis=1)[same], at[:-1][same]


def _beyond(pieces: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Which areas lie on the right of each piece, seen from its first end: even-odd along a ray from its middle that leaves on that side, the piece itself not counted."""
    n, out = len(pieces), np.zeros_like(odd)
    mid = (pieces[:, :2] + pieces[:, 2:]) / 2
    ax, ay, bx, by = pieces.T
    rising = by != ay
    step = max(1, AT_ONCE // n)
    for start in range(0, n, step):
        i = np.arange(start, min(n, start + step))
        x, y = mid[i, 0][:, None], mid[i, 1][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            # a ray to greater x, or to smaller y for pieces along x
            along_x = ((ay > y) != (by > y)) & (ax + (bx - ax) * ((y - ay) / (by - ay)) > x)
            along_y = ((ax > x) != (bx > x)) & (ay + (by - ay) * ((x - ax) / (bx - ax)) < y)
        hit = np.where(rising[i][:, None], along_x, along_y)
        hit[np.arange(len(i)), i] = False
        out[i] = (hit.astype(np.float32) @ odd.astype(np.float32)).astype(np.int64) % 2 == 1
    # pieces go to greater x, or straight to greater y: greater x is on the right of those that rise, on the left of those that fall
    falling = by < ay
    out[falling] ^= odd[falling]
    return out


def _rings(line: np.ndarray) -> list[np.ndarray]:
    """Rings of directed pieces that have the area on their left; where several leave a point, the sharpest turn to the left is taken, so rings do not cross themselves, and each piece has one before it."""
    if not len(line):
        return []
    points, ids = np.unique(line.reshape(-1, 2), axis=0, return_inverse=True)
    ids = ids.reshape(-1, 2)
    leaving: dict[int, list[int]] = {}
    for k, a in enumerate(ids[:, 0].tolist()):
        leaving.setdefault(a, []).append(k)
    angle = np.arctan2(line[:, 3] - line[:, 1], line[:, 2] - line[:, 0])

    def after(k: int) -> int:
        # the area on the left of a piece goes on, with the clock, from where the piece came to the first one that leaves
        back = angle[k] + np.pi
        return min(leaving.get(int(ids[k, 1]), [k]), key=lambda c: (back - angle[c]) % (2 * np.pi))

    used, out = np.zeros(len(line), dtype=bool), []
    for first in range(len(line)):
        ring, k = [], first
        while not used[k]:
            used[k] = True
            ring.append(int(ids[k, 0]))
            k = after(k)
        if ring and len(p := _straight(points[ring])) >= 3:
            out.append(p)
    return out


def _straight(p: np.ndarray) -> np.ndarray:
    """A ring without the points that lie on a straight line between their neighbours, or on one another, by the rounding; started at its least point."""
    p = p[np.abs(p - np.roll(p, 1, axis=0)).max(axis=1) > 2]
    while len(p) >= 3:
        a, b = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
        flat = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) <= np.maximum(np.abs(a).max(axis=1), np.abs(b).max(axis=1)) * 2
        if not flat.any():
            return np.roll(p, -int(np.lexsort((p[:, 1], p[:, 0]))[0]), axis=0)
        # of neighbours one at a time, so that a slow bend is not lost
        first = flat & ~np.roll(flat, 1)
        if not first.any():
            break
        p = p[~first]
    return p[:0]


def signed_area(ring: Ring) -> float:
    x, y = (ring - ring[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _holds(ring: Ring, p: np.ndarray) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    over = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    a, b = a[over], b[over]
    return int((a[:, 0] + (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) > p[0]).sum()) % 2 == 1


def _polygons(rings: list[Ring]) -> list[list[Ring]]:
    """Outer rings with the holes that lie in them; a hole belongs to the smallest outer ring that holds it."""
    outer = sorted((r for r in rings if signed_area(r) > 0), key=signed_area)
    out = [[r] for r in outer]
    for r in (r for r in rings if signed_area(r) < 0):
        inner = _inner_point(r)
        for k, o in enumerate(outer):
            # an island in the hole may hold the point too, but is smaller than the hole
            if signed_area(o) > -signed_area(r) and _holds(o, inner):
                out[k].append(r)
                break
    return out


def _inner_point(ring: Ring) -> np.ndarray:
    """A point inside a ring: the middle of the first stretch inside it on a level line between two of its corners' levels."""
    levels = np.unique(ring[:, 1])
    y = (levels[:-1] + levels[1:])[int(np.argmax(np.diff(levels)))] / 2
    a, b = ring, np.roll(ring, -1, axis=0)
    over = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[over], b[over]
    xs = np.sort(a[:, 0] + (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]))
    return np.array([(xs[0] + xs[1]) / 2, y])


def area_of(polygons: list[list[Ring]]) -> float:
    return sum(abs(signed_area(r)) * (1 if k == 0 else -1) for p in polygons for k, r in enumerate(p))


# --- Spark ------------------------------------------------------------------------------------------------
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
POLYGONS = T.ArrayType(T.ArrayType(T.ArrayType(POINT)))


def _rings_of(parts) -> list[Ring]:
    return [np.array([(p["x"], p["y"]) for p in r], dtype=np.float64).reshape(-1, 2) for r in parts or [] if r]


def _said(polygons: list[list[Ring]]) -> list:
    return [[[{"x": x, "y": y} for x, y in r.tolist()] for r in p] for p in polygons]


def overlay_column(df: DataFrame, subject: str, clips: str, op: str, out: str = "polygons") -> DataFrame:
    """Add ``out``: the overlay of column ``subject`` (all rings of an area) with those of column ``clips`` (an array of areas), in Arrow batches.

    Result: an array of polygons, each its outer ring and then its holes; a null subject is empty, a null clip is none.
    """
    if op not in OPS:
        raise ValueError(f"no overlay: {op}")
    keep = [c for c in df.columns if c != out]
    source = df.select(*[f"`{c}`" for c in keep])
    schema = T.StructType([*source.schema.fields, T.StructField(out, POLYGONS)])
    s_at, c_at, kind = keep.index(subject), keep.index(clips), to_arrow_type(POLYGONS)

    def run(batches):
        for batch in batches:
            found = [_said(overlay(_rings_of(s), [_rings_of(x) for x in c or []], op)) for s, c in zip(batch.column(s_at).to_pylist(), batch.column(c_at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=schema.names)

    return source.mapInArrow(run, schema)


def _dealt(df: DataFrame, shapes: int) -> DataFrame:
    """Dealt out by the number of shapes in it, not by bytes, since small ones can be much work: some seconds of it a task."""
    return df.repartition(max(1, -(-shapes // TASK_SHAPES)))


def subtract(areas: DataFrame, covers: DataFrame, cell: float, together: int = 500) -> DataFrame:
    """(id, polygons): every area (id, parts: all its rings) without what any of the ``covers`` (id, parts) covers.

    Covers are found by boxes. Those of one area meet in groups of at most ``together``: a group becomes the piece of the area that it covers, pieces meet
    in the same way, and the last ones are subtracted, so no task holds more than ``together`` covers, however many lie on an area. An area without
    covers is rebuilt as it is, one that is wholly covered, or has no extent, has no polygon. Ids are unique and not null. Areas of equal parts are one shape,
    and so are covers: each is worked on once, and every area is given what its shape gave.
    """
    (of, areas), (_, covers) = distinct_shapes(areas), distinct_shapes(covers)
    box = lambda d: d.withColumn("_b", bounds(F.flatten("parts"))).select("id", *[F.col(f"_b.{k}").alias(k) for k in ("minx", "miny", "maxx", "maxy")])
    pairs = box_pairs(box(areas), box(covers), cell)
    met = stage(pairs.join(covers.select(F.col("id").alias("b_id"), F.col("parts").alias("cover")), "b_id").select(F.col("a_id").alias("id"), F.col("b_id").alias("no"), "cover"), "covers")
    while True:
        sizes = stage(met.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > together), "sizes")
        if sizes.isEmpty():
            break
        # covers of one area are numbered in parts of some thousands, so that no task sorts all of them
        many = met.join(sizes, "id").withColumn("_s", F.pmod(F.xxhash64("no"), F.ceil(F.col("n") / PART)))
        place = F.row_number().over(Window.partitionBy("id", "_s").orderBy("no")) - 1
        dealt = many.withColumn("_g", F.floor(place / together)).groupBy("id", "_s", "_g").agg(F.collect_list("cover").alias("clips"), F.min("no").alias("no"))
        dealt = stage(dealt.join(areas.select("id", "parts"), "id"), "groups")
        work = dealt.agg(F.sum(F.size("clips") + 1)).first()[0]
        part = overlay_column(_dealt(dealt, work), "parts", "clips", "intersection").select("id", "no", F.flatten("polygons").alias("cover"))
        met = stage(met.join(sizes, "id", "left_anti").unionByName(part.where(F.size("cover") > 0)), "covers")
    last = met.groupBy("id").agg(F.collect_list("cover").alias("clips"))
    whole = _dealt(areas.select("id", "parts").join(last, "id", "left"), areas.count() + met.count())
    found = overlay_column(whole, "parts", "clips", "difference").select(F.col("id").alias("shape"), "polygons")
    return of.select("id", "shape").join(found, "shape").select("id", "polygons")


def clip_to_tiles(features: DataFrame, size: float) -> DataFrame:
    """(id, tx, ty, polygons): what of each area (id, parts) lies in each regular tile that its box reaches; tiles it does not reach into are left out. Areas of equal parts are cut once."""
    of, features = distinct_shapes(features)
    b = bounds(F.flatten("parts"))
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(f"_b.{low}") / size), F.floor(F.col(f"_b.{high}") / size)))
    hits = features.select("id", "parts", b.alias("_b")).where("_b.minx is not null").withColumn("tx", span("minx", "maxx")).withColumn("ty", span("miny", "maxy"))
    x, y = F.col("tx") * float(size), F.col("ty") * float(size)
    at = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    tile = F.array(F.array(F.array(at(0.0, 0.0), at(float(size), 0.0), at(float(size), float(size)), at(0.0, float(size)))))
    hits = stage(hits.select("id", "parts", "tx", "ty", tile.alias("_tile")), "hits")
    found = overlay_column(_dealt(hits, hits.count() * 2), "parts", "_tile", "intersection")
    found = found.where(F.size("polygons") > 0).select(F.col("id").alias("shape"), "tx", "ty", "polygons")
    return of.select("id", "shape").join(found, "shape").select("id", "tx", "ty", "polygons")

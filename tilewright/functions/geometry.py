"""Points, lines and rings as array<struct<x, y>>: native array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Corners in the order (min, min), (min, max), (max, max), (max, min)."""
    return F.array(point(minx, miny), point(minx, maxy), point(maxx, maxy), point(maxx, miny))


def bounds(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def steps(points: Column, closed: bool = False) -> Column:
    """array<struct<a, b>> of the edges; a closed ring gets the one back to its start."""
    ends = F.concat(F.slice(points, F.lit(2), F.greatest(F.lit(0), F.size(points) - 1)), F.slice(points, 1, 1) if closed else F.array().cast("array<struct<x:double,y:double>>"))
    starts = points if closed else F.slice(points, F.lit(1), F.greatest(F.lit(0), F.size(points) - 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, e: s + f(e))


def length(points: Column) -> Column:
    return _total(steps(points), lambda e: F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], 2) + F.pow(e["b"]["y"] - e["a"]["y"], 2)))


def area(ring: Column) -> Column:
    """Shoelace area; null for fewer than three points."""
    twice = _total(steps(ring, True), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.when(F.size(ring) >= 3, F.abs(twice) / 2)


def valid_ring(ring: Column) -> Column:
    """At least three corners, an area, and no two edges that cross."""
    edges = steps(ring, True)
    crossing = F.exists(edges, lambda e: F.exists(edges, lambda g: crosses(e, g)))
    return F.coalesce((F.size(ring) >= 3) & (area(ring) > 0) & ~crossing, F.lit(False))


def _side(a: Column, b: Column, p: Column) -> Column:
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def crosses(e: Column, g: Column) -> Column:
    """Whether two segments cross in one inner point."""
    return (_side(e["a"], e["b"], g["a"]) * _side(e["a"], e["b"], g["b"]) < 0) & (_side(g["a"], g["b"], e["a"]) * _side(g["a"], g["b"], e["b"]) < 0)


def meeting_points(e: Column, g: Column) -> Column:
    """The points two segments share, ends included: one, the ends of the stretch where they lie on one another, or none."""
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    ex, ey = g["b"]["x"] - g["a"]["x"], g["b"]["y"] - g["a"]["y"]
    d = dx * ey - dy * ex
    t = F.try_divide((g["a"]["x"] - e["a"]["x"]) * ey - (g["a"]["y"] - e["a"]["y"]) * ex, d)
    u = F.try_divide((g["a"]["x"] - e["a"]["x"]) * dy - (g["a"]["y"] - e["a"]["y"]) * dx, d)
    none = F.array().cast("array<struct<x:double,y:double>>")
    along = F.array_distinct(F.filter(F.array(e["a"], e["b"], g["a"], g["b"]), lambda p: on_segment(e, p) & on_segment(g, p)))
    one = F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.array(point(e["a"]["x"] + t * dx, e["a"]["y"] + t * dy))).otherwise(none)
    return F.when(d == 0, along).otherwise(one)


def on_segment(e: Column, p: Column) -> Column:
    """Whether a point lies on a segment, ends included."""
    within = p["x"].between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & p["y"].between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"]))
    return within & (_side(e["a"], e["b"], p) == 0)


def touches(e: Column, g: Column) -> Column:
    """Whether two segments share a point: their boxes meet and neither lies on one side of the other's line. A segment may be a point."""

    def apart(k: str) -> Column:
        return (F.greatest(e["a"][k], e["b"][k]) < F.least(g["a"][k], g["b"][k])) | (F.greatest(g["a"][k], g["b"][k]) < F.least(e["a"][k], e["b"][k]))

    def straddles(e: Column, g: Column) -> Column:
        return _side(e["a"], e["b"], g["a"]) * _side(e["a"], e["b"], g["b"]) <= 0

    return ~apart("x") & ~apart("y") & straddles(e, g) & straddles(g, e)


def part_steps(parts: Column, areal: bool) -> Column:
    """The edges of all parts; a lone point counts as an edge of no length."""
    one = lambda p: F.when(F.size(p) == 1, F.array(F.struct(p[0].alias("a"), p[0].alias("b")))).otherwise(steps(p, areal))
    return F.flatten(F.transform(parts, one))


def holds(edges: Column, p: Column) -> Column:
    """Even-odd test of a point against all rings of an area at once, so that holes and several polygons count."""
    cut = F.filter(edges, lambda e: ((e["a"]["y"] > p["y"]) != (e["b"]["y"] > p["y"])) & (p["x"] < (e["b"]["x"] - e["a"]["x"]) * F.try_divide(p["y"] - e["a"]["y"], e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return F.size(cut) % 2 == 1


def intersects(a: Column, b: Column, a_areal: bool, b_areal: bool) -> Column:
    """Whether two geometries share a point, each an array of parts: lines, or all rings of one or more polygons, holes included.

    They do when two edges touch, or when a part of one starts inside the other's area. False if one is null or has no part.
    """

    def test(g: Column) -> Column:
        edges = F.exists(g["ea"], lambda e: F.exists(g["eb"], lambda o: touches(e, o)))
        if b_areal:
            edges = edges | F.exists(g["a"], lambda p: holds(g["eb"], F.get(p, F.lit(0))))
        if a_areal:
            edges = edges | F.exists(g["b"], lambda p: holds(g["ea"], F.get(p, F.lit(0))))
        return edges

    # a lambda's variable is computed once, a repeated expression each time
    bound = F.struct(a.alias("a"), b.alias("b"), part_steps(a, a_areal).alias("ea"), part_steps(b, b_areal).alias("eb"))
    return F.coalesce(F.get(F.transform(F.array(bound), test), F.lit(0)), F.lit(False))


def polygon_area(polygons: Column) -> Column:
    """Area of an array of polygons, each its outer ring and then its holes."""
    one = lambda rings: F.aggregate(F.slice(rings, 2, 1_000_000), F.coalesce(area(F.get(rings, F.lit(0))), F.lit(0.0)), lambda s, r: s - F.coalesce(area(r), F.lit(0.0)))
    return F.aggregate(polygons, F.lit(0.0), lambda s, p: s + one(p))


def inside(ring: Column, p: Column) -> Column:
    """Even-odd test of a point."""
    hits = F.filter(steps(ring, True), lambda e: ((e["a"]["y"] > p["y"]) != (e["b"]["y"] > p["y"])) & (p["x"] < (e["b"]["x"] - e["a"]["x"]) * F.try_divide(p["y"] - e["a"]["y"], e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return F.size(hits) % 2 == 1


def distance_to_ring(ring: Column, p: Column) -> Column:
    """Distance of a point from the nearest edge of a ring."""

    def to_edge(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        t = F.coalesce(F.try_divide((p["x"] - e["a"]["x"]) * dx + (p["y"] - e["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.sqrt(F.pow(p["x"] - e["a"]["x"] - t * dx, 2) + F.pow(p["y"] - e["a"]["y"] - t * dy, 2))

    return F.array_min(F.transform(steps(ring, True), to_edge))


def boxes_meet(a: str, b: str) -> Column:
    """Whether two boxes with the given column prefixes share a point."""
    c = F.col
    return (c(f"{a}minx") <= c(f"{b}maxx")) & (c(f"{b}minx") <= c(f"{a}maxx")) & (c(f"{a}miny") <= c(f"{b}maxy")) & (c(f"{b}miny") <= c(f"{a}maxy"))


def wkt_box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """POLYGON text of a closed box with integer corners."""
    s = [v.cast("long").cast("string") for v in (minx, miny, maxx, maxy)]
    pairs = [(0, 1), (0, 3), (2, 3), (2, 1), (0, 1)]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", s[a], s[b]) for a, b in pairs]), F.lit("))"))


def angle(before: Column, at: Column, after: Column) -> Column:
    """Degrees at the middle one of three points; null where two of them coincide."""
    ax, ay = before["x"] - at["x"], before["y"] - at["y"]
    bx, by = after["x"] - at["x"], after["y"] - at["y"]
    cos = F.try_divide(ax * bx + ay * by, F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def extrapolate(a: Column, b: Column, factor: float = 1.5) -> Column:
    """The point on the ray from a through b, ``factor`` times as far."""
    return point(a["x"] + factor * (b["x"] - a["x"]), a["y"] + factor * (b["y"] - a["y"]))


def along(a: Column, b: Column, share: float) -> Column:
    return point(a["x"] + share * (b["x"] - a["x"]), a["y"] + share * (b["y"] - a["y"]))


def to_world(affine: tuple, col: Column, row: Column) -> Column:
    a, b, c, d, e, f = affine
    return point(a * col + b * row + c, d * col + e * row + f)


def to_pixel(affine: tuple, x: Column, y: Column) -> Column:
    """Whole pixels, cut towards zero, under the inverse transform."""
    a, b, c, d, e, f = affine
    det = a * e - b * d
    col = (e * (x - c) - b * (y - f)) / det
    row = (a * (y - f) - d * (x - c)) / det
    return F.struct(col.cast("int").alias("col"), row.cast("int").alias("row"))


def ring_to_pixels(affine: tuple, ring: Column) -> Column:
    """A ring of world points in pixels (x: column, y: row), not cut to whole ones."""
    a, b, c, d, e, f = affine
    det = a * e - b * d
    return F.transform(ring, lambda p: point((e * (p["x"] - c) - b * (p["y"] - f)) / det, (a * (p["y"] - f) - d * (p["x"] - c)) / det))


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> Column:
    """WGS84 degrees to metres of a UTM zone by the Krüger series (third order)."""
    radius, flat, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = flat / (2 - flat)
    big_a = radius / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = 2 * n**0.5 / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - s * F.atanh(s * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return point(500000.0 + k0 * big_a * east, (10000000.0 if south else 0.0) + k0 * big_a * north)


def spatial_join(left: DataFrame, right: DataFrame, cell: float, levels: int = 4, exact: Column | None = None, by: str | None = None) -> DataFrame:
    """Pairs whose boxes (minx, miny, maxx, maxy) share a point; columns come prefixed ``a_`` and ``b_``.

    Each box goes to the cells of a grid level chosen by its size (cell times a power of 8), so a huge box covers few of
    them. Two boxes meet at the coarser one's level: one join takes the left boxes at their own level and the right ones at
    theirs and every coarser one, the other join the right boxes at their own and the left ones at coarser levels, so
    two small boxes never meet in a large cell. A pair counts only in the cell that holds the corner of its overlap, so no
    distinct is needed. Boxes with a null bound meet nothing. ``exact`` is a further test on the prefixed columns, such as ``intersects``;
    ``by`` names a column that must be equal on both sides, such as an image.
    """
    width = F.lit(float(cell)) * F.pow(F.lit(8.0), F.col("level"))

    def prefixed(df: DataFrame, p: str) -> DataFrame:
        df = df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])
        size = F.greatest(F.col(f"{p}maxx") - F.col(f"{p}minx"), F.col(f"{p}maxy") - F.col(f"{p}miny"))
        level = F.lit(levels - 1)
        for k in range(levels - 2, -1, -1):
            level = F.when(size <= cell * 8**k, k).otherwise(level)
        return df.withColumn(f"{p}level", level)

    def listed(df: DataFrame, p: str, first: int, last: int | None) -> DataFrame:
        own = F.col(f"{p}level")
        at = F.filter(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: (k >= own + first) & (F.lit(True) if last is None else k <= own + last))

        def span(low: str, high: str) -> Column:
            return F.explode(F.sequence(F.floor(F.col(p + low) / width), F.floor(F.col(p + high) / width)))

        return df.withColumn("level", F.explode(at)).withColumn("cx", span("minx", "maxx")).withColumn("cy", span("miny", "maxy"))

    a, b = prefixed(left, "a_"), prefixed(right, "b_")
    key = ["level", "cx", "cy"] + (["by"] if by else [])
    if by:
        a, b = a.withColumn("by", F.col(f"a_{by}")), b.withColumn("by", F.col(f"b_{by}"))
    both = listed(a, "a_", 0, 0).join(listed(b, "b_", 0, None), key).unionByName(listed(a, "a_", 1, None).join(listed(b, "b_", 0, 0), key))
    corner = (F.col("cx") == F.floor(F.greatest("a_minx", "b_minx") / width)) & (F.col("cy") == F.floor(F.greatest("a_miny", "b_miny") / width))
    cheap = boxes_meet("a_", "b_") & corner
    # one expression: of two filters the dearer one could come first
    pairs = both.where(cheap if exact is None else F.when(cheap, exact).otherwise(F.lit(False)))
    return pairs.drop("level", "cx", "cy", "by", "a_level", "b_level")


def convex_hull(points: str = "points") -> Column:
    """Hull of each row's points by monotone chain, in Arrow batches."""
    import pandas as pd

    def hull(column: pd.Series) -> pd.Series:
        return column.map(_hull)

    hull.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(hull, "array<struct<x:double,y:double>>")(F.col(points))


def _hull(points):
    if points is None:
        return None
    pts = sorted({(p["x"], p["y"]) for p in points})
    if len(pts) < 3:
        return [{"x": x, "y": y} for x, y in pts]

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return [{"x": x, "y": y} for x, y in half(pts) + half(pts[::-1])]


def largest_first(df: DataFrame, ring: str = "ring", image: str = "img") -> DataFrame:
    """Rank of each object in its image by area, largest 1; ties by id. Images of any number of objects: no task sorts a whole one."""
    from tilewright.plans.order import rank_within

    sized = df.withColumn("_size", area(F.col(ring)))
    return rank_within(sized, [image], [F.desc("_size"), F.col("id")]).withColumn("rank", (F.col("rank") + 1).cast("int")).drop("_size")

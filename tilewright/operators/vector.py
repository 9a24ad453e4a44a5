"""Vector features: multi-part geometries, clipping, intersections, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions.kernels import keep_intersecting, keep_on_tiles
from tilewright.functions.spatial import BOX, box_pairs, distinct_shapes, paired_features
from tilewright.plans.components import first_wins
from tilewright.plans.staging import stage


def explode_parts(df: DataFrame, parts: str = "parts") -> DataFrame:
    """One row for each part of a multi-geometry, with its number."""
    others = [c for c in df.columns if c != parts]
    return df.select(*others, F.posexplode(parts).alias("part", "geom"))


def road_lines(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with category from road_type, and the rows without geometry."""
    lines = explode_parts(df.where("parts is not null")).withColumn("category", F.col("road_type"))
    return lines, df.where("parts is null")


def combine(frames: list[DataFrame]) -> DataFrame:
    """All features of several files after exploding; mixed epsg is an error, found before anything else is read."""
    from functools import reduce

    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    low, high = both.agg(F.min("epsg"), F.max("epsg")).first()
    if low != high:
        raise ValueError(f"mixed coordinate systems: {low} and {high}")
    return explode_parts(both)


def dedupe(df: DataFrame, geom: str, id_col: str = "id") -> DataFrame:
    """One row for each distinct coordinate array, the lowest id."""
    return df.groupBy(geom).agg(F.min(id_col).alias(id_col))


def tile_hits(features: DataFrame, size: int) -> DataFrame:
    """(feature columns, tx, ty): every regular tile that a feature's bounds reach, by arithmetic."""
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))
    return features.withColumn("tx", span("minx", "maxx")).withColumn("ty", span("miny", "maxy"))


def clipped_bounds(ring: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Bounds of a ring's intersection with a box: clipped edge ends and the box corners inside the ring; null if apart."""

    def clip(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        low, high, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
        for d, a, lo, hi in ((dx, e["a"]["x"], minx, maxx), (dy, e["a"]["y"], miny, maxy)):
            t0, t1 = F.try_divide(lo - a, d), F.try_divide(hi - a, d)
            low = F.greatest(low, F.least(t0, t1))
            high = F.least(high, F.greatest(t0, t1))
            ok = ok & ((d != 0) | ((a >= lo) & (a <= hi)))
        at = lambda t: G.point(e["a"]["x"] + t * dx, e["a"]["y"] + t * dy)
        return F.when(ok & (low <= high), F.array(at(low), at(high))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

    corners = F.filter(G.box_ring(minx, miny, maxx, maxy), lambda p: G.inside(ring, p))
    points = F.concat(F.flatten(F.transform(G.steps(ring, True), clip)), corners)
    # a lambda's variable is computed once, a repeated expression each time
    return F.get(F.transform(F.array(points), lambda ps: F.when(F.size(ps) > 0, G.bounds(ps))), F.lit(0))


def _cuts(roads: DataFrame, parkings: DataFrame, cell: float) -> DataFrame:
    """(road, parking, line, ring, p, at): points where a line meets an outline, and how far along the line in edges."""
    with_box = lambda df, g: df.withColumn("_b", G.bounds(F.col(g))).select("id", *[F.col(f"_b.{k}").alias(k) for k in ("minx", "miny", "maxx", "maxy")])
    pairs = box_pairs(with_box(roads, "line"), with_box(parkings, "ring"), cell).withColumnsRenamed({"a_id": "road", "b_id": "parking"})
    pairs = pairs.join(roads.select(F.col("id").alias("road"), "line"), "road").join(parkings.select(F.col("id").alias("parking"), "ring"), "parking")
    far = lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])

    def of_edge(e: Column, no: Column) -> Column:
        met = F.flatten(F.transform(G.steps(F.col("ring"), True), lambda g: G.meeting_points(e, g)))
        return F.transform(met, lambda p: F.struct(p.alias("p"), (no + F.coalesce(F.try_divide(far(p, e["a"]), far(e["b"], e["a"])), F.lit(0.0))).alias("at")))

    found = F.flatten(F.transform(G.steps(F.col("line")), of_edge))
    return pairs.select("*", F.explode(found).alias("c")).select("road", "parking", "line", "ring", "c.p", "c.at")


def crossing_points(roads: DataFrame, parkings: DataFrame, cell: float) -> DataFrame:
    """(road, parking, x, y): distinct points where a road's line (id, line) meets a parking's outline (id, ring)."""
    return _cuts(roads, parkings, cell).select("road", "parking", "p.x", "p.y").distinct()


def entry_points(roads: DataFrame, parkings: DataFrame, cell: float, start_buffer: float = 1e-6, end_buffer: float = 1e-5) -> DataFrame:
    """(road, parking, x, y): where a road from outside first meets a parking's outline, and where it last meets it on its way out.

    Cut at the outline, a road has pieces; both ends of an inner piece lie on the outline, so only the first and the last
    piece can have exactly one end in the parking. They do when the road's own start, or end, is neither inside nor within its buffer.
    """
    found = _cuts(roads, parkings, cell).groupBy("road", "parking").agg(F.first("line").alias("line"), F.first("ring").alias("ring"), F.min_by("p", "at").alias("low"), F.max_by("p", "at").alias("high"))
    outside = lambda p, buffer: ~G.inside(F.col("ring"), p) & (G.distance_to_ring(F.col("ring"), p) > buffer)
    first = F.when(outside(F.element_at("line", 1), start_buffer), F.col("low"))
    last = F.when(outside(F.element_at("line", -1), end_buffer), F.col("high"))
    return found.select("road", "parking", F.explode(F.array_compact(F.array(first, last))).alias("p")).select("road", "parking", "p.x", "p.y").distinct()


def normalise_features(df: DataFrame, mapping: dict, threshold: float | None = None, ring: str = "ring") -> DataFrame:
    """Detections with a valid ring, a known category and, with a threshold, enough score; the ring becomes its bounding box, the category its number."""
    from tilewright.functions.boxes import map_category

    kept = df.where(G.valid_ring(F.col(ring))).withColumn("category", map_category("category", mapping)).where("category is not null")
    kept = kept if threshold is None else kept.where(F.col("score") >= threshold)
    return kept.withColumn("_b", G.bounds(F.col(ring))).withColumn(ring, G.box_ring(*[F.col(f"_b.{k}") for k in ("minx", "miny", "maxx", "maxy")])).drop("_b")


def crowd_boxes(features: DataFrame, affine: tuple, width: Column, height: Column) -> DataFrame:
    """World bounds (minx, miny, maxx, maxy) as pixel boxes x1, y1, x2, y2 of a patch, with ``reject``: outside, flipped (or without area), or null."""
    low, high = G.to_pixel(affine, F.col("minx"), F.col("maxy")), G.to_pixel(affine, F.col("maxx"), F.col("miny"))
    d = features.withColumns({"x1": low["col"], "y1": low["row"], "x2": high["col"], "y2": high["row"]})
    outside = (F.greatest("x1", "x2") > width) | (F.greatest("y1", "y2") > height)
    return d.withColumn("reject", F.when(outside, "outside").when((F.col("x1") >= F.col("x2")) | (F.col("y1") >= F.col("y2")), "flipped"))


def task_boxes(tasks: DataFrame, classes: dict) -> DataFrame:
    """(name, category, x1, y1, x2, y2) of labelling tasks (name, tag, points): tags merged to classes, others and objects of fewer than three points dropped."""
    from tilewright.functions.boxes import map_category

    t = tasks.withColumn("category", map_category("tag", classes)).where((F.col("category").isNotNull()) & (F.size("points") >= 3))
    b = G.bounds(F.col("points"))
    return t.select("name", "category", *[b[k].cast("int").alias(n) for n, k in (("x1", "minx"), ("y1", "miny"), ("x2", "maxx"), ("y2", "maxy"))])


def with_bounds(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Add minx, miny, maxx, maxy of a geometry's parts."""
    box = G.bounds(F.flatten(parts))
    return df.withColumn("_b", box).withColumns({k: F.col(f"_b.{k}") for k in ("minx", "miny", "maxx", "maxy")}).drop("_b")


def meeting(left: DataFrame, right: DataFrame, cell: float, left_areal: bool, right_areal: bool, same: bool = False) -> DataFrame:
    """(a_id, b_id) of features (id, parts) that share a point; ``same``: left and right are one table, and only pairs with a_id < b_id are wanted.

    Features of equal parts are one shape, tested once: boxes find candidates among shapes, of which only ids are shuffled; geometries are fetched for those, and tested in Arrow
    batches. Each pair of shapes that meet then gives the pairs of their features, from lists of ids. Ids are unique; a null one meets nothing.
    """
    a_of, a_shapes = _shapes(left)
    b_of, b_shapes = (a_of, a_shapes) if same else _shapes(right)
    pairs = box_pairs(with_bounds(a_shapes), with_bounds(b_shapes), cell)
    pairs = pairs.where("a_id <= b_id") if same else pairs
    shape = lambda d, p: d.select(F.col("id").alias(f"{p}_id"), F.col("parts").alias(f"{p}_parts"))
    both = pairs.join(shape(a_shapes, "a"), "a_id").join(shape(b_shapes, "b"), "b_id")
    met = keep_intersecting(both, "a_parts", "b_parts", left_areal, right_areal).withColumnsRenamed({"a_id": "a_shape", "b_id": "b_shape"})
    return paired_features(met, a_of, b_of, same)


def _shapes(features: DataFrame, together: int = 2048) -> tuple[DataFrame, DataFrame]:
    return distinct_shapes(features, "parts", together)


def tiles_met(features: DataFrame, size: int, areal: bool) -> DataFrame:
    """(id, tx, ty): every regular tile that a feature (id, parts) shares a point with, borders included.

    Tiles come by arithmetic on its box; a box that reaches no further than one tile needs no test, the others are tested in Arrow batches.
    """
    first, last = (lambda c: F.ceil(F.col(c) / size) - 1), (lambda c: F.floor(F.col(c) / size))
    boxed = with_bounds(features).where("minx is not null and maxx is not null and miny is not null and maxy is not null")
    hits = boxed.withColumn("tx", F.explode(F.sequence(first("minx"), last("maxx")))).withColumn("ty", F.explode(F.sequence(first("miny"), last("maxy"))))
    hits = hits.withColumn("_one", (first("minx") == last("maxx")) & (first("miny") == last("maxy"))).drop("minx", "miny", "maxx", "maxy")
    tested = keep_on_tiles(hits.where("not _one"), "parts", float(size), areal)
    return hits.where("_one").unionByName(tested).drop("_one")


def suppress(shapes: DataFrame, cell: float, areal: bool | None = None) -> DataFrame:
    """Ids kept when each shape in ascending id, if still there, drops the later ones it shares a point with.

    Shapes are boxes (id, minx, miny, maxx, maxy), or, with ``areal`` given, features (id, parts), areas or lines. Equal boxes, and features of equal parts, that meet
    themselves go with the first of them: it drops the others, or what drops it drops them all. So only that one is compared with other shapes.
    """
    if areal is None:
        # a box with a null bound, or whose least bound is not the least, does not meet itself: it stands for itself alone
        alone = F.when(F.coalesce((F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy")), F.lit(False)), F.lit(None)).otherwise(F.col("id"))
        first = stage(shapes.where("id is not null").groupBy(*BOX, alone.alias("_alone")).agg(F.min("id").alias("id")).drop("_alone"), "first")
        return first_wins(first, box_pairs(first, first, cell, same=True).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst")))
    of, different = _shapes(shapes)
    itself = different.select("id", "parts", F.col("parts").alias("_q"))
    solid = stage(keep_intersecting(itself, "parts", "_q", areal, areal).select("id"), "solid")
    pairs = meeting(different, different, cell, areal, areal, same=True)
    kept = first_wins(different, pairs.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst")))
    # what does not meet even itself (without points, or with one that is no number) meets nothing, and stays
    loose = of.join(solid, F.col("shape") == solid["id"], "left_anti").select("id").distinct()
    return kept.join(solid, "id", "left_semi").unionByName(loose)


def ground_truth(boxes: DataFrame, images: DataFrame, mapping: dict, background: str = "bg") -> DataFrame:
    """Features of test annotations: a ring and category number for each box; an image without a box has the background number and no ring."""
    from tilewright.functions.boxes import map_category

    b = images.join(boxes, "img_name", "left")
    ring = F.when(F.col("x1").isNotNull(), G.box_ring(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    number = F.coalesce(map_category("category", mapping), F.lit(mapping[background]))
    return b.select("img_name", "box_id", number.alias("category_num"), ring.alias("ring"))

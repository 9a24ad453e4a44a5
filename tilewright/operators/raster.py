"""Rasters as pixel tables (img, row_no, col_no, value), rings of outlines, decoded images."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.plans.components import staged_components
from tilewright.plans.staging import drop_staged, stage

KEY = ["img", "row_no", "col_no"]


def threshold(pixels: DataFrame, value: str, t: float) -> DataFrame:
    return pixels.withColumn(value, (F.col(value) > t).cast("int"))


def ensemble(a: DataFrame, b: DataFrame, t: float) -> DataFrame:
    """Halves of two 8-bit rasters (whole numbers) added and cut at a threshold."""
    both = a.select(*KEY, F.col("v").alias("_a")).join(b.select(*KEY, F.col("v").alias("_b")), KEY)
    total = F.floor(F.col("_a") / 2) + F.floor(F.col("_b") / 2)
    return both.select(*KEY, (total > t).cast("int").alias("v"))


def votes(a: DataFrame, b: DataFrame, t: float) -> DataFrame:
    """How many of two rasters exceed the threshold: 0, 1 or 2."""
    both = a.select(*KEY, F.col("v").alias("_a")).join(b.select(*KEY, F.col("v").alias("_b")), KEY)
    return both.select(*KEY, ((F.col("_a") > t).cast("int") + (F.col("_b") > t).cast("int")).alias("v"))


def logical_or(*rasters: DataFrame) -> DataFrame:
    """1 where any raster is not 0."""
    both = rasters[0].select(*KEY, "v")
    for r in rasters[1:]:
        both = both.unionByName(r.select(*KEY, "v"))
    return both.groupBy(*KEY).agg(F.max((F.col("v") != 0).cast("int")).alias("v"))


def mirror(pixels: DataFrame, how: str, h: Column | int, w: Column | int) -> DataFrame:
    if how == "v":
        return pixels.withColumn("row_no", F.lit(h) - 1 - F.col("row_no"))
    return pixels.withColumn("col_no", F.lit(w) - 1 - F.col("col_no"))


def brightness(seed: int, most: float = 1.5, key: Column | None = None) -> Column:
    """A reproducible factor in [1, most) for each image, from a hash of ``img`` or from a whole number of one's own."""
    key = F.xxhash64(F.lit(seed), "img") if key is None else key
    return 1 + (most - 1) * F.pmod(key, F.lit(1 << 20)) / (1 << 20)


def brighten(pixels: DataFrame, value: str, seed: int, most: float = 1.5, key: Column | None = None, images: int | None = None) -> DataFrame:
    """Each image's pixels times its ``brightness``, at most 255; of all images, or of those with the ``images`` lowest keys."""
    own = F.xxhash64(F.lit(seed), "img") if key is None else key
    if images is not None:
        some = pixels.select("img", own.alias("_key")).distinct().orderBy("_key", "img").limit(images).select("img")
        pixels = pixels.join(F.broadcast(some), "img", "left_semi")
    return pixels.withColumn(value, F.least(F.lit(255), F.floor(F.col(value) * brightness(seed, most, key))).cast("int"))


def weight_raster(pixels: DataFrame, value: str, weights: dict[int, int], parity: bool = False) -> DataFrame:
    """Class to weight; parity replaces in sequence, so a result can be replaced again."""
    v = F.col(value)
    if parity:
        for k, w in weights.items():
            v = F.when(v == k, w).otherwise(v)
        return pixels.withColumn("weight", v)
    return pixels.withColumn("weight", F.coalesce(F.try_element_at(F.create_map(*[F.lit(int(x)) for kv in weights.items() for x in kv]), v.cast("int")), v.cast("int")))


def draw_outlines(objects: DataFrame, ring: str = "ring") -> DataFrame:
    """Pixels of the edges of each object's ring, one step a column or row; where objects meet the later order wins."""
    from tilewright.functions.geometry import steps

    e = objects.select("img", "class", "order", F.explode(steps(F.col(ring), True)).alias("e"))
    n = F.greatest(F.abs(F.col("e.b.x") - F.col("e.a.x")), F.abs(F.col("e.b.y") - F.col("e.a.y")), F.lit(1.0))
    t = e.withColumn("_n", n).withColumn("_t", F.explode(F.sequence(F.lit(0), F.ceil("_n").cast("int")))).withColumn("_s", F.least(F.lit(1.0), F.col("_t") / F.col("_n")))
    at = lambda k: F.round(F.col(f"e.a.{k}") + F.col("_s") * (F.col(f"e.b.{k}") - F.col(f"e.a.{k}"))).cast("long")
    return t.select("img", "class", "order", at("y").alias("row_no"), at("x").alias("col_no")).groupBy("img", "row_no", "col_no").agg(F.max_by("class", "order").alias("class"))


def _outline(points) -> tuple:
    """(rows, columns) of the pixels of a closed ring's edges, by the rule of ``draw_outlines``."""
    import numpy as np

    p = np.array([(q["x"], q["y"]) for q in points], dtype=np.float64)
    a, b = p, np.roll(p, -1, axis=0)
    n = np.maximum(np.abs(b - a).max(axis=1), 1.0)
    count = np.ceil(n).astype(int) + 1
    edge = np.repeat(np.arange(len(p)), count)
    t = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = a[edge] + np.minimum(1.0, t / n[edge])[:, None] * (b - a)[edge]
    # halves away from zero, as Spark rounds
    at = (np.sign(at) * np.floor(np.abs(at) + 0.5)).astype(np.int64)
    return at[:, 1], at[:, 0]


MASKS = "x1 double, y1 double, x2 double, y2 double, row0 long, col0 long, h long, w long, mask binary"


def instance_masks(objects: DataFrame, ring: str = "ring") -> DataFrame:
    """One row for each object: its columns but the ring, its bounds x1, y1, x2, y2, and its own mask, cut to what it draws: row0, col0, h, w and mask, h * w bytes, 1 on the outline.

    Objects are drawn in Arrow batches, one at a time; nothing is shuffled. An object without a point has nulls.
    """
    import numpy as np
    import pyarrow as pa

    keep = [c for c in objects.columns if c != ring]
    source = objects.select(*keep, ring)
    names = [f.split()[0] for f in MASKS.split(", ")]

    def draw(points):
        if not points:
            return (None,) * len(names)
        rows, cols = _outline(points)
        xs, ys = [p["x"] for p in points], [p["y"] for p in points]
        r0, c0 = int(rows.min()), int(cols.min())
        mask = np.zeros((int(rows.max()) - r0 + 1, int(cols.max()) - c0 + 1), dtype=np.uint8)
        mask[rows - r0, cols - c0] = 1
        return float(min(xs)), float(min(ys)), float(max(xs)), float(max(ys)), r0, c0, *mask.shape, mask.tobytes()

    kinds = [pa.float64()] * 4 + [pa.int64()] * 4 + [pa.binary()]

    def run(batches):
        for batch in batches:
            made = list(zip(*map(draw, batch.column(len(keep)).to_pylist()), strict=True)) if batch.num_rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, k) for c, k in zip(made, kinds, strict=True)]], names=[*keep, *names])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]], MASKS])
    return source.mapInArrow(run, schema)


def outline_blocks(objects: DataFrame, size: int = 512, salt: int = 16, ring: str = "ring") -> DataFrame:
    """The class mask of all objects' outlines as blocks (``operators.blocks``); where objects (img, id, class, order, ring) meet the later order wins, of equals the larger class.

    An object goes to the blocks that its box reaches, as its ring; a block's objects are drawn in ``salt`` groups first, so no task draws all
    objects of a crowded block, and arrays of order and class are merged. No row stands for a pixel.
    """
    import numpy as np
    import pyarrow as pa

    from tilewright.functions.geometry import bounds
    from tilewright.operators.blocks import BLOCK, NONE

    b = objects.where((F.size(ring) > 0) & F.col("class").isNotNull()).withColumn("_b", bounds(F.col(ring)))
    span = lambda low, high: F.explode(F.sequence(F.floor(F.round(f"_b.{low}") / size), F.floor(F.round(f"_b.{high}") / size)))
    dealt = b.withColumn("block_row", span("miny", "maxy")).withColumn("block_col", span("minx", "maxx"))
    dealt = dealt.select("img", "block_row", "block_col", F.pmod(F.xxhash64("id"), F.lit(salt)).alias("_salt"), F.coalesce(F.col("order").cast("long"), F.lit(NONE)).alias("order"), F.col("class").cast("int").alias("class"), ring)
    part = "img long, block_row long, block_col long, orders binary, classes binary"
    none = np.iinfo(np.int64).min

    def draw(key: tuple, table: pa.Table) -> pa.Table:
        img, i, j = (k.as_py() for k in key[:3])
        order, found = np.full((size, size), none, dtype=np.int64), np.full((size, size), NONE, dtype=np.int32)
        for r in sorted(table.to_pylist(), key=lambda r: (r["order"], r["class"])):
            rows, cols = _outline(r[ring])
            rows, cols = rows - i * size, cols - j * size
            here = (rows >= 0) & (rows < size) & (cols >= 0) & (cols < size)
            order[rows[here], cols[here]], found[rows[here], cols[here]] = r["order"], r["class"]
        return pa.table([pa.array([v]) for v in (img, i, j, order.tobytes(), found.tobytes())], names=["img", "block_row", "block_col", "orders", "classes"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        img, i, j = (k.as_py() for k in key)
        order, found = np.full((size, size), none, dtype=np.int64), np.full((size, size), NONE, dtype=np.int32)
        for r in table.to_pylist():
            o, c = np.frombuffer(r["orders"], np.int64).reshape(size, size), np.frombuffer(r["classes"], np.int32).reshape(size, size)
            later = (o > order) | ((o == order) & (c > found))
            order, found = np.where(later, o, order), np.where(later, c, found)
        return pa.table([pa.array([v]) for v in (img, i, j, i * size, j * size, size, size, found.tobytes())], names=["img", "block_row", "block_col", "row0", "col0", "h", "w", "data"])

    drawn = dealt.groupBy("img", "block_row", "block_col", "_salt").applyInArrow(draw, part)
    return drawn.groupBy("img", "block_row", "block_col").applyInArrow(merge, BLOCK)


def fill(objects: DataFrame, ring: str = "ring") -> DataFrame:
    """Runs of the pixels whose centres lie in each object's ring: (other columns, row_no, c0, c1), by even-odd scan lines.

    A ring of fewer than three points, or null, has no pixel.
    """
    from tilewright.functions.geometry import bounds, steps

    box, low = bounds(F.col(ring)), F.floor(bounds(F.col(ring))["miny"])
    rows = objects.where(F.size(ring) >= 3).withColumn("row_no", F.explode(F.sequence(low, F.greatest(low, F.ceil(box["maxy"]) - 1))))
    y = F.col("row_no") + 0.5
    cut = F.filter(steps(F.col(ring), True), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
    xs = F.array_sort(F.transform(cut, lambda e: e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * F.try_divide(y - e["a"]["y"], e["b"]["y"] - e["a"]["y"])))
    rows = rows.withColumn("_x", xs).where(F.size("_x") >= 2)
    pairs = F.transform(F.sequence(F.lit(0), F.size("_x") - 2, F.lit(2)), lambda k: F.struct(F.ceil(F.get("_x", k) - 0.5).alias("c0"), (F.ceil(F.get("_x", k + 1) - 0.5) - 1).alias("c1")))
    return rows.withColumn("_s", F.explode(pairs)).where("_s.c0 <= _s.c1").select(*[c for c in objects.columns if c != ring], "row_no", "_s.c0", "_s.c1")


def without(objects: DataFrame, over: DataFrame, ring: str = "ring") -> DataFrame:
    """Pixels (img, id, row_no, col_no) of objects (img, id, ring) that no ring of ``over`` (img, ring) in the same image covers."""
    mine = fill(objects.select("img", "id", ring), ring).select("img", "id", "row_no", F.explode(F.sequence("c0", "c1")).alias("col_no"))
    theirs = fill(over.select("img", ring), ring).select("img", "row_no", F.explode(F.sequence("c0", "c1")).alias("col_no"))
    return mine.join(theirs, KEY, "left_anti")


#: Directions of border edges, in the order of where they end: up, left, right, down.
STEP_X, STEP_Y = (0, -1, 1, 0), (-1, 0, 0, 1)
#: The right turn of each: rows count downwards, so that of (dx, dy) is (-dy, dx).
RIGHT = (2, 0, 3, 1)
SEGMENT = """img long, c_row long, c_col long, y0 long, x0 long, d int, y1 long, x1 long, last int, n long, area long, closed boolean,
 min_y long, min_x long, min_d int, min_at long, corners array<struct<at:long,x:long,y:long>>"""


def _segments(key: tuple, table, size: int):
    """What the border edges that start in one block form there: stretches of edges that follow one another, and whole rings."""
    import numpy as np
    import pyarrow as pa

    img, by, bx = (k.as_py() for k in key)
    column = lambda n: table.column(n).to_numpy().astype(np.int64)
    cr, cc, y0, x0, d = (column(n) for n in ("c_row", "c_col", "y0", "x0", "d"))
    order = np.lexsort((d, x0, y0))
    cr, cc, y0, x0, d = (v[order] for v in (cr, cc, y0, x0, d))
    n = len(d)
    x1, y1 = x0 + np.array(STEP_X)[d], y0 + np.array(STEP_Y)[d]
    _, owner = np.unique(np.stack([cr, cc], 1), axis=0, return_inverse=True)
    owner = owner.ravel()
    at = lambda y, x: (owner * size + (y - by * size)) * size + (x - bx * size)
    inside = (y1 >= by * size) & (y1 < (by + 1) * size) & (x1 >= bx * size) & (x1 < (bx + 1) * size)
    start = at(y0, x0)
    by_start = np.argsort(start, kind="stable")
    sorted_start, end = start[by_start], np.where(inside, at(y1, x1), -1)
    low, high = np.searchsorted(sorted_start, end, "left"), np.searchsorted(sorted_start, end, "right")
    one = by_start[np.minimum(low, n - 1)]
    two = by_start[np.minimum(np.maximum(high - 1, 0), n - 1)]
    # where two edges start, the right turn, so that rings touch there but do not cross
    after = np.where(high - low == 0, -1, np.where(d[two] == np.array(RIGHT)[d], two, one))
    before = np.full(n, -1)
    before[after[after >= 0]] = np.flatnonzero(after >= 0)
    # rings that lie in the block whole are opened in front of their least edge, which names them
    jump, least = before.copy(), np.arange(n)
    for _ in range(max(1, n.bit_length())):
        some = jump >= 0
        least[some] = np.minimum(least[some], least[jump[some]])
        jump[some] = jump[jump[some]]
    ring = jump >= 0
    closed = ring & (least == np.arange(n))
    before[closed] = -1
    # the first edge of each edge's stretch, and how far it lies behind it
    head, place, jump = np.arange(n), np.zeros(n, dtype=np.int64), before.copy()
    place[jump >= 0] = 1
    for _ in range(max(1, n.bit_length())):
        some = np.flatnonzero(jump >= 0)
        if not len(some):
            break
        place[some] += place[jump[some]]
        jump[some] = jump[jump[some]]
    heads = np.flatnonzero(before < 0)
    number = np.full(n, -1)
    number[heads] = np.arange(len(heads))
    jump = np.where(before < 0, np.arange(n), before)
    for _ in range(max(1, n.bit_length())):
        jump = jump[jump]
    of = number[jump]
    count = np.bincount(of, minlength=len(heads))
    area = np.zeros(len(heads), dtype=np.int64)
    np.add.at(area, of, x0 * y1 - x1 * y0)
    by_segment = np.lexsort((place, of))
    tail = by_segment[np.cumsum(count) - 1]
    smallest = np.full(len(heads), n)
    np.minimum.at(smallest, of, np.arange(n))
    # corners inside a stretch; a ring's first edge is one if the last one turns there, an open stretch's waits for the one before
    turns = np.zeros(n, dtype=bool)
    turns[before >= 0] = d[before[before >= 0]] != d[before >= 0]
    shut = closed[heads]
    turns[heads[shut]] = d[tail[shut]] != d[heads[shut]]
    picked = by_segment[turns[by_segment]]
    points = pa.StructArray.from_arrays([pa.array(v[picked]) for v in (place, x0, y0)], names=["at", "x", "y"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(of[picked], minlength=len(heads)))]).astype(np.int32)
    columns = [np.full(len(heads), img), cr[heads], cc[heads], y0[heads], x0[heads], d[heads].astype(np.int32), y1[tail], x1[tail], d[tail].astype(np.int32), count, area, shut, y0[smallest], x0[smallest], d[smallest].astype(np.int32), place[smallest]]
    names = [f.split()[0] for f in re.split(r",\s+", SEGMENT)]
    return pa.table([*[pa.array(c) for c in columns], pa.ListArray.from_arrays(pa.array(ends), points)], names=names)


def rings(edges: DataFrame, size: int = 512) -> DataFrame:
    """Corners of the closed rings that border edges (``outlines``) form: (img, component, ring, place, x, y, signed_area).

    An edge is followed by the one that starts where it ends; where two start, by the right turn, so rings touch there but do
    not cross. In blocks of ``size`` points the edges become stretches with their lengths; rings inside a block are done then. Only stretches
    that cross blocks are linked, named and placed, by pointer jumping (rounds grow with the logarithm of the stretches of the longest ring), so no
    ring has to fit into one task. Outer rings have a positive area, holes a negative one; the areas of a component sum to its pixels.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    way = F.when(dy == -1, 0).when(dx == -1, 1).when(dx == 1, 2).otherwise(3)
    e = edges.select("img", F.floor(F.col("y0") / size).alias("_by"), F.floor(F.col("x0") / size).alias("_bx"), F.col("component.row_no").alias("c_row"), F.col("component.col_no").alias("c_col"), F.col("y0").cast("long"), F.col("x0").cast("long"), way.alias("d"))
    made = e.groupBy("img", "_by", "_bx").applyInArrow(lambda key, table: _segments(key, table, size), SEGMENT)
    named = F.struct("img", F.col("c_row").alias("row_no"), F.col("c_col").alias("col_no")).alias("component")
    key = F.struct("img", "y0", "x0", "d")
    segments = stage(made.withColumn("component", named).withColumn("e", key).drop("c_row", "c_col"), "segments")
    whole = segments.where("closed").select("img", "component", F.col("e").alias("ring"), F.explode("corners").alias("c"), (F.col("area") / 2).alias("signed_area"))
    whole = whole.select("img", "component", "ring", F.col("c.at").alias("place"), "c.x", "c.y", "signed_area")
    parts = segments.where("not closed")
    if parts.isEmpty():
        return whole
    follow = parts.select("component", F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("e").alias("next"), F.col("d").alias("_d"))
    right = F.element_at(F.array(*[F.lit(k) for k in RIGHT]), F.col("last") + 1) == F.col("_d")
    linked = parts.join(follow, ["component", "x1", "y1"]).groupBy("e").agg(F.max(F.struct(right.cast("int").alias("r"), F.col("next"))).alias("n"))
    succ = stage(linked.select("e", F.col("n.next").alias("next")), "ring-next")
    label = staged_components(succ, "e", "next").select(F.col("node").alias("e"), F.col("component").alias("ring"))
    # the stretch before a ring's name is its last: behind counts the edges from there on to the last one
    sizes = parts.select(F.col("e").alias("next"), F.col("n").alias("_n"))
    now = succ.join(label, "e").join(sizes, "next").select("e", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), F.when(F.col("next") != F.col("ring"), F.col("_n")).otherwise(0).alias("behind"))
    now = stage(now, "ring-steps")
    while not now.where("next is not null").isEmpty():
        ahead = now.select(F.col("e").alias("next"), F.col("next").alias("_n"), F.col("behind").alias("_s"))
        after = stage(now.join(ahead, "next", "left").select("e", "ring", F.col("_n").alias("next"), (F.col("behind") + F.coalesce("_s", F.lit(0))).alias("behind")), "ring-steps")
        drop_staged(now)
        now = after
    placed = now.join(parts, "e").join(succ.select(F.col("e").alias("_before"), F.col("next").alias("e")), "e").join(parts.select(F.col("e").alias("_before"), F.col("last").alias("_from")), "_before")
    least = F.struct("min_y", "min_x", "min_d", (F.col("behind") + F.col("n") - F.col("min_at")).alias("left"))
    of_ring = now.join(parts, "e").groupBy("ring").agg(F.sum("n").alias("total"), (F.sum("area") / 2).alias("signed_area"), F.min(least).alias("m"))
    first = F.when(F.col("_from") != F.col("d"), F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("x0").alias("x"), F.col("y0").alias("y")))).otherwise(F.array().cast("array<struct<at:bigint,x:bigint,y:bigint>>"))
    corners = placed.join(of_ring, "ring").withColumn("c", F.explode(F.concat(first, "corners")))
    # counted from the least edge of the ring, which names it
    place = F.pmod(F.col("m.left") - (F.col("behind") + F.col("n") - F.col("c.at")), F.col("total"))
    name = F.struct("img", F.col("m.min_y").alias("y0"), F.col("m.min_x").alias("x0"), F.col("m.min_d").alias("d"))
    return whole.unionByName(corners.select("img", "component", name.alias("ring"), place.alias("place"), "c.x", "c.y", "signed_area"))


def resize(pixels: DataFrame, sizes: DataFrame, value: str, height: int, width: int) -> DataFrame:
    """Bilinear resize of pixel tables to a fixed size: (img, row_no, col_no, value), half-pixel centres, clamped at the border.

    ``sizes`` has img, h and w. Every new pixel asks for its four source pixels, found by an equal join; one whose sources are
    all missing is left out, and a missing source counts as 0.
    """

    def axis(n: int, size: str, out: str) -> Column:
        def taps(i: Column) -> Column:
            at = F.greatest(F.lit(0.0), F.least((i + 0.5) * F.col(size) / n - 0.5, F.col(size) - 1.0))
            low = F.floor(at)
            return F.array(F.struct(i.alias(out), low.alias("at"), (1 - (at - low)).alias("wt")), F.struct(i.alias(out), (low + 1).alias("at"), (at - low).alias("wt")))

        return F.explode(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), taps)))

    grid = sizes.select("img", "w", axis(height, "h", "i").alias("r")).where("r.wt > 0").select("img", "r", axis(width, "w", "j").alias("c")).where("c.wt > 0")
    asked = grid.select("img", F.col("r.at").alias("row_no"), F.col("c.at").alias("col_no"), "r.i", "c.j", (F.col("r.wt") * F.col("c.wt")).alias("_w"))
    # the list of sizes is small, what comes of it is not: taken for small, it would be broadcast
    met = asked.hint("merge").join(pixels.select(*KEY, value), KEY)
    return met.groupBy("img", F.col("i").alias("row_no"), F.col("j").alias("col_no")).agg(F.sum(F.col("_w") * F.col(value)).alias(value))


def resize_images(images: DataFrame, height: int, width: int) -> DataFrame:
    """The same for decoded images (origin, height, width, nChannels, mode, data): one image a row, in Arrow batches; broken ones are left out."""
    import numpy as np

    def one(h, w, n, data):
        a = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(float)

        def taps(size, new):
            at = np.clip((np.arange(new) + 0.5) * size / new - 0.5, 0, size - 1)
            low = np.floor(at).astype(int)
            return low, np.minimum(low + 1, size - 1), at - low

        r0, r1, fr = taps(h, height)
        c0, c1, fc = taps(w, width)
        fr, fc = fr[:, None, None], fc[None, :, None]
        top, bottom = a[r0][:, c0] * (1 - fc) + a[r0][:, c1] * fc, a[r1][:, c0] * (1 - fc) + a[r1][:, c1] * fc
        return np.floor(top * (1 - fr) + bottom * fr + 0.5).astype(np.uint8).tobytes()

    def run(batches):
        for b in batches:
            data = [one(*x) for x in zip(b.height, b.width, b.nChannels, b.data)]
            yield b.assign(data=data, height=height, width=width)[["origin", "height", "width", "nChannels", "mode", "data"]]

    good = images.where("height > 0").select("origin", "height", "width", "nChannels", "mode", "data")
    return good.mapInPandas(run, "origin string, height int, width int, nChannels int, mode int, data binary")

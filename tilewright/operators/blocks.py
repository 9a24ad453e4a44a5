"""Rasters as blocks: one row for up to ``size`` x ``size`` pixels of an image, worked on with numpy inside tasks.

A block table has img, block_row, block_col, row0, col0 (its first pixel), h, w and data: h * w signed 32-bit
numbers, row by row, ``NONE`` where there is no pixel. Images of any size spread over blocks; what
crosses their borders is settled by joins of border pieces, so only borders, not pixels, are shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.geometry import box_ring, point
from tilewright.operators.raster import rings
from tilewright.plans.components import staged_components
from tilewright.plans.staging import stage

NONE = np.iinfo(np.int32).min
KEY = ["img", "block_row", "block_col"]
BLOCK = "img long, block_row long, block_col long, row0 long, col0 long, h long, w long, data binary"
FIELDS = ["row0", "col0", "h", "w"]
#: Pixels of small blocks that are sent on together.
TOGETHER = 1 << 20


def to_blocks(pixels: DataFrame, value: str, size: int = 512) -> DataFrame:
    """Blocks of a pixel table (img, row_no, col_no, value); a pixel listed twice has one of its values, nulls are none."""
    place = pixels.select("img", F.floor(F.col("row_no") / size).alias("block_row"), F.floor(F.col("col_no") / size).alias("block_col"), "row_no", "col_no", F.col(value).cast("int").alias("v"))

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        img, i, j = (k.as_py() for k in key)
        r, c = (table.column(n).to_numpy() for n in ("row_no", "col_no"))
        v = table.column("v").fill_null(NONE).to_numpy()
        r0, c0 = i * size, j * size
        h, w = int(r.max()) - r0 + 1, int(c.max()) - c0 + 1
        data = np.full((h, w), NONE, dtype=np.int32)
        data[r - r0, c - c0] = v
        return pa.table({"img": [img], "block_row": [i], "block_col": [j], "row0": [r0], "col0": [c0], "h": [h], "w": [w], "data": [data.tobytes()]})

    return place.groupBy(*KEY).applyInArrow(gather, BLOCK)


def image_blocks(images: DataFrame, size: int = 512, channel: int = 0) -> DataFrame:
    """Blocks of one channel of decoded images (img, height, width, nChannels, data); broken images have none. No shuffle."""

    def cut(batches):
        said = lambda rows: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*KEY, *FIELDS, "data"])
        for batch in batches:
            rows, held = [], 0
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])[:, :, channel]
                rows += [(r["img"], i // size, j // size, i, j, *(part := a[i : i + size, j : j + size]).shape, part.astype(np.int32).tobytes()) for i in range(0, a.shape[0], size) for j in range(0, a.shape[1], size)]
                # small images go together
                held += a.size
                if held >= TOGETHER:
                    yield said(rows)
                    rows, held = [], 0
            if rows:
                yield said(rows)

    return images.where("height > 0").select("img", "height", "width", "nChannels", "data").mapInArrow(cut, BLOCK)


def _array(row: dict, name: str = "data") -> np.ndarray:
    return np.frombuffer(row[name], np.int32).reshape(row["h"], row["w"])


def _joined(made: list[pa.RecordBatch]):
    """Batches of equal columns that follow one another as one; without those of no row."""
    for _, same in itertools.groupby((b for b in made if b.num_rows), key=lambda b: b.schema):
        yield pa.concat_batches(list(same))


def _each(blocks: DataFrame, schema: str, work: Callable) -> DataFrame:
    """For every block the columns (arrays of one length, or lists) that ``work`` gives for it; those of small blocks go together."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            made, held = [], 0
            for row in batch.to_pylist():
                made.append(pa.RecordBatch.from_arrays([pa.array(c) for c in work(row)], names=names))
                held += max(made[-1].nbytes // 4, 64)
                if held >= TOGETHER:
                    yield from _joined(made)
                    made, held = [], 0
            yield from _joined(made)

    return blocks.mapInArrow(run, schema)


def to_pixels(blocks: DataFrame) -> DataFrame:
    """The pixel table (img, row_no, col_no, v) of blocks."""

    def spread(row: dict):
        a = _array(row)
        r, c = np.nonzero(a != NONE)
        return np.full(len(r), row["img"]), r + row["row0"], c + row["col0"], a[r, c]

    return _each(blocks, "img long, row_no long, col_no long, v int", spread)


def map_blocks(blocks: DataFrame, f: Callable, extra: str | None = None) -> DataFrame:
    """Each block's values replaced by ``f(values)``, or ``f(values, extra)`` with the block's column of that name; no pixel stays none."""

    def change(row: dict):
        a = _array(row)
        b = np.asarray(f(a, row[extra]) if extra else f(a)).astype(np.int32)
        return [*([row[n]] for n in [*KEY, *FIELDS]), [np.where(a == NONE, NONE, b).astype(np.int32).tobytes()]]

    return _each(blocks, BLOCK, change)


def combine_blocks(a: DataFrame, b: DataFrame, f: Callable) -> DataFrame:
    """``f(values of a, values of b)`` where both rasters have pixels; blocks of equal place and cut are joined, never pixels."""
    other = b.select(*KEY, F.col("h").alias("_h"), F.col("w").alias("_w"), F.col("data").alias("_data"))

    def both(row: dict):
        x, y = _array(row), np.frombuffer(row["_data"], np.int32).reshape(row["_h"], row["_w"])
        h, w = min(row["h"], row["_h"]), min(row["w"], row["_w"])
        x, y = x[:h, :w], y[:h, :w]
        v = np.where((x == NONE) | (y == NONE), NONE, np.asarray(f(x, y)).astype(np.int32)).astype(np.int32)
        return [*([row[n]] for n in (*KEY, "row0", "col0")), [h], [w], [v.tobytes()]]

    return _each(a.join(other, KEY), BLOCK, both)


def histogram(blocks: DataFrame) -> DataFrame:
    """(class, n, share) of all pixels, from one small count table a block."""

    def count(row: dict):
        a = _array(row)
        return np.unique(a[a != NONE], return_counts=True)

    counts = _each(blocks, "class int, n long", count).groupBy(F.col("class").cast("long").alias("class")).agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("class", "n", (F.col("n") / F.col("total")).alias("share"))


def image_stats(blocks: DataFrame) -> DataFrame:
    """(img, n, nonzero, mean) of every image, from three numbers a block."""

    def sums(row: dict):
        a = _array(row)
        a = a[a != NONE]
        return [row["img"]], [a.size], [int(np.count_nonzero(a))], [float(a.sum(dtype=np.int64))]

    parts = _each(blocks, "img long, n long, nonzero long, total double", sums)
    return parts.groupBy("img").agg(F.sum("n").alias("n"), F.sum("nonzero").alias("nonzero"), (F.sum("total") / F.sum("n")).alias("mean"))


def confusion(labels: DataFrame, predicted: DataFrame, n: int) -> DataFrame:
    """(actual, predicted, n) over the cells that occur with both classes in 0..n-1, from one n x n table a block."""
    coded = combine_blocks(labels, predicted, lambda x, y: np.where((x >= 0) & (x < n) & (y >= 0) & (y < n), x * n + y, -1))
    counts = histogram(coded).where("class >= 0")
    return counts.select(F.expr(f"class div {n}").alias("actual"), (F.col("class") % n).alias("predicted"), "n")


# --- regions ---------------------------------------------------------------------------------------
def _runs(a: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first column, last column, value) of the runs of equal value, in order; without those of no pixel."""
    h, w = a.shape
    new = np.ones((h, w), dtype=bool)
    new[:, 1:] = a[:, 1:] != a[:, :-1]
    at = np.flatnonzero(new)
    ends = np.append(at[1:], h * w) - 1
    value = a.ravel()[at]
    some = value != NONE
    return at[some] // w, at[some] % w, ends[some] % w, value[some]


def _label(a: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """The runs and for each the number of the first run of its region inside the block."""
    row, c0, c1, value = _runs(a)
    width = a.shape[1] + 2
    low = np.searchsorted(row * width + c1, (row - 1) * width + c0 - reach, "left")
    high = np.searchsorted(row * width + c0, (row - 1) * width + c1 + reach, "right")
    n = np.maximum(high - low, 0)
    i = np.repeat(np.arange(len(row)), n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    same = value[i] == value[j]
    i, j = i[same], j[same]
    label = np.arange(len(row))
    while True:
        before = label
        label = label.copy()
        least = np.minimum(before[i], before[j])
        for side in (i, j):
            np.minimum.at(label, before[side], least)
            np.minimum.at(label, side, least)
        while (jumped := label[label] != label).any():
            label[jumped] = label[label[jumped]]
        if (label == before).all():
            return row, c0, c1, value, label


PIXEL = T.StructType([T.StructField(n, T.LongType(), False) for n in ("img", "row_no", "col_no")])


def _pixel(img: str, row: str, col: str):
    return F.struct(F.col(img).alias("img"), F.col(row).alias("row_no"), F.col(col).alias("col_no"))


def regions(blocks: DataFrame, diagonal: bool = False, size: int = 512) -> DataFrame:
    """Pieces of regions of equal value, one for each region and block: (img, value, piece, component, x1, y1, x2, y2, pixels).

    4-connected, or 8-connected when diagonal. A piece and a component (img/row/column) are named by their first pixel. Inside blocks regions are
    labelled with numpy; stretches of pieces on both sides of a border are joined by equality on border, block and value and then by overlap, and
    connected there, so a region may cross any number of blocks, and only borders are shuffled. ``size`` is the blocks' own.
    """
    reach = int(diagonal)

    def pieces(row: dict):
        r, c0, c1, v, label = _label(_array(row), reach)
        first, at = np.unique(label, return_inverse=True)
        count = len(first)
        box = [np.full(count, 1 << 40), np.full(count, 1 << 40), np.full(count, -1), np.full(count, -1)]
        np.minimum.at(box[0], at, c0)
        np.minimum.at(box[1], at, r)
        np.maximum.at(box[2], at, c1 + 1)
        np.maximum.at(box[3], at, r + 1)
        pixels = np.bincount(at, weights=c1 - c0 + 1, minlength=count).astype(np.int64)
        move = [row["col0"], row["row0"]] * 2
        return [np.full(count, row["img"]), v[first], r[first] + row["row0"], c0[first] + row["col0"], *[b + m for b, m in zip(box, move, strict=True)], pixels]

    found = stage(_each(blocks, "img long, value int, row_no long, col_no long, x1 long, y1 long, x2 long, y2 long, pixels long", pieces), "pieces")

    def borders(row: dict):
        a = _array(row)
        h, w = a.shape
        r, c0, c1, v, label = _label(a, reach)
        named = np.full(a.shape, -1, dtype=np.int64)
        for k in (0, h - 1):
            on = np.flatnonzero(r == k)
            named[k] = np.where(a[k] == NONE, -1, label[on][np.maximum(np.searchsorted(c0[on], np.arange(w), "right") - 1, 0)] if len(on) else -1)
        for k in (0, w - 1):
            on = np.flatnonzero((c0 <= k) & (c1 >= k))
            named[r[on], k] = label[on]
        out = []
        sides = ((0, row["row0"], 1, named[0], row["col0"]), (0, row["row0"] + h, 0, named[-1], row["col0"]), (1, row["col0"], 1, named[:, 0], row["row0"]), (1, row["col0"] + w, 0, named[:, -1], row["row0"]))
        for axis, line, side, names, start in sides:
            new = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            stop = np.append(new[1:], len(names)) - 1
            some = names[new] >= 0
            p = names[new][some]
            n = len(p)
            out.append((np.full(n, row["img"]), np.full(n, axis), np.full(n, line), np.full(n, side), new[some] + start, stop[some] + start, v[p], r[p] + row["row0"], c0[p] + row["col0"]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    edge = _each(blocks, "img long, axis long, line long, side long, low long, high long, value int, row_no long, col_no long", borders)
    edge = stage(edge.select("img", "axis", "line", "side", "low", "high", "value", _pixel("img", "row_no", "col_no").alias("piece")), "borders")
    spread = F.explode(F.sequence(F.floor((F.col("low") - reach) / size), F.floor((F.col("high") + reach) / size)))
    one = edge.where("side = 0").withColumn("seg", spread)
    two = edge.where("side = 1").select("img", "axis", "line", "value", F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("piece").alias("_piece")).withColumn("seg", F.floor(F.col("_low") / size))
    meet = (F.col("low") <= F.col("_high") + reach) & (F.col("_low") <= F.col("high") + reach)
    across = one.join(two, ["img", "axis", "line", "value", "seg"]).where(meet).select("piece", "_piece")
    parts = staged_components(across, "piece", "_piece")
    named = found.withColumn("piece", _pixel("img", "row_no", "col_no")).join(parts, F.col("piece") == F.col("node"), "left")
    return named.select("img", "value", "piece", F.coalesce("component", "piece").alias("component"), "x1", "y1", "x2", "y2", "pixels")


def region_boxes(parts: DataFrame, min_area: int = 0, area_scale: int = 1) -> DataFrame:
    """Per region: img, value, component, half-open box and pixel count, small ones left out."""
    least, most = [F.min(c).alias(c) for c in ("x1", "y1")], [F.max(c).alias(c) for c in ("x2", "y2")]
    boxes = parts.groupBy("img", "value", "component").agg(*least, *most, F.sum("pixels").alias("pixels"))
    return boxes.where(F.col("pixels") * area_scale >= min_area)


def mask_boxes(blocks: DataFrame, min_area: int = 500, area_scale: int = 1, size: int = 512) -> DataFrame:
    """Boxes of the 8-connected objects (values other than 0) of each mask; a mask without any has one row of nulls."""
    masks = map_blocks(blocks, lambda a: np.where(a == 0, NONE, a))
    boxes = region_boxes(regions(masks, True, size), min_area, area_scale)
    return blocks.select("img").distinct().join(boxes.drop("component"), "img", "left")


def outlines(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """Directed unit edges on the border of each 4-connected region: (img, component, x0, y0, x1, y1), inside on the right.

    ``parts`` are the blocks' ``regions``. An edge between two pixels of one value is none; on the border of a block both sides give
    theirs, and the two opposite ones of equal value cancel.
    """

    def edges(row: dict):
        a = _array(row)
        h, w = a.shape
        r, c0, c1, v, label = _label(a, 0)
        out = []
        run_of = np.zeros(a.shape, dtype=np.int64)
        lengths = c1 - c0 + 1
        flat = np.repeat(r * w + c0, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        run_of.ravel()[flat] = np.repeat(label, lengths)
        real = a != NONE
        # (row, column) steps to the neighbour, then the edge's ends as (column, row) steps
        for dr, dc, ends in ((-1, 0, (0, 0, 1, 0)), (0, 1, (1, 0, 1, 1)), (1, 0, (1, 1, 0, 1)), (0, -1, (0, 1, 0, 0))):
            beyond = np.full(a.shape, NONE, dtype=np.int32)
            rows, cols = slice(max(0, dr), h + min(0, dr)), slice(max(0, dc), w + min(0, dc))
            beyond[slice(max(0, -dr), h + min(0, -dr)), slice(max(0, -dc), w + min(0, -dc))] = a[rows, cols]
            i, j = np.nonzero(real & (beyond != a))
            border = (i + dr < 0) | (i + dr >= h) | (j + dc < 0) | (j + dc >= w)
            p = run_of[i, j]
            n = len(i)
            y, x = i + row["row0"], j + row["col0"]
            out.append((np.full(n, row["img"]), v[p], r[p] + row["row0"], c0[p] + row["col0"], border, x + ends[0], y + ends[1], x + ends[2], y + ends[3]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    found = stage(_each(blocks, "img long, value int, row_no long, col_no long, border boolean, x0 long, y0 long, x1 long, y1 long", edges), "outline")
    line = ["img", "value", F.least("x0", "x1").alias("_x"), F.least("y0", "y1").alias("_y"), (F.col("x0") != F.col("x1")).alias("_across")]
    single = found.where("border").groupBy(*line).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("row_no", "col_no", "x0", "y0", "x1", "y1")]).where("_n = 1")
    names = ["img", "row_no", "col_no", "x0", "y0", "x1", "y1"]
    left = found.where("not border").select(*names).unionByName(single.select(*names))
    joined = left.withColumn("piece", _pixel("img", "row_no", "col_no")).join(parts.select("piece", "component"), "piece")
    return joined.select("img", "component", "x0", "y0", "x1", "y1")


def vectorise(blocks: DataFrame, categories: DataFrame, size: int = 512) -> DataFrame:
    """Regions of the values that ``categories`` wants, as features: (img, num, category, component, x1, y1, x2, y2, pixels, polygon).

    ``categories`` has pixel_value, category_name, vectorize, bbox_flag, kernel_size, min_area; it is small by nature, and its values come to the
    driver. ``polygon`` has the outer ring and then the holes, by area; with ``bbox_flag`` it is the box. ``min_area`` (null: none) counts
    pixels; ``kernel_size`` has no effect on regions. An image without such regions has no row; order by num when writing.
    """
    values = [r["pixel_value"] for r in categories.where("vectorize").select("pixel_value").distinct().collect()]
    kept = stage(map_blocks(blocks, lambda a: np.where(np.isin(a, values), a, NONE)), "kept")
    parts = stage(regions(kept, False, size), "regions")
    wanted = F.broadcast(categories.where("vectorize").select("pixel_value", "category_name", F.coalesce("bbox_flag", F.lit(False)).alias("boxed"), "min_area"))
    boxes = region_boxes(parts).join(wanted, F.col("value") == F.col("pixel_value")).where(F.coalesce(F.col("pixels") >= F.col("min_area"), F.lit(True)))
    boxes = stage(boxes, "boxes")
    drawn = parts.join(boxes.where("not boxed").select("component"), "component", "left_semi")
    corners = rings(outlines(kept, drawn), size)
    by_ring = corners.groupBy("component", "ring", "signed_area").agg(F.array_sort(F.collect_list(F.struct("place", "x", "y"))).alias("c"))
    line = F.transform("c", lambda p: point(p["x"], p["y"]))
    polygons = by_ring.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("signed_area", line.alias("line"))), asc=False).alias("r"))
    polygons = polygons.select("component", F.transform("r", lambda r: r["line"]).alias("drawn"))
    box = F.array(box_ring(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]))
    joined = boxes.join(polygons, "component", "left")
    return joined.select("img", F.col("value").alias("num"), F.col("category_name").alias("category"), "component", "x1", "y1", "x2", "y2", "pixels", F.coalesce("drawn", box).alias("polygon"))


def region_features(found: DataFrame, transforms: DataFrame, epsg: int) -> DataFrame:
    """What ``vectorise`` found as features in world coordinates, as the GeoJSON writers take them: img, num, category, pixels, kind, parts, polygons, epsg.

    ``transforms`` has img and a to f of each image's affine transform (x = a col + b row + c, y = d col + e row + f), such as world files
    give; it is joined by image, and an image without one raises.
    """
    of = transforms.select("img", F.struct(*[F.col(c).cast("double").alias(c) for c in "abcdef"]).alias("_t"))
    joined = found.join(of, "img", "left")
    t = F.coalesce(F.col("_t"), F.raise_error(F.concat(F.lit("no transform for image "), F.col("img"))).cast("struct<a:double,b:double,c:double,d:double,e:double,f:double>"))
    joined = joined.withColumn("_t", t)
    t = F.col("_t")
    world = lambda p: point(t["a"] * p["x"] + t["b"] * p["y"] + t["c"], t["d"] * p["x"] + t["e"] * p["y"] + t["f"])
    rings_of = F.transform("polygon", lambda ring: F.transform(ring, world))
    return joined.withColumn("parts", rings_of).select("img", "num", "category", "pixels", F.lit("Polygon").alias("kind"), "parts", F.array("parts").alias("polygons"), F.lit(epsg).alias("epsg"))


def component_name(component: str = "component"):
    return F.concat_ws("/", f"{component}.img", f"{component}.row_no", f"{component}.col_no").alias("component")

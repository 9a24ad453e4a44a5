"""Rasters of several channels as blocks of 32-bit floats, windows over them, and overlap-add of what a model says about windows.

A stack table has img, block_row, block_col, row0, col0 (its first pixel), h, w, channels and data: h * w * channels floats, pixel by
pixel, NaN where there is no pixel. Blocks lie on a grid of ``size`` pixels. Windows are cut from a block and the margins that its
neighbours send it; what the windows say is merged in the same task, and only parts of arrays for each
target block are shuffled, never a row for a pixel.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import blocks as B
from tilewright.operators.evaluate import class_report
from tilewright.operators.windows import clamped_patches, random_offset, window_boxes
from tilewright.plans.staging import stage

KEY = B.KEY
STACK = "img long, block_row long, block_col long, row0 long, col0 long, h long, w long, channels long, data binary"
NAMES = [f.split()[0] for f in STACK.split(", ")]
_LOADED: dict[str, object] = {}
#: Tables of a row for each image are broadcast up to so many rows.
FEW = 200_000


def once_a_worker(load: Callable) -> Callable:
    """``load`` wrapped so that a Python worker calls it once and keeps one model: the last one asked for."""
    key = uuid.uuid4().hex

    def get():
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = load()
        return _LOADED[key]

    return get


def _array(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], np.float32).reshape(row["h"], row["w"], row["channels"])


def _row(img: int, i: int, j: int, r0: int, c0: int, a: np.ndarray) -> tuple:
    return img, i, j, r0, c0, *a.shape, np.ascontiguousarray(a, dtype=np.float32).tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in NAMES]
    kinds = [pa.int64()] * (len(NAMES) - 1) + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)


def _map(stacks: DataFrame, work: Callable[[dict], list[tuple]], profile=None) -> DataFrame:
    """For every block the rows that ``work`` makes of it, a record batch each; ``profile`` for its tasks, but in local sessions."""
    if profile is not None and stacks.sparkSession.sparkContext.master.split("[")[0] == "local":
        profile = None

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                if rows := work(batch.slice(i, 1).to_pylist()[0]):
                    yield _batch(rows)

    return stacks.mapInArrow(run, STACK, profile=profile)


# --- making and reading stacks --------------------------------------------------------------------------
def stack_bands(*bands: DataFrame) -> DataFrame:
    """Stacks of one-band block tables of one grid, a channel each in the order given; joins of blocks, no pixel is shuffled. A block absent from one band is left out."""
    both = bands[0].withColumnsRenamed({"data": "_d0", "h": "_h0", "w": "_w0"})
    for k, band in enumerate(bands[1:], 1):
        both = both.join(band.select(*KEY, F.col("data").alias(f"_d{k}"), F.col("h").alias(f"_h{k}"), F.col("w").alias(f"_w{k}")), KEY)

    n = len(bands)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                parts = [np.frombuffer(r[f"_d{k}"], np.int32).reshape(r[f"_h{k}"], r[f"_w{k}"]) for k in range(n)]
                h, w = (min(p.shape[d] for p in parts) for d in (0, 1))
                a = np.stack([np.where(p[:h, :w] == B.NONE, np.nan, p[:h, :w]) for p in parts], 2)
                yield _batch([_row(*(r[c] for c in (*KEY, "row0", "col0")), a)])

    return both.mapInArrow(run, STACK)


def image_stacks(images: DataFrame, size: int = 512) -> DataFrame:
    """Stacks of all channels of decoded images (img, height, width, nChannels, data); broken images have none. No shuffle."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                for i in range(0, a.shape[0], size):
                    yield _batch([_row(r["img"], i // size, j // size, i, j, a[i : i + size, j : j + size]) for j in range(0, a.shape[1], size)])

    return images.where("height > 0 and width > 0").select("img", "height", "width", "nChannels", "data").mapInArrow(run, STACK)


def map_stacks(stacks: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Each block's array [h, w, channels] replaced by ``f(array)`` of equal height and width."""
    return _map(stacks, lambda r: [_row(*(r[c] for c in (*KEY, "row0", "col0")), f(_array(r)))])


def to_pixels(stacks: DataFrame) -> DataFrame:
    """(img, row_no, col_no, class, p): a row for each pixel and channel that has a number; for looking at small results."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a = _array(r)
                y, x, k = np.nonzero(~np.isnan(a))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.full(len(y), r["img"]), y + r["row0"], x + r["col0"], k, a[y, x, k].astype(np.float64))], names=["img", "row_no", "col_no", "class", "p"])

    return stacks.mapInArrow(run, "img long, row_no long, col_no long, class long, p double")


def class_blocks(stacks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The class of every pixel as one-band blocks: the channel of the highest number, the first of equals; a single channel is compared with the threshold."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                found = classes_of(_array(r), threshold)
                yield pa.RecordBatch.from_arrays([pa.array([r[c]]) for c in (*KEY, *B.FIELDS)] + [pa.array([found.tobytes()])], names=[*KEY, *B.FIELDS, "data"])

    return stacks.mapInArrow(run, B.BLOCK)


def classes_of(a: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    none = np.isnan(a).all(axis=2)
    best = (a[:, :, 0] > threshold) if a.shape[2] == 1 else np.where(np.isnan(a), -np.inf, a).argmax(axis=2)
    return np.where(none, B.NONE, best).astype(np.int32)


# --- merging ---------------------------------------------------------------------------------------------
def merge_parts(parts: DataFrame, floor: float | None = 0.0) -> DataFrame:
    """One stack for each block of parts of it: the elementwise maximum where they overlap, at least ``floor``, no pixel where none has one.

    Parts are stacks of any size whose pixels lie in the block that their key names. Channels missing in one part have no number there.
    """

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        r0, c0 = min(r["row0"] for r in rows), min(r["col0"] for r in rows)
        shape = max(r["row0"] + r["h"] for r in rows) - r0, max(r["col0"] + r["w"] for r in rows) - c0, max(r["channels"] for r in rows)
        out = np.full(shape, np.nan, dtype=np.float32)
        for r in rows:
            a = _array(r)
            at = out[r["row0"] - r0 : r["row0"] - r0 + r["h"], r["col0"] - c0 : r["col0"] - c0 + r["w"], : r["channels"]]
            np.fmax(at, a, out=at)
        if floor is not None:
            out = np.where(np.isnan(out), out, np.maximum(out, np.float32(floor)))
        return pa.Table.from_batches([_batch([_row(*(k.as_py() for k in key), r0, c0, out)])])

    return parts.groupBy(*KEY).applyInArrow(merge, STACK)


def cut_parts(a: np.ndarray, img: int, r0: int, c0: int, size: int) -> list[tuple]:
    """An array placed at (r0, c0) as parts by block, each without its empty edges; blocks without a number have none."""
    out = []
    for i in range(r0 // size, (r0 + a.shape[0] - 1) // size + 1):
        for j in range(c0 // size, (c0 + a.shape[1] - 1) // size + 1):
            top, left = max(r0, i * size), max(c0, j * size)
            part = a[top - r0 : (i + 1) * size - r0, left - c0 : (j + 1) * size - c0]
            some = ~np.isnan(part).all(axis=2)
            ys, xs = np.flatnonzero(some.any(axis=1)), np.flatnonzero(some.any(axis=0))
            if len(ys):
                out.append(_row(img, i, j, top + int(ys[0]), left + int(xs[0]), part[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]))
    return out


# --- windows ---------------------------------------------------------------------------------------------
def with_margins(stacks: DataFrame, below: int, right: int, size: int = 512, outside: bool = False) -> DataFrame:
    """Parts of blocks keyed by who wants them: each block's own, and for the blocks above and to the left of it the rows and columns that reach into their margin.

    ``outside`` also serves places above or left of the image's first block, where padded windows start.
    """

    def send(r: dict) -> list[tuple]:
        a, out = _array(r), []
        for di in range(0, -(-below // size) + 1):
            for dj in range(0, -(-right // size) + 1):
                i, j = r["block_row"] - di, r["block_col"] - dj
                h, w = (i + 1) * size + below - r["row0"], (j + 1) * size + right - r["col0"]
                part = a[: h if di else None, : w if dj else None]
                if (not di or h > 0) and (not dj or w > 0) and part.size and (outside or min(i, j) >= 0):
                    out.append(_row(r["img"], i, j, r["row0"], r["col0"], part))
        return out

    return _map(stacks, send)


HELD = STACK + ", places array<bigint>"


def score_windows(
    stacks: DataFrame, windows: DataFrame, window: tuple[int, int], load: Callable, size: int = 512, centre: bool = False, classes: bool = False, outside: bool = False, batch: int = 16, profile=None
) -> DataFrame:
    """What a model says about windows, merged to stacks: the elementwise maximum, at least 0, of overlapping windows, or each window's centre half alone.

    ``windows`` has img, x1 and y1 of windows of the given (height, width); ``load`` returns, once a Python worker, a model that turns arrays
    [n, height, width, channels] (NaN outside of the image) and their places [n, 2] (row, column of the first pixel) into [n, height, width, k]. A window
    is cut in the task of the block that holds its first pixel, out of that block and the margins that others send: one shuffle of pixels as
    arrays. The windows of a block are merged in place, ``batch`` of them at a time; parts for other blocks are the second shuffle. With ``centre`` windows stand
    half their size apart, and rows and columns from a quarter of it count, so each pixel is one window's; ``classes`` then hands on
    the class of the highest number instead of all numbers, as a stack of one channel. Windows may reach beyond the right and lower edge;
    those that start left of or above the image need ``outside``, and raise without it. ``profile`` is a Spark resource profile for the tasks that
    run the model (a GPU each, say); local sessions, which have no such resources, leave it out.
    """
    if classes and not centre:
        raise ValueError("classes can be taken before merging only where each pixel is one window's")
    h, w = window
    x1, y1 = (F.col(c) if outside else F.when(F.col(c) >= 0, F.col(c)).otherwise(F.raise_error(F.lit("a window starts outside of the image"))) for c in ("x1", "y1"))
    place = windows.select("img", x1.cast("long").alias("x1"), y1.cast("long").alias("y1"))
    place = place.select("img", F.floor(F.col("y1") / size).alias("block_row"), F.floor(F.col("x1") / size).alias("block_col"), "x1", "y1")

    def hold(key: tuple, parts: pa.Table, wanted: pa.Table) -> pa.Table:
        """The pixels that a block's windows cover, and where the windows start."""
        names = [*NAMES, "places"]
        if not wanted.num_rows or not parts.num_rows:
            return pa.table({n: pa.array([], pa.binary() if n == "data" else pa.list_(pa.int64()) if n == "places" else pa.int64()) for n in names})
        at = np.unique(np.stack([wanted.column("y1").to_numpy(), wanted.column("x1").to_numpy()], 1), axis=0)
        low, high = at.min(axis=0), at.max(axis=0) + (h, w)
        row = _row(*(k.as_py() for k in key), int(low[0]), int(low[1]), _assembled(parts.to_pylist(), low, high))
        return pa.table([pa.array([v]) for v in (*row, at.ravel().tolist())], names=names)

    get = once_a_worker(load)

    def score(r: dict) -> list[tuple]:
        model, held, low = get(), _array(r), np.array([r["row0"], r["col0"]])
        at, out = np.array(r["places"]).reshape(-1, 2), None
        for n in range(0, len(at), batch):
            some = at[n : n + batch]
            said = np.asarray(model(np.stack([held[y : y + h, x : x + w] for y, x in some - low]), some), dtype=np.float32)
            if classes:
                said = np.where(np.isnan(said).all(axis=3), np.nan, np.where(np.isnan(said), -np.inf, said).argmax(axis=3))[..., None].astype(np.float32)
            if out is None:
                out = np.full((*held.shape[:2], said.shape[3]), np.nan, dtype=np.float32)
            for (y, x), p in zip(some - low, said, strict=True):
                if centre:
                    p = p[h // 4 : h // 4 + h // 2, w // 4 : w // 4 + w // 2]
                    y, x = y + h // 4, x + w // 4
                target = out[y : y + p.shape[0], x : x + p.shape[1]]
                np.fmax(target, p, out=target)
        # what lies outside of the image is no pixel
        out[np.isnan(held).all(axis=2)] = np.nan
        return cut_parts(out, r["img"], r["row0"], r["col0"], size)

    parts = with_margins(stacks, h - 1, w - 1, size, outside)
    held = parts.groupBy(*KEY).cogroup(place.groupBy(*KEY)).applyInArrow(hold, HELD)
    return on_grid(merge_parts(_map(held, score, profile), None if centre else 0.0), size)


def _assembled(rows: list[dict], low, high) -> np.ndarray:
    """The array from place ``low`` to ``high`` of an image, of the parts that lie there; NaN elsewhere."""
    held = None
    for r in rows:
        a = _array(r)
        if held is None:
            held = np.full((int(high[0] - low[0]), int(high[1] - low[1]), a.shape[2]), np.nan, dtype=np.float32)
        y, x = max(low[0], r["row0"]), max(low[1], r["col0"])
        y1, x1 = min(high[0], r["row0"] + r["h"]), min(high[1], r["col0"] + r["w"])
        if y < y1 and x < x1:
            held[y - low[0] : y1 - low[0], x - low[1] : x1 - low[1]] = a[y - r["row0"] : y1 - r["row0"], x - r["col0"] : x1 - r["col0"]]
    return held


def on_grid(stacks: DataFrame, size: int) -> DataFrame:
    """Stacks that start at their block's first pixel, so that blocks of two tables lie on one another."""

    def fill(r: dict) -> list[tuple]:
        a = _array(r)
        dy, dx = r["row0"] - r["block_row"] * size, r["col0"] - r["block_col"] * size
        return [_row(*(r[c] for c in KEY), r["row0"] - dy, r["col0"] - dx, np.pad(a, ((dy, 0), (dx, 0), (0, 0)), constant_values=np.nan) if dy or dx else a)]

    return _map(stacks, fill)


def predict_overlapping(stacks: DataFrame, sizes: DataFrame, patch: int, load: Callable, share: float = 0.8, size: int = 512) -> DataFrame:
    """Class blocks of whole images by overlapping patches with step int(share * patch); ``sizes`` has img, h, w. Images smaller than a patch have none."""
    at = clamped_patches(sizes.withColumnRenamed("img", "img_id"), patch, share).select(F.col("img_id").alias("img"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    return class_blocks(score_windows(stacks, at, (patch, patch), load, size))


def predict_stitched(stacks: DataFrame, sizes: DataFrame, box: int, load: Callable, size: int = 512) -> DataFrame:
    """Class blocks of whole images by half-stride windows, each pixel from the centre half of its window; in the image's own rows and columns, from (box/4, box/4) on."""
    at = window_boxes(sizes.withColumnRenamed("img", "img_id"), box, box, box // 2).withColumnRenamed("img_id", "img")
    found = score_windows(stacks, at, (box, box), load, size, centre=True, classes=True)
    return one_band(found)


def one_band(stacks: DataFrame, channel: int = 0) -> DataFrame:
    """A channel of whole numbers as one-band blocks; an array that has no such channel is left out."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if r["channels"] > channel:
                    a = _array(r)[:, :, channel]
                    data = np.where(np.isnan(a), B.NONE, a).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([r[c]]) for c in (*KEY, *B.FIELDS)] + [pa.array([data.tobytes()])], names=[*KEY, *B.FIELDS, "data"])

    return stacks.mapInArrow(run, B.BLOCK)


# --- regions of images: crops and resizing -----------------------------------------------------------------
WANTED = "img long, block_row long, block_col long, h long, w long, r0 long, c0 long, r1 long, c1 long"


def gather(stacks: DataFrame, wanted: DataFrame, work: Callable[[np.ndarray, dict], np.ndarray], size: int) -> DataFrame:
    """New blocks, each made by ``work`` of a region of its image: ``work(pixels of the region, row of wanted)`` gives an array [h, w, channels].

    ``wanted`` has img, the new block's block_row, block_col, h and w, and the region's first and last pixels r0, c0, r1, c1 (ends exclusive). Blocks are joined
    with the regions that reach into them and cut there, so of each block only the parts asked for are shuffled, as arrays. Regions without a pixel give no block.
    """
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor((F.col(b) - 1) / size)))
    asked = wanted.where("r0 < r1 and c0 < c1").select(F.struct(*wanted.columns).alias("want"), "img", span("r0", "r1").alias("block_row"), "c0", "c1")
    asked = asked.select("want", "img", "block_row", span("c0", "c1").alias("block_col"))
    met = stacks.join(asked, KEY).select(*NAMES, "want")

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                a, q = _array(r), r["want"]
                y0, x0, y1, x1 = max(r["row0"], q["r0"]), max(r["col0"], q["c0"]), min(r["row0"] + r["h"], q["r1"]), min(r["col0"] + r["w"], q["c1"])
                if y0 < y1 and x0 < x1:
                    part = _batch([_row(q["img"], q["block_row"], q["block_col"], y0, x0, a[y0 - r["row0"] : y1 - r["row0"], x0 - r["col0"] : x1 - r["col0"]])])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([q], batch.schema.field("want").type)], names=[*NAMES, "want"])

    kind = f"{STACK}, want struct<{', '.join(f.replace(' ', ':', 1) for f in WANTED.split(', '))}>"
    parts = met.mapInArrow(cut, kind)

    def make(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        q = rows[0]["want"]
        found = work(_assembled(rows, (q["r0"], q["c0"]), (q["r1"], q["c1"])), q)
        return pa.Table.from_batches([_batch([_row(*(k.as_py() for k in key), q["block_row"] * size, q["block_col"] * size, found)])])

    return parts.groupBy(*KEY).applyInArrow(make, STACK)


def _target_blocks(sizes: DataFrame, height, width, size: int) -> DataFrame:
    """(sizes' columns, block_row, block_col, h, w) of the blocks of images of a height and width."""
    axis = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / size)))
    d = sizes.withColumns({"_new_h": height.cast("long"), "_new_w": width.cast("long")}).where("_new_h > 0 and _new_w > 0")
    d = d.withColumn("block_row", axis(F.col("_new_h"))).withColumn("block_col", axis(F.col("_new_w")))
    left = lambda n, k: F.least(F.lit(size).cast("long"), F.col(n) - F.col(k) * size)
    return d.withColumns({"h": left("_new_h", "block_row"), "w": left("_new_w", "block_col")})


def crop_stacks(stacks: DataFrame, places: DataFrame, height: int, width: int, size: int = 512) -> DataFrame:
    """A crop of each image of ``places`` (img, row0, col0) as blocks counted from its corner; crops may lie over any number of blocks. What lies outside of the image is no pixel."""
    at = places.select("img", F.col("row0").cast("long").alias("_r"), F.col("col0").cast("long").alias("_c"))
    d = _target_blocks(at, F.lit(height), F.lit(width), size)
    r0, c0 = F.col("_r") + F.col("block_row") * size, F.col("_c") + F.col("block_col") * size
    wanted = d.select("img", "block_row", "block_col", "h", "w", r0.alias("r0"), c0.alias("c0"), (r0 + F.col("h")).alias("r1"), (c0 + F.col("w")).alias("c1"))
    return gather(stacks, wanted, lambda a, q: a, size)


def random_crops(stacks: DataFrame, sizes: DataFrame, height: int, width: int, seed: int, key=None, size: int = 512) -> DataFrame:
    """A crop of each image (img, h, w in ``sizes``) at a reproducible place, see ``windows.random_offset``; images smaller on either side are left out."""
    fits = sizes.where((F.col("h") >= height) & (F.col("w") >= width))
    rows = random_offset("img", F.col("h") - height, seed, key)
    cols = random_offset("img", F.col("w") - width, seed + 1, None if key is None else key + 1)
    return crop_stacks(stacks, fits.select("img", rows.alias("row0"), cols.alias("col0")), height, width, size)


def resize_stacks(stacks: DataFrame, sizes: DataFrame, height: int, width: int, size: int = 512) -> DataFrame:
    """Bilinear resize of images spread over blocks to a fixed size, half-pixel centres, clamped at the border; ``sizes`` has img, h, w.

    Each new block asks for the source pixels under it and one more row and column. A pixel of which a source is missing is none.
    """
    d = _target_blocks(sizes.select("img", F.col("h").cast("long").alias("_h"), F.col("w").cast("long").alias("_w")), F.lit(height), F.lit(width), size)

    def span(first, count, old: str, new: int, name: str):
        at = lambda i: F.floor(F.greatest(F.lit(0.0), F.least((i + 0.5) * F.col(old) / new - 0.5, F.col(old) - 1.0)))
        return at(first).alias(f"{name}0"), F.least(at(first + count - 1) + 2, F.col(old)).alias(f"{name}1")

    r, c = span(F.col("block_row") * size, F.col("h"), "_h", height, "r"), span(F.col("block_col") * size, F.col("w"), "_w", width, "c")
    # the image's own size comes along in the place of the new block's, which follows from it
    wanted = d.select("img", "block_row", "block_col", F.col("_h").alias("h"), F.col("_w").alias("w"), r[0], c[0], r[1], c[1])

    def scale(a: np.ndarray, q: dict) -> np.ndarray:
        def taps(old: int, new: int, block: int, first: int):
            i = np.arange(block * size, min(new, (block + 1) * size))
            at = np.clip((i + 0.5) * old / new - 0.5, 0, old - 1)
            low = np.floor(at).astype(int)
            return low - first, np.minimum(low + 1, old - 1) - first, at - low

        y0, y1, fy = taps(q["h"], height, q["block_row"], q["r0"])
        x0, x1, fx = taps(q["w"], width, q["block_col"], q["c0"])
        a, fy, fx = a.astype(np.float64), fy[:, None, None], fx[None, :, None]
        across = lambda y: np.where(fx > 0, a[y][:, x0] * (1 - fx) + a[y][:, x1] * fx, a[y][:, x0])
        return np.where(fy > 0, across(y0) * (1 - fy) + across(y1) * fy, across(y0))

    return gather(stacks, wanted, scale, size)


def report(predicted: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Class report of predicted blocks against label blocks of one grid: pixels that both have, from one n x n table a block; so a mosaic crops its labels by itself."""
    cells = predicted.sparkSession.range(n * n).select(F.expr(f"id div {n}").alias("actual"), (F.col("id") % n).alias("predicted"))
    found = B.confusion(labels, predicted, n)
    whole = cells.join(F.broadcast(found), ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return class_report(whole)


# --- moments ---------------------------------------------------------------------------------------------
MOMENTS = "img long, channel long, n long, mean double, m2 double"


def channel_moments(stacks: DataFrame) -> DataFrame:
    """(img, channel, n, mean, m2) of each image's channels: m2 is the sum of squared differences from the mean.

    Each block gives its own, in one scan; those of an image are merged about their common mean, by Chan's formula, so
    large offsets lose nothing. A few numbers a block are staged and shuffled, and summed partly before.
    """

    def of_block(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a = _array(r).reshape(-1, r["channels"]).astype(np.float64)
                n = (~np.isnan(a)).sum(axis=0)
                some = np.flatnonzero(n)
                mean = np.nanmean(a[:, some], axis=0) if len(some) else np.zeros(0)
                m2 = np.nansum((a[:, some] - mean) ** 2, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.full(len(some), r["img"]), some, n[some], mean, m2)], names=["img", "channel", "n", "mean", "m2"])

    parts = stage(stacks.mapInArrow(of_block, MOMENTS), "moments")
    means = parts.groupBy("img", "channel").agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    away = F.col("mean") - F.col("_mean")
    # what lies inside the blocks and what lies between them, each summed partly before the shuffle
    merged = parts.join(means, ["img", "channel"]).groupBy("img", "channel").agg(F.first("_n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * away * away).alias("m2"))
    return merged.select("img", "channel", "n", "mean", "m2")


def channel_means(stacks: DataFrame) -> DataFrame:
    """(channel, mean): the average of the images' channel means; every image weighs the same."""
    return channel_moments(stacks).groupBy("channel").agg(F.avg("mean").alias("mean"))


def standardise(stacks: DataFrame, eps: float = 1e-9) -> DataFrame:
    """(x - mean) / (population deviation + eps) in each image and channel: one scan for the moments, one join of a row an image."""
    scale = channel_moments(stacks).select("img", F.struct("channel", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("s")).alias("c")).groupBy("img").agg(F.array_sort(F.collect_list("c")).alias("_scale"))
    scale = stage(scale, "scale")
    # a row an image: small enough to go to the pixels, or else the blocks are joined by image
    joined = stacks.join(F.broadcast(scale) if scale.count() <= FEW else scale, "img").select(*NAMES, "_scale")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a = _array(r).astype(np.float64)
                for c in r["_scale"]:
                    a[:, :, c["channel"]] = (a[:, :, c["channel"]] - c["mean"]) / (c["s"] + eps)
                yield _batch([_row(*(r[c] for c in (*KEY, "row0", "col0")), a)])

    return joined.mapInArrow(run, STACK)


def centre_channels(stacks: DataFrame, means: list[float], scale: float = 255.0) -> DataFrame:
    """(x - the channel's mean) / scale."""
    return map_stacks(stacks, lambda a: (a - np.asarray(means, dtype=np.float32)) / np.float32(scale))

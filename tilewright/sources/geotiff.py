"""GeoTIFF rasters of any size, read block by block: only headers, and the strips or tiles under a block, are opened.

Classic and big TIFF, whole numbers and floats, one or more bands, uncompressed or deflated; the transform, coordinate system and no-data value come
from the file's own tags. What is not of this kind is a row of rejects.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import stacks as S
from tilewright.operators.manifests import stem
from tilewright.plans.order import prefix_sum
from tilewright.plans.staging import stage
from tilewright.sources.committed import file_system

#: Fixed values of the format: bytes and letter of each field type, tags, and what stands for a kind of numbers.
FIELD = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, NO_DATA = 33550, 33922, 34264, 34735, 42113
GEOGRAPHIC, PROJECTED, RASTER_TYPE = 2048, 3072, 1025
NONE_, DEFLATE = 1, (8, 32946)
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def encode(a: np.ndarray, transform: tuple[float, ...] | None = None, epsg: int | None = None, tile: int | None = None, rows: int = 64, deflate: bool = True, nodata: float | None = None) -> bytes:
    """A little-endian TIFF file of an array [h, w] or [h, w, bands], in strips of ``rows`` or square tiles of ``tile`` (a multiple of 16); transform as (a, b, c, d, e, f)."""
    a = a[:, :, None] if a.ndim == 2 else a
    h, w, bands = a.shape
    a = np.ascontiguousarray(a, dtype=a.dtype.newbyteorder("<"))
    kind = next(k for k, v in KINDS.items() if np.dtype(v) == a.dtype.newbyteorder("="))
    parts = []
    for y in range(0, h, tile or rows):
        for x in range(0, w, tile or w):
            part = a[y : y + (tile or rows), x : x + (tile or w)]
            if tile:
                part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)))
            parts.append(zlib.compress(part.tobytes()) if deflate else part.tobytes())
    tags: dict[int, tuple[int, list]] = {
        WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [kind[1]] * bands), COMPRESSION: (3, [8 if deflate else 1]), 262: (3, [1]), SAMPLES: (3, [bands]), PLANAR: (3, [1]), SAMPLE_FORMAT: (3, [kind[0]] * bands),
        (TILES if tile else STRIPS): (4, [0] * len(parts)), (TILE_BYTES if tile else STRIP_BYTES): (4, [len(p) for p in parts]),
    }
    tags |= {TILE_WIDTH: (3, [tile]), TILE_HEIGHT: (3, [tile])} if tile else {ROWS: (3, [rows])}
    if transform:
        p, q, r, s, t, u = transform
        tags[TRANSFORM] = (12, [p, q, 0.0, r, s, t, 0.0, u, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])
    if epsg:
        tags[GEO_KEYS] = (3, [1, 1, 0, 2, RASTER_TYPE, 0, 1, 1, PROJECTED, 0, 1, epsg])
    if nodata is not None:
        tags[NO_DATA] = (2, [f"{nodata:g}".encode() + b"\0"])
    size = lambda k, v: len(v[0]) if k == 2 else FIELD[k][0] * len(v)
    at = 8 + 2 + 12 * len(tags) + 4
    places = {}
    for tag, (k, v) in sorted(tags.items()):
        if size(k, v) > 4:
            places[tag] = at
            at += size(k, v) + size(k, v) % 2
    data = []
    for p in parts:
        data.append(at)
        at += len(p)
    tags[TILES if tile else STRIPS] = (4, data)
    packed = lambda k, v: v[0] if k == 2 else struct.pack(f"<{len(v)}{FIELD[k][1]}", *v)
    out = [b"II*\0" + struct.pack("<IH", 8, len(tags))]
    extra = []
    for tag, (k, v) in sorted(tags.items()):
        raw = packed(k, v)
        out.append(struct.pack("<HHI", tag, k, len(v[0]) if k == 2 else len(v)) + (raw.ljust(4, b"\0") if tag not in places else struct.pack("<I", places[tag])))
        if tag in places:
            extra.append(raw + b"\0" * (len(raw) % 2))
    return b"".join([*out, b"\0" * 4, *extra, *parts])


def header(read: Callable[[int, int], bytes]) -> dict:
    """The tags of a TIFF's first image, read with ``read(place, bytes)``; raises ValueError on what is none."""
    start = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if order is None or len(start) < 8:
        raise ValueError("no TIFF file")
    big = struct.unpack(f"{order}H", start[2:4])[0]
    if big not in (42, 43):
        raise ValueError("no TIFF file")
    number, entry, word = ("H", 12, "I") if big == 42 else ("Q", 20, "Q")
    place = struct.unpack(f"{order}{word}", start[4:8] if big == 42 else start[8:16])[0]
    head = struct.calcsize(number)
    (count,) = struct.unpack(f"{order}{number}", read(place, head))
    raw = read(place + head, count * entry)
    if count > 4096 or len(raw) < count * entry:
        raise ValueError("its directory is cut off")
    out: dict = {"order": order}
    inline = struct.calcsize(word)
    for k in range(count):
        e = raw[k * entry : (k + 1) * entry]
        tag, kind = struct.unpack(f"{order}HH", e[:4])
        (n,) = struct.unpack(f"{order}{word}", e[4 : 4 + inline])
        if kind not in FIELD:
            continue
        size = FIELD[kind][0] * n
        data = e[4 + inline : 4 + inline + size] if size <= inline else read(struct.unpack(f"{order}{word}", e[4 + inline :])[0], size)
        if len(data) < size:
            raise ValueError("a tag is cut off")
        out[tag] = data if kind == 2 else struct.unpack(f"{order}{n}{FIELD[kind][1]}", data)
    return out


def profile(tags: dict) -> dict:
    """What there is to know of an image by its tags; raises ValueError on a kind that is not read here."""
    one = lambda tag, other=None: tags[tag][0] if tag in tags else other
    bands = one(SAMPLES, 1)
    kind = KINDS.get((one(SAMPLE_FORMAT, 1), one(BITS, 1)))
    if kind is None or len(set(tags.get(BITS, (0,)))) > 1:
        raise ValueError("its numbers are not of a kind that is read")
    if one(COMPRESSION, 1) not in (NONE_, *DEFLATE):
        raise ValueError(f"compression {one(COMPRESSION)} is not read")
    if one(PREDICTOR, 1) not in (1, 2) or (one(PREDICTOR, 1) == 2 and kind[0] == "f"):
        raise ValueError(f"predictor {one(PREDICTOR)} is not read")
    if WIDTH not in tags or HEIGHT not in tags or not (STRIPS in tags or TILES in tags):
        raise ValueError("it has no size or no strips")
    a = None
    if TRANSFORM in tags and len(tags[TRANSFORM]) == 16:
        m = tags[TRANSFORM]
        a = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy), (i, j, _, x, y) = tags[PIXEL_SCALE][:2], tags[TIE_POINT][:5]
        a = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    keys = tags.get(GEO_KEYS, ())
    geo = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    if a and geo.get(RASTER_TYPE) == 2:
        # the place named is the centre of a pixel
        a = (a[0], a[1], a[2] - a[0] / 2 - a[1] / 2, a[3], a[4], a[5] - a[3] / 2 - a[4] / 2)
    text = tags.get(NO_DATA, b"").rstrip(b"\0 ").decode("ascii", "replace")
    return {"height": one(HEIGHT), "width": one(WIDTH), "bands": bands, "dtype": kind, "transform": a, "epsg": geo.get(PROJECTED) or geo.get(GEOGRAPHIC), "nodata": float(text) if text else None}


def read_area(read: Callable[[int, int], bytes], tags: dict, p: dict, r0: int, c0: int, h: int, w: int) -> np.ndarray:
    """The numbers [h, w, bands] of an area of an image, from the strips or tiles under it."""
    tiled = TILES in tags
    th, tw = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(tags.get(ROWS, (p["height"],))[0], p["height"]), p["width"])
    places, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
    across, down = -(-p["width"] // tw), -(-p["height"] // th)
    planes = p["bands"] if tags.get(PLANAR, (1,))[0] == 2 else 1
    each = p["bands"] // planes
    dtype = np.dtype(p["dtype"]).newbyteorder(tags["order"])
    out = np.zeros((h, w, p["bands"]), dtype=dtype.newbyteorder("="))
    for plane in range(planes):
        for i in range(r0 // th, (r0 + h - 1) // th + 1):
            for j in range(c0 // tw, (c0 + w - 1) // tw + 1):
                k = (plane * down + i) * across + j
                raw = read(places[k], sizes[k])
                raw = raw if tags.get(COMPRESSION, (1,))[0] == NONE_ else zlib.decompress(raw)
                rows = th if tiled else min(th, p["height"] - i * th)
                a = np.frombuffer(raw, dtype, rows * tw * each).reshape(rows, tw, each)
                if tags.get(PREDICTOR, (1,))[0] == 2:
                    a = np.cumsum(a.astype(dtype.newbyteorder("=")), axis=1, dtype=dtype.newbyteorder("="))
                y0, x0, y1, x1 = max(r0, i * th), max(c0, j * tw), min(r0 + h, i * th + rows), min(c0 + w, j * tw + tw)
                out[y0 - r0 : y1 - r0, x0 - c0 : x1 - c0, plane * each : (plane + 1) * each] = a[y0 - i * th : y1 - i * th, x0 - j * tw : x1 - j * tw]
    return out


def _reader(f) -> Callable[[int, int], bytes]:
    def read(place: int, size: int) -> bytes:
        f.seek(place)
        return f.read(size)

    return read


PROFILE = "path string, img long, height long, width long, bands long, dtype string, transform array<double>, epsg long, nodata double, problem string"


def read_geotiff(spark: SparkSession, path: str, size: int = 512) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stacks, profile, rejects) of the GeoTIFF files of a folder tree or glob.

    ``stacks`` have all bands as 32-bit float channels (whole numbers beyond 2**24 are rounded) (``operators.stacks``; NaN where a band has its no-data value), in blocks of ``size`` pixels, each read by itself, so an image of any size is read by many tasks and is never one
    row; ``stacks.one_band`` takes one band as whole numbers. ``profile`` has path, stem, img (images are numbered by path), height, width, bands, dtype, a to f of the transform and epsg (null where the
    file does not say) and nodata. ``rejects`` has path and problem of files that are not read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    files = stage(prefix_sum(listed, ["path"], out="img"), "files")

    def look(batches):
        names = [f.split()[0] for f in PROFILE.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.list_(pa.float64()), pa.int64(), pa.float64(), pa.string()]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                where, name = file_system(r["path"])
                with where.open_input_file(name) as f:
                    try:
                        p = profile(header(_reader(f)))
                        rows.append((r["path"], r["img"], p["height"], p["width"], p["bands"], p["dtype"], p["transform"], p["epsg"], p["nodata"], None))
                    except (ValueError, struct.error) as problem:
                        rows.append((r["path"], r["img"], *(None,) * 7, str(problem)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names) if rows else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=names)

    found = stage(files.mapInArrow(look, PROFILE), "profile")
    good = found.where("problem is null")
    axis = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {size}")))
    grid = good.select("path", "img", "height", "width", axis("height").alias("i")).select("path", "img", "i", axis("width").alias("j"))
    # blocks of all images are dealt out evenly, near ones together
    grid = grid.repartitionByRange("img", "i", "j").sortWithinPartitions("img", "i", "j")

    def read(batches):
        last, f, read, tags, p = None, None, None, None, None
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["path"] != last:
                        if f:
                            f.close()
                        where, name = file_system(r["path"])
                        last, f = r["path"], where.open_input_file(name)
                        read = _reader(f)
                        tags = header(read)
                        p = profile(tags)
                    r0, c0 = r["i"] * size, r["j"] * size
                    a = read_area(read, tags, p, r0, c0, min(size, p["height"] - r0), min(size, p["width"] - c0)).astype(np.float32)
                    if p["nodata"] is not None:
                        a[a == np.float32(p["nodata"])] = np.nan
                    yield S._batch([S._row(r["img"], r["i"], r["j"], r0, c0, a)])
        finally:
            if f:
                f.close()

    known = good.select("path", stem(F.col("path")).alias("stem"), "img", "height", "width", "bands", "dtype", *[F.get("transform", F.lit(k)).alias(c) for k, c in enumerate("abcdef")], "epsg", "nodata")
    return grid.mapInArrow(read, S.STACK), known, found.where("problem is not null").select("path", "problem")

"""Folders of any number of files, listed and read by tasks: the driver holds no file's name. PNG files are decoded here, other kinds by Spark's image source."""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from tilewright.plans.staging import stage
from tilewright.sources.committed import file_system

IMAGE = "origin string, height int, width int, nChannels int, mode int, data binary"
#: Files that a task reads.
TASK_FILES = 2000
#: What is sent on at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signatures of what the image source may read besides.
OTHERS = (b"\xff\xd8", b"GIF8", b"BM", b"II*\0", b"MM\0*", b"\0\0")
#: Chunks that say nothing of the pixels.
PLAIN = {b"IHDR", b"IDAT", b"tEXt", b"zTXt", b"iTXt", b"tIME", b"pHYs"}
HEAD = 8192


def known_folder(path: str) -> bool:
    """Whether tasks can list a path themselves: a folder or file of one of Arrow's file systems, without a pattern."""
    if any(c in path for c in "*?[{"):
        return False
    try:
        where, name = file_system(path)
        return where.get_file_info(name).type != fs.FileType.NotFound
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def _seen(name: str) -> bool:
    return not name.startswith((".", "_"))


def _names(where: fs.FileSystem, folder: str):
    """The files right in a folder, or the file itself; as Spark's readers without hidden ones and without folders below."""
    info = where.get_file_info(folder)
    if info.type == fs.FileType.File:
        yield folder
    elif isinstance(where, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            yield from (f"{folder}/{e.name}" for e in found if _seen(e.name) and e.is_file())
    else:
        yield from (i.path for i in where.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File and _seen(i.base_name))


def _batches(rows, names: list[str], schema: pa.Schema, weight):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], names=names)


def listed_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path), staged: the files of folders, each folder listed by a task."""

    def run(batches):
        def rows():
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    where, folder = file_system(path)
                    # the same scheme in front as the folder has; a plain path is a file's
                    scheme = path[: path.index("://") + 3] if "://" in path else "file://" + ("/" if not folder.startswith("/") else "")
                    yield from ((scheme + name,) for name in _names(where, folder.rstrip("/")))

        yield from _batches(rows(), ["path"], pa.schema([("path", pa.string())]), lambda r: 0)

    folders = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 200))
    return stage(folders.mapInArrow(run, "path string"), "paths")


def _dealt(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, -(-files.count() // TASK_FILES)))


def _read(path: str, most: int | None = None) -> bytes:
    where, name = file_system(path)
    with where.open_input_stream(name) as f:
        return f.read() if most is None else f.read(most)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of the text files (UTF-8) of a folder, a file a row."""

    def run(batches):
        rows = ((p, _read(p).decode("utf-8", "replace")) for batch in batches for p in batch.column(0).to_pylist())
        yield from _batches(rows, ["path", "value"], pa.schema([("path", pa.string()), ("value", pa.string())]), lambda r: len(r[1]))

    return _dealt(listed_files(spark, [path])).mapInArrow(run, "path string, value string")


def _origin(path: str) -> str:
    """As the image source names a file: a URI, of which what no URI may hold is quoted."""
    return re.sub(r'[\x00-\x20"%<>\\^`{|}#?\[\]]', lambda m: f"%{ord(m[0]):02X}", path)


def kind_of(head: bytes) -> str:
    """By the beginning of a file: ``png`` for those that ``decoded_png`` takes, ``other`` for what the image source may read, ``none`` for no image."""
    if not head.startswith(SIGNATURE):
        return "other" if head.startswith(OTHERS) else "none"
    at = 8
    while at + 8 <= len(head):
        size, name = struct.unpack_from(">I", head, at)[0], head[at + 4 : at + 8]
        if name not in PLAIN:
            return "other"
        if name == b"IHDR":
            if at + 21 > len(head) or head[at + 16] != 8 or head[at + 17] not in (0, 2) or any(head[at + 18 : at + 21]):
                return "other"
        if name == b"IDAT":
            return "png"
        at += 12 + size
    return "other"


def decoded_png(body: bytes) -> tuple[int, int, int, bytes]:
    """(height, width, channels, data) of an 8-bit PNG file, grey or colour (as blue, green, red), without interlacing. Raises ValueError where it is broken."""
    at, pixels, shape = 8, [], None
    while at + 8 <= len(body):
        size, name = struct.unpack_from(">I", body, at)[0], body[at + 4 : at + 8]
        part = body[at + 8 : at + 8 + size]
        if len(part) < size or at + 12 + size > len(body) or zlib.crc32(name + part) != struct.unpack_from(">I", body, at + 8 + size)[0]:
            raise ValueError("a broken chunk")
        if name == b"IHDR":
            shape = *struct.unpack(">II", part[:8])[::-1], 3 if part[9] == 2 else 1
        elif name == b"IDAT":
            pixels.append(part)
        elif name == b"IEND":
            break
        at += 12 + size
    if shape is None or 0 in shape:
        raise ValueError("no header")
    h, w, n = shape
    try:
        raw = zlib.decompress(b"".join(pixels))
    except zlib.error as error:
        raise ValueError(str(error)) from error
    if len(raw) < h * (w * n + 1):
        raise ValueError("too few pixels")
    lines = np.frombuffer(raw, np.uint8, h * (w * n + 1)).reshape(h, w * n + 1)
    a = lines[:, 1:].reshape(h, w, n) if not lines[:, 0].any() else _unfiltered(lines, w, n)
    return h, w, n, a[:, :, ::-1].tobytes()


def _unfiltered(lines: np.ndarray, w: int, n: int) -> np.ndarray:
    h = len(lines)
    out = np.zeros((h, w, n), np.uint8)
    above = np.zeros((w, n), np.uint8)
    for r in range(h):
        kind, line = int(lines[r, 0]), lines[r, 1:].reshape(w, n)
        if kind == 0:
            now = line
        elif kind == 1:
            now = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            now = line + above
        elif kind in (3, 4):
            now = np.array(_of_neighbours(kind, line.tolist(), above.tolist(), n), np.uint8)
        else:
            raise ValueError(f"no filter: {kind}")
        out[r] = above = now
    return out


def _of_neighbours(kind: int, line: list, above: list, n: int) -> list:
    left, corner, out = [0] * n, [0] * n, []
    for x, up in zip(line, above, strict=True):
        if kind == 3:
            now = [(v + (a + b) // 2) & 255 for v, a, b in zip(x, left, up, strict=True)]
        else:
            now = []
            for v, a, b, c in zip(x, left, up, corner, strict=True):
                pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                now.append((v + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255)
        out.append(now)
        left, corner = now, up
    return out


def images_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Decoded images as Spark's image source gives them, broken ones with height -1.

    Tasks list the folders, and look at the beginning of each file: common PNG files are decoded in tasks, and so is what no reader knows (as broken). Only if
    there are files of other kinds does the image source, whose list of files is the driver's, read the folders too.
    """

    def look(batches):
        heads = ((p, _read(p, HEAD)) for batch in batches for p in batch.column(0).to_pylist())
        # the image source passes over empty files too
        rows = ((p, kind_of(head), _origin(p)) for p, head in heads if head)
        schema = pa.schema([(c, pa.string()) for c in ("path", "kind", "origin")])
        yield from _batches(rows, schema.names, schema, lambda r: 0)

    def one(p: str, kind: str) -> tuple:
        try:
            h, w, n, data = decoded_png(_read(p)) if kind == "png" else (-1, -1, -1, b"")
        except ValueError:
            h, w, n, data = -1, -1, -1, b""
        return _origin(p), h, w, n, {1: 0, 3: 16}.get(n, -1), data

    def decode(batches):
        rows = (one(p, k) for batch in batches for p, k in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        schema = pa.schema([("origin", pa.string()), *[(c, pa.int32()) for c in ("height", "width", "nChannels", "mode")], ("data", pa.binary())])
        yield from _batches(rows, schema.names, schema, lambda r: len(r[5]))

    files = stage(_dealt(listed_files(spark, paths)).mapInArrow(look, "path string, kind string, origin string"), "files")
    own = _dealt(files.where("kind <> 'other'").select("path", "kind")).mapInArrow(decode, IMAGE)
    others = files.where("kind = 'other'").select("origin")
    if others.isEmpty():
        return own
    return own.unionByName(source_images(spark, paths).join(others, "origin", "left_semi"))


def source_images(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", "false").load(paths).select("image.*")

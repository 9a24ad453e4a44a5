"""Writers: manifests, GeoJSON features, box tables, annotation records, text lists."""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.plans.staging import stage
from tilewright.sources.committed import write_committed_files, write_ordered_lines


def write_manifest(df: DataFrame, path: str) -> None:
    """JSON lines in one folder for each split."""
    df.write.partitionBy("split").json(path)


def manifest_lines(df: DataFrame, name: str, prefix: str) -> DataFrame:
    """(order, value): a manifest (split, pos, image, label, probability) as the lines of one YAML document, a row a line.

    Texts are written as JSON strings, which YAML reads; null labels and probabilities as null.
    """
    head = df.sparkSession.createDataFrame([("0", 0, f"name: {json.dumps(name)}"), ("1", 0, f"prefix: {json.dumps(prefix)}")], "section string, pos long, value string")
    out = head
    splits = df.select("split").distinct()
    out = out.unionByName(splits.select(F.concat(F.lit("2"), "split").alias("section"), F.lit(-1).cast("long").alias("pos"), F.concat("split", F.lit(":")).alias("value")))
    for k, (column, key) in enumerate((("image", "images"), ("label", "labels"), ("probability", "probability"))):
        if column not in df.columns:
            continue
        section = F.concat(F.lit("2"), "split", F.lit(f"/{k}"))
        out = out.unionByName(splits.select(section.alias("section"), F.lit(-1).cast("long").alias("pos"), F.lit(f"  {key}:").alias("value")))
        item = F.coalesce(F.to_json(F.array(column)).substr(F.lit(2), F.length(F.to_json(F.array(column))) - 2), F.lit("null"))
        out = out.unionByName(df.select(section.alias("section"), F.col("pos").cast("long").alias("pos"), F.concat(F.lit("    - "), item).alias("value")))
    return out


def write_manifest_yaml(df: DataFrame, path: str, name: str, prefix: str, files: int | None = None) -> None:
    """One YAML document of a dataset, as text files that give it when put together in the order of their names; ``files=1`` writes one."""
    lines = manifest_lines(df, name, prefix)
    ordered = lines.orderBy("section", "pos") if files is None else lines.repartitionByRange(files, "section", "pos").sortWithinPartitions("section", "pos")
    ordered.select("value").write.text(path)


def write_manifest_document(df: DataFrame, path: str, name: str, prefix: str, overwrite: bool = False) -> None:
    """One YAML document of a dataset, written by many tasks and committed as a whole; ``sources.documents.read_large_manifests`` reads it."""
    write_ordered_lines(manifest_lines(df, name, prefix), path, ["section", "pos"], overwrite=overwrite)


def png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """An 8-bit PNG file of 1 (grey) or 3 channels (blue, green, red, as images are decoded)."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)[:, :, ::-1]
    raw = np.concatenate([np.zeros((height, 1), np.uint8), a.reshape(height, width * channels)], axis=1).tobytes()

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def write_files(files: DataFrame, path: str) -> DataFrame:
    """Write a file for each row (name, body) into a folder that all tasks share; (name, bytes) of what was written.

    A file is written whole under another name and then moved, so a repeated task leaves the same files. ``path`` is a URI that
    Arrow's file systems know (file, hdfs, s3, gs).
    """

    def run(batches):
        where, folder = fs.FileSystem.from_uri(path)
        where.create_dir(folder, recursive=True)
        for batch in batches:
            names, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, body in zip(names, bodies, strict=True):
                own = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with where.open_output_stream(own) as f:
                    f.write(body)
                where.move(own, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(b) for b in bodies], pa.int64())], names=["name", "bytes"])

    return stage(files.select("name", F.col("body").cast("binary")).mapInArrow(run, "name string, bytes long"), "written")


def write_images(images: DataFrame, path: str) -> DataFrame:
    """Write a PNG file for each row (name, height, width, nChannels, data): tiles, masks (one channel), flipped and predicted images alike; see ``write_files``."""
    return write_files(_encoded(images), path)


def _encoded(images: DataFrame) -> DataFrame:
    """(name, body) of images as PNG files."""

    def encoded(batches):
        for batch in batches:
            rows = batch.to_pylist()
            names, bodies = [f"{r['name']}.png" for r in rows], [png(r["height"], r["width"], r["nChannels"], r["data"]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["name", "body"])

    return images.select("name", "height", "width", "nChannels", "data").mapInArrow(encoded, "name string, body binary")


def write_committed_images(images: DataFrame, path: str, overwrite: bool = False) -> None:
    """Like ``write_images``, but a job's files are seen all together or not at all: ``sources.committed.committed_parts`` names their folders."""
    write_committed_files(_encoded(images), path, overwrite)


def block_images(blocks: DataFrame, prefix: str = "block") -> DataFrame:
    """Rows for ``write_images`` of raster blocks with values 0 to 255, one grey image a block; no pixel is 0."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], np.int32)
                name = f"{prefix}_{r['img']}_{r['block_row']}_{r['block_col']}"
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (name, r["h"], r["w"], 1, np.where(a < 0, 0, a).astype(np.uint8).tobytes())], names=["name", "height", "width", "nChannels", "data"])

    return blocks.mapInArrow(run, "name string, height long, width long, nChannels long, data binary")


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """One graph text document: vertex lines (idx, x, y), a blank line, edge lines (no, src, dst), in order; written by many tasks and committed as a whole, see ``sources.committed``."""
    blank = vertices.sparkSession.createDataFrame([(1, 0, "")], "part int, place long, value string")
    v = vertices.select(F.lit(0).alias("part"), F.col("idx").alias("place"), F.concat_ws(" ", "x", "y").alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.col("no").alias("place"), F.concat_ws(" ", "src", "dst").alias("value"))
    write_ordered_lines(v.union(blank).union(e), path, ["part", "place"])


KINDS = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")


def geometry_json(kind: Column, parts: Column, polygons: Column | None = None) -> Column:
    """A geometry as GeoJSON text, by its kind; columns as ``read_features`` gives them: parts an array of point arrays, polygons an array of polygons, each
    its outer ring and then its holes. Rings are closed. A Polygon without ``polygons`` takes all parts as its rings; a null or empty geometry is null, an unknown kind raises.
    """
    none = F.lit(None).cast("array<array<array<struct<x:double,y:double>>>>")
    areas = F.coalesce(none if polygons is None else polygons, F.when(kind == "Polygon", F.array(parts)))
    xy = lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))
    line = lambda points: F.transform(points, xy)
    ring = lambda points: line(F.concat(points, F.slice(points, 1, 1)))
    rings = lambda polygon: F.transform(polygon, ring)
    first = F.get(parts, F.lit(0))
    some = F.size(parts) > 0 if polygons is None else (F.size(parts) > 0) | (F.size(polygons) > 0)
    text = (
        F.when(kind == "Point", F.to_json(xy(F.get(first, F.lit(0)))))
        .when(kind == "MultiPoint", F.to_json(F.transform(parts, lambda p: xy(p[0]))))
        .when(kind == "LineString", F.to_json(line(first)))
        .when(kind == "MultiLineString", F.to_json(F.transform(parts, line)))
        .when(kind == "Polygon", F.to_json(rings(F.get(areas, F.lit(0)))))
        .when(kind == "MultiPolygon", F.to_json(F.transform(areas, rings)))
        .otherwise(F.raise_error(F.concat(F.lit("no GeoJSON geometry: "), kind)).cast("string"))
    )
    return F.when(some & kind.isNotNull(), F.concat(F.lit('{"coordinates":'), text, F.lit(',"type":"'), kind, F.lit('"}')))


def feature(properties: list[str], ring: Column | None = None, kind: Column | None = None, parts: Column | None = None, polygons: Column | None = None) -> Column:
    """One GeoJSON Feature as text, keys sorted: of a simple ring, or of a geometry of any kind; a null one is a null geometry."""
    geometry = geometry_json(F.lit("Polygon"), F.when(ring.isNotNull(), F.array(ring))) if ring is not None else geometry_json(kind, parts, polygons)
    said = F.to_json(F.struct(*sorted(properties)), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":'), said, F.lit(',"type":"Feature"}'))


def _feature_of(df: DataFrame, properties: list[str], ring: str) -> Column:
    """By column ``ring``, or by columns kind, parts and, if there, polygons."""
    if ring in df.columns:
        return feature(properties, F.col(ring))
    return feature(properties, kind=F.col("kind"), parts=F.col("parts"), polygons=F.col("polygons") if "polygons" in df.columns else None)


def crs_json(epsg: int) -> str:
    return json.dumps({"properties": {"name": f"urn:ogc:def:crs:EPSG::{epsg}"}, "type": "name"}, separators=(",", ":"))


def write_geojson(df: DataFrame, path: str, properties: list[str], epsg: int, ring: str = "ring") -> None:
    """One Feature a line, of simple rings or of geometries of any kind (kind, parts, polygons); the coordinate system in a folder beside."""
    df.select(_feature_of(df, properties, ring).alias("value")).write.text(path)
    crs = df.sparkSession.createDataFrame([('{"crs":' + crs_json(epsg) + "}",)], "value string")
    crs.coalesce(1).write.text(path.rstrip("/") + ".crs")


def write_feature_collection(df: DataFrame, path: str, properties: list[str], epsg: int, key: str, ring: str = "ring") -> None:
    """One GeoJSON document with its coordinate system and the features in the order of ``key`` (unique, not null), as text files by many tasks that give it when put together in the order of their names."""
    spark = df.sparkSession
    first = df.agg(F.min(key)).first()[0]
    lines = df.select(F.lit(1).alias("section"), F.col(key).alias("place"), F.concat(F.when(F.col(key) == F.lit(first), F.lit("")).otherwise(F.lit(",")), _feature_of(df, properties, ring)).alias("value"))
    kind = df.schema[key].dataType
    ends = spark.createDataFrame([(0, '{"crs":' + crs_json(epsg) + ',"features":['), (2, '],"type":"FeatureCollection"}')], "section int, value string").select("section", F.lit(None).cast(kind).alias("place"), "value")
    lines.unionByName(ends).orderBy("section", "place").select("value").write.text(path)


def box_rows(boxes: DataFrame, folder: str) -> DataFrame:
    """filepath, x1, y1, x2, y2, class_name."""
    return boxes.select(F.concat_ws("/", F.lit(folder), "img_name").alias("filepath"), "x1", "y1", "x2", "y2", F.col("category").alias("class_name"))


def write_boxes(boxes: DataFrame, folder: str, path: str) -> None:
    box_rows(boxes, folder).write.csv(path, header=False, quote="|", emptyValue="", nullValue="")


def class_mapping(boxes: DataFrame) -> DataFrame:
    """(name, index) of the classes in ascending order; as many rows as classes."""
    from pyspark.sql import Window

    return boxes.select(F.col("category").alias("name")).distinct().withColumn("index", F.row_number().over(Window.orderBy("name")) - 1)


def write_records(records: DataFrame, path: str) -> None:
    records.write.json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)

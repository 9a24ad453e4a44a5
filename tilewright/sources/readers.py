"""Readers of manifests, annotations, features, tables, graphs and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.blocks import image_blocks
from tilewright.operators.manifests import file_name, stem
from tilewright.operators.raster import resize_images
from tilewright.plans.order import prefix_sum
from tilewright.sources.committed import text_lines
from tilewright.sources.images import images_of, known_folder, read_texts, source_images

BOX = "array<struct<category:string,x1:string,x2:string,y1:string,y2:string>>"
SPLITS = ("training", "validation", "testing")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Long rows of YAML or JSON manifests (name, prefix, splits with images, labels, probability), by split and position.

    One document is one row of the reader, parsed in Arrow batches; a broken one raises with its path.
    """
    import json

    import pandas as pd

    def parse(texts: pd.Series) -> pd.Series:
        import yaml

        def one(t):
            d = yaml.safe_load(t) or {}
            parts = [{"split": s, "images": (d.get(s) or {}).get("images") or [], "labels": (d.get(s) or {}).get("labels") or [], "probability": (d.get(s) or {}).get("probability") or []} for s in SPLITS]
            return json.dumps({"name": d.get("name"), "prefix": d.get("prefix"), "parts": parts})

        return texts.map(one)

    parse.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    kind = "struct<name:string,prefix:string,parts:array<struct<split:string,images:array<string>,labels:array<string>,probability:array<double>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json(F.pandas_udf(parse, "string")("value"), kind).alias("m"))
    part = raw.select("m.name", "m.prefix", F.explode("m.parts").alias("p"))
    rows = part.select(F.col("name").alias("dataset"), "prefix", "p.split", F.posexplode(F.arrays_zip("p.images", "p.labels", "p.probability")).alias("pos", "z"))
    return rows.select("dataset", "prefix", "split", F.col("pos").cast("long").alias("pos"), F.col("z.images").alias("image"), F.col("z.labels").alias("label"), "z.probability")


def list_files(spark: SparkSession, folder: str, ext: str) -> DataFrame:
    """(path, stem, length) of the files of a folder tree; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ext}").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", stem(F.col("path")).alias("stem"), "length")


def read_images(spark: SparkSession, path: str | list[str], channel: int | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """Decoded images (origin, height, width, nChannels, mode, data), broken ones with height -1.

    With ``channel`` only that one is kept, with ``size`` (height, width) images are resized; both leave broken images out. Folders are listed and read
    by tasks (``sources.images``) where Arrow knows their file system; paths with patterns, and those of other file systems, are read by Spark's image source.
    """
    paths = [path] if isinstance(path, str) else path
    images = images_of(spark, paths) if paths and all(map(known_folder, paths)) else source_images(spark, paths)
    if channel is not None:

        def one(batches):
            for b in batches:
                b = b[b.nChannels > channel]
                yield b.assign(data=[bytes(d[channel::n]) for d, n in zip(b.data, b.nChannels)], nChannels=1, mode=0)

        images = images.where("height > 0").mapInPandas(one, images.schema)
    return images if size is None else resize_images(images, *size)


def read_world_files(spark: SparkSession, path: str) -> DataFrame:
    """(stem, a, b, c, d, e, f): affine transforms of world files, from the centre of the first pixel to its corner."""
    v = F.transform(F.filter(F.split("value", "\\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    texts = read_texts(spark, path) if known_folder(path) else spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    t = texts.select(stem(F.col("path")).alias("stem"), v.alias("v"))
    a, d, b, e, x, y = (F.get("v", F.lit(k)) for k in range(6))
    return t.select("stem", a.alias("a"), b.alias("b"), (x - a / 2 - b / 2).alias("c"), d.alias("d"), e.alias("e"), (y - d / 2 - e / 2).alias("f"))


def read_raster(spark: SparkSession, path: str, profile: DataFrame, channel: int = 0, size: int = 512) -> tuple[DataFrame, DataFrame]:
    """(blocks, profile) of one band of 8-bit images.

    ``profile`` has stem, img (a number for each image) and whatever else is known of it, such as a world file's transform; it comes back
    with height, width and bands. Images are decoded one a row and cut into blocks without a shuffle; broken ones have none. Large mosaics must come tiled.
    """
    found = read_images(spark, path).where("height > 0").withColumn("stem", stem(F.col("origin"))).join(profile, "stem")
    known = found.select(*profile.columns, "height", "width", F.col("nChannels").alias("bands"))
    return image_blocks(found, size, channel), known


def read_patch_metadata(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Patch records of JSON lines with ``rank``, the place of each, from 0, by sorted key; equal keys in an arbitrary way."""
    return prefix_sum(spark.read.schema(schema).json(path), [key], out="rank")


def bad_images(spark: SparkSession, path: str) -> DataFrame:
    """Images that do not decode or have not three channels."""
    return read_images(spark, path).where("height = -1 or nChannels <> 3").select("origin", "height", "nChannels")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Box rows (img_name, category, x1, y1, x2, y2); an empty coordinate is null."""
    d = spark.read.schema(f"img_name string, bboxes {BOX}").json(path)
    b = d.select("img_name", F.explode_outer("bboxes").alias("b"))
    return b.select("img_name", "b.category", *[F.expr(f"try_cast(b.{c} as int)").alias(c) for c in ("x1", "y1", "x2", "y2")])


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(name, tag, points) of labelling tasks. A document is one row of the reader, each object a row of its own that carries no more than its task's name."""
    kind = "tasks array<struct<name:string,Tags:struct<tags:array<struct<tags:struct<tag:string,points:array<array<double>>>>>>>>"
    t = spark.read.schema(kind).json(path, multiLine=True).select(F.explode("tasks").alias("t")).select("t.name", F.col("t.Tags.tags").alias("objects"))
    return t.select("name", F.explode("objects").alias("g")).select("name", "g.tags.tag", F.transform("g.tags.points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("points"))


def read_features(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """Features of GeoJSON documents: properties, kind, parts and polygons (null geometry: both null).

    ``parts`` is an array of point arrays: the point, the lines, or all rings. ``polygons`` keeps them apart: an array of polygons, each its
    outer ring and then its holes; null for points and lines. A document is one row of the reader; with ``lines`` each line is a
    Feature of its own (as ``write_geojson`` writes them), and large files are split.
    """
    if lines:
        return parsed_features(spark.read.text(path), properties)
    kind = FEATURE.format(properties)
    return _features(spark.read.schema(f"features array<{kind}>").json(path, multiLine=True).select(F.explode("features").alias("f")))


FEATURE = "struct<properties:struct<{}>,geometry:struct<type:string,coordinates:string>>"


def parsed_features(texts: DataFrame, properties: str) -> DataFrame:
    """The features of JSON texts (value), one each, as ``read_features`` gives them."""
    return _features(texts.select(F.from_json("value", FEATURE.format(properties)).alias("f")))


def _features(f: DataFrame) -> DataFrame:
    c, k = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    xy = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    # rings close themselves here, so a last point that repeats the first goes
    ring = lambda r: F.when((F.size(r) > 1) & (F.get(r, F.lit(0)) == F.element_at(r, -1)), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r)
    many = lambda a: F.transform(a, lambda line: F.transform(line, xy))
    rings = lambda a: F.transform(many(a), ring)
    polygons = F.when(k == "Polygon", F.array(rings(F.from_json(c, "array<array<array<double>>>")))).when(k == "MultiPolygon", F.transform(F.from_json(c, "array<array<array<array<double>>>>"), rings))
    parts = (
        F.when(k == "Point", F.array(F.array(xy(F.from_json(c, "array<double>")))))
        .when(k == "MultiPoint", F.transform(F.from_json(c, "array<array<double>>"), lambda p: F.array(xy(p))))
        .when(k == "LineString", F.array(F.transform(F.from_json(c, "array<array<double>>"), xy)))
        .when(k == "MultiLineString", many(F.from_json(c, "array<array<array<double>>>")))
        .when(k.isin("Polygon", "MultiPolygon"), F.flatten("polygons"))
    )
    return f.withColumn("polygons", polygons).select("f.properties.*", k.alias("kind"), parts.alias("parts"), "polygons")


def read_stats(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header, quote="|")


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("url"), file_name(F.trim("value")).alias("name"))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """Category table; missing columns get their defaults, cells are trimmed."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    cell = lambda n, kind, other: F.coalesce(F.expr(f"try_cast(trim(`{n}`) as {kind})"), F.lit(other)) if n in raw.columns else F.lit(other).cast(kind)
    return raw.select(cell("pixel_value", "int", None).alias("pixel_value"), F.trim("category_name").alias("category_name"), (cell("vectorize", "int", 1) != 0).alias("vectorize"), (cell("bbox_flag", "int", None) != 0).alias("bbox_flag"), cell("kernel_size", "int", None).alias("kernel_size"), cell("min_area", "double", None).alias("min_area"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices graph, idx, x, y; edges graph, no, src, dst) of graph text files, or of one committed in parts: vertex lines, a blank line, edge lines.

    Lines are numbered over all files by file, block and place, so that a large file is read in blocks by many tasks; the first
    blank line of a file divides it. Further blank lines count as nothing.
    """
    raw = text_lines(spark, path).withColumnRenamed("document", "graph")
    lines = prefix_sum(raw, ["graph", "part", "block", "place"], out="_at").drop("part", "block", "place")
    blank = F.trim("value") == ""
    bounds = lines.groupBy("graph").agg(F.min("_at").alias("_first"), F.min(F.when(blank, F.col("_at"))).alias("_blank"))
    known = lines.where(~blank).join(bounds, "graph")
    pair = F.split(F.trim("value"), "\\s+")
    v = known.where(F.coalesce(F.col("_at") < F.col("_blank"), F.lit(True)))
    e = known.where(F.col("_at") > F.col("_blank"))
    vertices = v.select("graph", (F.col("_at") - F.col("_first")).alias("idx"), pair[0].cast("long").alias("x"), pair[1].cast("long").alias("y"))
    return vertices, e.select("graph", (F.col("_at") - F.col("_blank") - 1).alias("no"), pair[0].cast("long").alias("src"), pair[1].cast("long").alias("dst"))

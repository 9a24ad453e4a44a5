"""Queries of readers and writers, which write files in the shared folder and read them back, and of jobs built on windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.operators import blocks as B
from tilewright.operators import manifests, tilejob, windows
from tilewright.operators.graph import graph_to_lines, lines_to_graph
from tilewright.operators.scoring import predict_overlapping, predict_stitched
from tilewright.plans.order import prefix_sum
from tilewright.plans.staging import scratch_dir
from tilewright.queries.catalog import ENDS, as_rings, query
from tilewright.sources import documents, readers, sinks
from tilewright.sources.committed import committed_parts


def folder(df, label: str) -> str:
    return f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"


# --- images -----------------------------------------------------------------------------------------
def thumbs(s):
    """A small image for each id: 8 x 8 pixels of three channels, every seventh grey."""
    channels = F.when(F.col("img_id") % 7 == 0, 1).otherwise(3)
    value = lambda k: (F.col("img_id") * 31 + F.floor(k / F.col("n") / 8) * 8 + F.floor(k / F.col("n")) % 8 * 3 + k % F.col("n") * 50) % 256
    d = s.select("img_id", channels.alias("n"))
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), 64 * F.col("n") - 1), lambda k: F.lpad(F.hex(value(k).cast("long")), 2, "0")), ""))
    return d.select(F.format_string("t%d", "img_id").alias("name"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("n").alias("nChannels"), data.alias("data"))


def dealt(s):
    """Ids dealt out by their number: a row is a file to write, however few bytes the table has."""
    return s.select("img_id").repartition(max(1, -(-s.count() // 5000)))


def written(s) -> str:
    """A folder of the images; every eleventh file is no image."""
    path, s = folder(s, "images"), dealt(s)
    sinks.write_images(thumbs(s.where("img_id % 11 <> 0")), path)
    sinks.write_files(s.where("img_id % 11 = 0").select(F.format_string("t%d.png", "img_id").alias("name"), F.lit("no image").alias("body")), path)
    return path


def number(c):
    return F.substring(manifests.stem(c), 2, 20).cast("long")


PX = "px AS (SELECT img_id, (img_id * 31 + r.range * 8 + c.range * 3 + k.range * 50) % 256 AS v, r.range AS r, c.range AS c, k.range AS k FROM sizes, range(8) r, range(8) c, range(3) k WHERE img_id % 11 <> 0 AND (img_id % 7 <> 0 OR k.range = 0))"


@query("k7_images", "sizes", sql="SELECT img_id, CASE WHEN img_id % 11 = 0 THEN -1 ELSE 8 END AS height, CASE WHEN img_id % 11 = 0 THEN -1 WHEN img_id % 7 = 0 THEN 1 ELSE 3 END AS channels FROM sizes")
def _(s):
    return readers.read_images(s.sparkSession, written(s)).select(number(F.col("origin")).alias("img_id"), "height", F.col("nChannels").alias("channels"))


def means(images, name: str):
    found = images.withColumn("img", number(F.col("origin")))
    return B.image_stats(B.image_blocks(found, 8)).select(F.col("img").alias("img_id"), F.round("mean", 6).alias(name))


@query("s4_channel", "sizes", sql=f"WITH {PX} SELECT img_id, round(avg(v), 6) AS mean FROM px WHERE k = 1 GROUP BY 1")
def _(s):
    return means(readers.read_images(s.sparkSession, written(s), channel=1), "mean")


@query("s4_resized", "sizes", sql=f"WITH {PX}, q AS (SELECT img_id, r // 2 AS r, c // 2 AS c, floor(avg(v) + 0.5) AS v FROM px WHERE k = 0 GROUP BY 1, 2, 3) SELECT img_id, round(avg(v), 6) AS mean FROM q GROUP BY 1")
def _(s):
    return means(readers.read_images(s.sparkSession, written(s), channel=0, size=(4, 4)), "mean")


@query("s3_files", "sizes", sql="SELECT 't' || img_id AS stem FROM sizes")
def _(s):
    return readers.list_files(s.sparkSession, written(s), ".png").select("stem")


@query("s14_bad_images", "sizes", sql="SELECT img_id FROM sizes WHERE img_id % 11 = 0 OR img_id % 7 = 0")
def _(s):
    return readers.bad_images(s.sparkSession, written(s)).select(number(F.col("origin")).alias("img_id"))


@query("s12_raster", "sizes", sql=f"WITH {PX} SELECT img_id, any_value(CASE WHEN img_id % 7 = 0 THEN 1 ELSE 3 END) AS bands, CAST(any_value(img_id) AS DOUBLE) AS c, CAST(any_value(1000 - img_id) AS DOUBLE) AS f, round(avg(v), 6) AS mean FROM px WHERE k = 0 GROUP BY 1")
def _(s):
    world = folder(s, "world")
    lines = F.concat_ws("\n", F.lit("0.5"), F.lit("0"), F.lit("0"), F.lit("-0.5"), (F.col("img_id") + 0.25).cast("string"), (1000 - F.col("img_id") - 0.25).cast("string"))
    sinks.write_files(dealt(s).select(F.format_string("t%d.pgw", "img_id").alias("name"), lines.alias("body")), world)
    profile = readers.read_world_files(s.sparkSession, world).withColumn("img", F.substring("stem", 2, 20).cast("long"))
    blocks, known = readers.read_raster(s.sparkSession, written(s), profile, 0, 8)
    return B.image_stats(blocks).join(known, "img").select(F.col("img").alias("img_id"), "bands", "c", "f", F.round("mean", 6).alias("mean"))


@query("k7_block_images", "pixels", sql="SELECT img, round(avg(v1), 6) AS mean FROM pixels GROUP BY 1")
def _(p):
    path = folder(p, "blocks")
    sinks.write_images(sinks.block_images(B.to_blocks(p, "v1", 50)), path)
    found = readers.read_images(p.sparkSession, path)
    found = found.withColumn("img", F.split(manifests.stem(F.col("origin")), "_")[1].cast("long"))
    full = B.image_stats(B.image_blocks(found, 50)).select("img", "n", "mean")
    # the last image may be short of pixels, which are black in the file
    real = p.groupBy("img").agg(F.count("*").alias("real"))
    return full.join(real, "img").select("img", F.round(F.col("mean") * F.col("n") / F.col("real"), 6).alias("mean"))


# --- tables and documents ------------------------------------------------------------------------------
@query("s1_manifest", "manifest", sql="SELECT 'set' AS dataset, '/data' AS prefix, CASE WHEN pos % 3 = 0 THEN 'validation' ELSE 'training' END AS split, row_number() OVER (PARTITION BY pos % 3 = 0 ORDER BY pos) - 1 AS pos, image, label FROM manifest")
def _(m):
    path = folder(m, "manifest")
    sinks.write_manifest_document(m.withColumn("split", F.when(F.col("pos") % 3 == 0, "validation").otherwise("training")), path, "set", "/data")
    return documents.read_large_manifests(m.sparkSession, path)[0].select("dataset", "prefix", "split", "pos", "image", "label")


@query("k1_manifest_splits", "manifest", sql="SELECT CASE WHEN pos % 3 = 0 THEN 'validation' ELSE 'training' END AS split, pos, image FROM manifest")
def _(m):
    path = folder(m, "manifest")
    sinks.write_manifest(m.withColumn("split", F.when(F.col("pos") % 3 == 0, "validation").otherwise("training")), path)
    return m.sparkSession.read.json(path).select("split", "pos", "image")


@query("s5_annotations", "boxes", sql="SELECT img_name, category, x1, y1, x2, y2 FROM boxes")
def _(b):
    path = folder(b, "records")
    sinks.write_records(manifests.records(b, b.select("img_name").distinct()), path)
    return readers.read_annotations(b.sparkSession, path).select("img_name", "category", *[F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("s6_tasks", "boxes", sql="SELECT img_name AS name, category AS tag, CAST(x1 AS DOUBLE) AS x1, CAST(y2 AS DOUBLE) AS y2 FROM boxes")
def _(b):
    points = F.array(*[F.array(F.col(x).cast("double"), F.col(y).cast("double")) for x, y in (("x1", "y1"), ("x1", "y2"), ("x2", "y2"))])
    tags = F.collect_list(F.struct(F.struct(F.col("category").alias("tag"), points.alias("points")).alias("tags")))
    # an image's boxes in as many documents as the table needs, so that no row holds a share of the whole table
    tasks = b.groupBy(F.col("img_name").alias("name"), F.floor(F.col("box_id") / 100_000).alias("d")).agg(F.struct(tags.alias("tags")).alias("Tags"))
    path = folder(b, "tasks")
    sinks.write_files(tasks.select(F.concat("name", F.lit("_"), "d", F.lit(".json")).alias("name"), F.to_json(F.struct(F.array(F.struct("name", "Tags")).alias("tasks"))).alias("body")), path)
    return readers.read_tasks(b.sparkSession, path).select("name", "tag", F.get("points", F.lit(0))["x"].alias("x1"), F.get("points", F.lit(1))["y"].alias("y2"))


@query("s7_features", "parcels", sql="SELECT id, 'Polygon' AS kind, 4 AS corners, CAST((maxx - minx) * (maxy - miny) AS DOUBLE) AS area FROM parcels")
def _(p):
    path = folder(p, "features")
    sinks.write_geojson(as_rings(p), path, ["id"], 32632)
    return readers.read_features(p.sparkSession, path, "id:bigint", lines=True).select("id", "kind", F.size(F.flatten("parts")).alias("corners"), G.polygon_area(F.col("polygons")).alias("area"))


@query("s7_feature_collection", "parcels", sql="SELECT id, 'Polygon' AS kind, 4 AS corners, CAST((maxx - minx) * (maxy - miny) AS DOUBLE) AS area FROM parcels")
def _(p):
    """One document of one line, which tasks read by byte ranges of 4 KB."""
    path = folder(p, "collection")
    text = F.array_join(F.array_sort(F.collect_list(sinks.feature(["id"], F.col("ring")))), ", ")
    # a document for every 50 features, so that no row holds the whole table
    docs = as_rings(p).groupBy(F.floor(F.col("id") / 50).alias("d")).agg(F.concat(F.lit('{"name": "not { a [ feature", "features": ['), text, F.lit(' ], "type": "FeatureCollection"}')).alias("body"))
    sinks.write_files(docs.select(F.format_string("d%d.geojson", "d").alias("name"), "body"), path)
    found, _ = documents.read_feature_collections(p.sparkSession, path, "id:bigint", chunk=4096)
    return found.select("id", "kind", F.size(F.flatten("parts")).alias("corners"), G.polygon_area(F.col("polygons")).alias("area"))


@query("k7_committed_images", "sizes", sql="SELECT img_id, 8 AS height, CASE WHEN img_id % 7 = 0 THEN 1 ELSE 3 END AS channels FROM sizes")
def _(s):
    path = folder(s, "committed")
    sinks.write_committed_images(thumbs(dealt(s)), path)
    return readers.read_images(s.sparkSession, committed_parts(path)).select(number(F.col("origin")).alias("img_id"), "height", F.col("nChannels").alias("channels"))


@query("s8_stats", "mask_stats", sql="SELECT filename, roads, background FROM mask_stats")
def _(m):
    path = folder(m, "stats")
    m.select("filename", "roads", "background").write.csv(path, header=True, quote="|")
    return readers.read_stats(m.sparkSession, path, "filename string, roads long, background long")


@query("s9_urls", "url_list", sql="SELECT url, split_part(url, '/', -1) AS name FROM url_list")
def _(u):
    path = folder(u, "urls")
    sinks.write_lines(u, "url", path)
    return readers.read_urls(u.sparkSession, path)


@query("s10_categories", "boxes", sql="SELECT DISTINCT CAST(substr(category, 1, 1) AS INTEGER) AS pixel_value, category AS category_name, TRUE AS vectorize, CAST(NULL AS DOUBLE) AS min_area FROM boxes")
def _(b):
    path = folder(b, "categories")
    b.select(F.substring("category", 1, 1).alias("pixel_value"), F.col("category").alias("category_name")).distinct().write.csv(path, header=True)
    return readers.read_categories(b.sparkSession, path).select("pixel_value", "category_name", "vectorize", "min_area")


@query("s11_graph", "lines", sql=f"WITH {ENDS} SELECT x0, y0, x1, y1 FROM lines")
def _(x):
    v, e = lines_to_graph(x)
    one = x.select("line_id", *[F.col(c).cast("long") for c in ("x0", "y0", "x1", "y1")])
    a = v.select(F.col("idx").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    b = v.select(F.col("idx").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    both = one.join(a, ["x0", "y0"]).join(b, ["x1", "y1"])
    # each line gives two edges, one behind the other
    edges = both.select((F.col("line_id") * 2).alias("k"), "src", "dst").union(both.select(F.col("line_id") * 2 + 1, "dst", "src"))
    path = folder(x, "graph")
    sinks.write_graph(v, prefix_sum(edges, ["k"], out="no"), path)
    return graph_to_lines(*[d.drop("graph") for d in readers.read_graph(x.sparkSession, path)]).select("x0", "y0", "x1", "y1")


@query("s13_patch_metadata", "mask_stats", sql="SELECT filename AS patch, roads, row_number() OVER (ORDER BY filename) - 1 AS rank FROM mask_stats")
def _(m):
    path = folder(m, "metadata")
    sinks.write_records(m.select(F.col("filename").alias("patch"), "roads"), path)
    return readers.read_patch_metadata(m.sparkSession, path, "patch string, roads long", "patch")


@query("k3_box_csv", "boxes", sql="SELECT concat('data/', img_name) AS filepath, x1, y1, x2, y2, category AS class_name FROM boxes")
def _(b):
    path = folder(b, "boxes")
    sinks.write_boxes(b, "data", path)
    return readers.read_stats(b.sparkSession, path, "filepath string, x1 long, y1 long, x2 long, y2 long, class_name string", header=False)


# --- windows and whole jobs ----------------------------------------------------------------------------
AXIS = "SELECT img_id, {x} AS x1, {y} AS y1, {x} + 181 AS x2, {y} + 120 AS y2 FROM sizes JOIN range(80) x ON {x0} + x.range * 90 < w - {right} - 83 JOIN range(80) y ON {y0} + y.range * 90 < h - {bottom} - 87 {where}"
INSIDE = "WHERE w > 181 AND h > 120"


@query("w1_boundary", "sizes", sql=AXIS.format(x="27 + x.range * 90", y="33 + y.range * 90", x0=27, y0=33, right=10 + 181, bottom=5 + 120, where=INSIDE))
def _(s):
    return windows.window_boxes(s, 181, 120, 90, (7, 3), boundary=(20, 30, 10, 5))


@query("w1_centres", "sizes", sql=AXIS.format(x="97 + x.range * 90 - 90", y="63 + y.range * 90 - 60", x0=97, y0=63, right=91, bottom=70, where=INSIDE))
def _(s):
    return windows.window_boxes(s, 181, 120, 90, (7, 3), boundary=(20, 30, 10, 70), centre=True)


@query("w1_padding", "sizes", sql=AXIS.format(x="7 + x.range * 90 - 90", y="33 + y.range * 90 - 60", x0=7, y0=33, right=10, bottom=0, where=""))
def _(s):
    return windows.window_boxes(s, 181, 120, 90, (7, 3), boundary=(0, 30, 10, 0), centre=True, padding=True)


@query("w2_random_crop", "pixels", sql="SELECT img, row_no - img * 7919 % 31 AS row_no, col_no - (img * 7919 + 1) % 21 AS col_no, v1 FROM pixels WHERE row_no BETWEEN img * 7919 % 31 AND img * 7919 % 31 + 19 AND col_no BETWEEN (img * 7919 + 1) % 21 AND (img * 7919 + 1) % 21 + 29")
def _(p):
    sizes = p.select("img").distinct().withColumns({"h": F.lit(50), "w": F.lit(50)})
    return windows.random_crop(p.select("img", "row_no", "col_no", "v1"), sizes, 20, 30, 3, F.col("img") * 7919).select("img", "row_no", "col_no", "v1")


def window_sizes(p):
    return p.select("img").distinct().withColumns({"h": F.lit(50), "w": F.lit(50)})


def response_model():
    """A stand-in model: two classes, whose responses depend on the window."""

    def score(batch):
        import pandas as pd

        each = [batch[["img", "row_no", "col_no"]].assign(**{"class": k, "p": ((batch.v1 + batch.v2 * k + batch.win_row) % 101) / 101.0}) for k in (0, 1)]
        return pd.concat(each)[["img", "row_no", "col_no", "class", "p"]]

    return score


@query("e2_overlapping", "pixels", sql="""WITH s AS (SELECT unnest([0, 16, 30]) AS at), r AS (SELECT img, row_no, col_no, k.range AS class, max((v1 + v2 * k.range + s.at) % 101) AS p FROM pixels JOIN s ON row_no BETWEEN s.at AND s.at + 19, range(2) k GROUP BY 1, 2, 3, 4)
 SELECT img, row_no, col_no, arg_max(class, p * 10 - class) AS predicted FROM r GROUP BY 1, 2, 3""")
def _(p):
    return predict_overlapping(p.select("img", "row_no", "col_no", "v1", "v2"), window_sizes(p), 20, response_model)


def stitched_model():
    return lambda batch: batch[["img", "win_row", "win_col", "row_no", "col_no"]].assign(predicted=(batch.v1 + batch.win_row * 3 + batch.win_col) % 5)


@query("e3_stitched", "pixels", sql="SELECT img, row_no - 5 AS row_no, col_no - 5 AS col_no, CAST((v1 + floor((row_no - 5) / 10) * 30 + floor((col_no - 5) / 10) * 10) % 5 AS BIGINT) AS predicted FROM pixels WHERE row_no BETWEEN 5 AND 34 AND col_no BETWEEN 5 AND 34")
def _(p):
    return predict_stitched(p.select("img", "row_no", "col_no", "v1", "v2"), window_sizes(p), 20, stitched_model).select("img", "row_no", "col_no", "predicted")


def scaled(p):
    """Parcels eight times as large, on one image, in pixels."""
    ring = G.ring_to_pixels((0.125, 0.0, 0.0, 0.0, 0.125, 0.0), G.box_ring(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]))
    return p.select(F.lit(1).cast("long").alias("img"), "id", F.lit("parcel").alias("category"), ring.alias("ring"))


JOB = """WITH t AS (SELECT x.range * 14 + y.range AS tile_no, {x} AS tx, {y} AS ty FROM range(14) x, range(14) y),
 m AS (SELECT tile_no, id, greatest(minx * 8, tx) - tx AS x1, greatest(miny * 8, ty) - ty AS y1, least(maxx * 8, tx + 256) - tx AS x2, least(maxy * 8, ty + 256) - ty AS y2 FROM parcels JOIN t ON minx * 8 <= tx + 256 AND maxx * 8 >= tx AND miny * 8 <= ty + 256 AND maxy * 8 >= ty {edge}),
 k AS (SELECT * FROM m WHERE {rule}), o AS (SELECT DISTINCT tile_no FROM {of})
 SELECT 'tile_1_' || lpad(CAST(o.tile_no AS VARCHAR), 6, '0') AS img_name, count(k.id) AS n, coalesce(string_agg(k.id || ':' || x1 || ':' || y1 || ':' || x2 || ':' || y2, ',' ORDER BY k.id), '') AS boxes FROM o LEFT JOIN k ON k.tile_no = o.tile_no GROUP BY 1"""
SHIFTED = {"x": "least(x.range * 256, 3400 - 256)", "y": "least(y.range * 256, 3400 - 256)", "edge": ""}
PLAIN = {"x": "x.range * 256", "y": "y.range * 256", "edge": ""}
HARVEY = "NOT ((x2 - x1) * (y2 - y1) < 400 OR (x1 = x2 AND y1 = y2) OR coalesce((x2 - x1) / nullif(y2 - y1, 0), (y2 - y1) / nullif(x2 - x1, 0)) > 40 OR coalesce((x2 - x1) / nullif(y2 - y1, 0), (y2 - y1) / nullif(x2 - x1, 0)) < 0.025)"
TANK = "x1 <> x2 AND y1 <> y2 AND (x2 - x1) * (y2 - y1) >= 256"
JOBS = {
    "harvey": JOB.format(**PLAIN, rule=HARVEY, of="m"),
    "roof": JOB.format(**PLAIN, rule="x1 <> x2 AND y1 <> y2 AND x2 - x1 >= 24 AND y2 - y1 >= 24", of="k"),
    "tank": JOB.format(**SHIFTED, rule=TANK, of="k"),
    "tank_negative": JOB.format(**{**PLAIN, "edge": "AND tx + 256 <= 3400 AND ty + 256 <= 3400"}, rule=TANK, of="k"),
}


def job(p, preset: str):
    images = p.sparkSession.range(1).select(F.lit(1).cast("long").alias("img"), F.lit(3400).cast("long").alias("h"), F.lit(3400).cast("long").alias("w"))
    boxes, records = tilejob.tile_annotations(scaled(p), images, 256, preset)
    text = F.transform("bboxes", lambda b: F.concat_ws(":", b["box_id"], b["x1"], b["y1"], b["x2"], b["y2"]))
    return records.select("img_name", F.size("bboxes").cast("long").alias("n"), F.array_join(text, ",").alias("boxes"))


for _preset, _sql in JOBS.items():
    query(f"b13_{_preset}", "parcels", sql=_sql)(lambda p, preset=_preset: job(p, preset))

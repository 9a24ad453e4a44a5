"""Further queries of the catalog: label jobs, geometry of parts, resizing, scoring, file rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import boxes as B
from tilewright.functions import geometry as G
from tilewright.operators import balance, evaluate, manifests, patches, raster, vector, windows
from tilewright.operators.scoring import masks_without, score_windows
from tilewright.queries.catalog import CLASSES, as_rings, keyed, query, r6, stitched_windows, two
from tilewright.sources.sinks import box_rows, class_mapping

AFFINE = (0.5, 0.0, 10.0, 0.0, -0.5, 400.0)
DAMAGE = {1: "none", 2: "minor", 3: "major", 4: "destroyed"}


@query("a10_mean_of_sample", "pixels", sql="WITH i AS (SELECT DISTINCT img FROM pixels ORDER BY img * 7919 % 10007, img LIMIT 20), a AS (SELECT img, avg(v1) AS v1 FROM pixels WHERE img IN (SELECT img FROM i) GROUP BY 1) SELECT round(avg(v1), 6) AS v1 FROM a")
def _(p):
    some = p.select("img").distinct().orderBy(F.col("img") * 7919 % 10007, "img").limit(20)
    return evaluate.channel_means(p.join(F.broadcast(some), "img", "left_semi"), "img", ["v1"]).select(r6(F.col("v1"), "v1"))


@query("p4_normalise", "boxes", sql="SELECT box_id, CAST(substr(category, 1, 1) AS INTEGER) AS number, CAST(least(x1, x2) AS DOUBLE) AS minx, CAST(greatest(y1, y2) AS DOUBLE) AS maxy FROM boxes WHERE x1 <> x2 AND y1 <> y2 AND category <> '5-LOW' AND box_id % 100 >= 30")
def _(b):
    d = b.select("box_id", "category", (F.col("box_id") % 100).alias("score"), G.box_ring(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("ring"))
    d = vector.normalise_features(d, {k: v for k, v in CLASSES.items() if v != 5}, 30)
    return d.select("box_id", F.col("category").alias("number"), d.ring[0]["x"].alias("minx"), d.ring[2]["y"].alias("maxy"))


@query("p6_damage_names", "parcels", sql="SELECT id, CASE damage_class WHEN 1 THEN 'none' WHEN 2 THEN 'minor' WHEN 3 THEN 'major' WHEN 4 THEN 'destroyed' END AS damage FROM parcels")
def _(p):
    return p.withColumn("damage_class", F.col("damage_class").cast("int")).select("id", B.map_category("damage_class", DAMAGE).alias("damage"))


@query("p24_subtract_mean", "pixels", sql="WITH a AS (SELECT img, avg(v1) AS m1, avg(v2) AS m2 FROM pixels GROUP BY 1), m AS (SELECT avg(m1) AS m1, avg(m2) AS m2 FROM a) SELECT img, row_no, col_no, round((v1 - m1) / 255, 6) AS v1, round((v2 - m2) / 255, 6) AS v2 FROM pixels, m")
def _(p):
    return patches.subtract_means(p, ["v1", "v2"]).select("img", "row_no", "col_no", r6(F.col("v1"), "v1"), r6(F.col("v2"), "v2"))


@query("p26_named_objects", "boxes", sql="SELECT box_id, substr(category, 3) AS name FROM boxes WHERE category <> '4-NOT SPECIFIED'")
def _(b):
    number = B.map_category("category", CLASSES)
    named = b.where("category <> '4-NOT SPECIFIED'").withColumn("number", number)
    return named.select("box_id", B.map_category("number", {v: k[2:] for k, v in CLASSES.items()}).alias("name"))


@query("j4_lookup", "manifest", "mask_stats", sql="SELECT filename AS stem, roads FROM manifest JOIN mask_stats ON image = concat('images/', filename, '.png')")
def _(m, s):
    return manifests.lookup(m.select(manifests.stem(F.col("image")).alias("stem")), s.withColumnRenamed("filename", "stem"), "stem")[0].select("stem", "roads")


@query("j6_label_rows", "mask_stats", "patch_loss", sql="SELECT filename, loss FROM mask_stats JOIN patch_loss ON concat(filename, '.jpg') = patch_name")
def _(m, p):
    return patches.attach_labels(m, p, "patch_name").select("filename", "loss")


@query("j10_difference", "lines", sql="SELECT line_id FROM lines EXCEPT SELECT line_id FROM lines WHERE x1 - x0 > 1")
def _(x):
    return patches.rest(x.select("line_id"), x.where("x1 - x0 > 1"), "line_id")


@query("j15_raster_sum", "pixels", sql="SELECT img, row_no, col_no, v1 + v2 AS v FROM pixels")
def _(p):
    a, b = two(p)
    return a.withColumnRenamed("v", "a").join(b, raster.KEY).select(*raster.KEY, (F.col("a") + F.col("v")).alias("v"))


@query("t3_by_class", "parcels", sql="SELECT id, damage_class FROM parcels ORDER BY damage_class, id")
def _(p):
    return p.select("id", "damage_class").orderBy("damage_class", "id")


@query("w2_crop", "pixels", sql="SELECT img, row_no - 5 AS row_no, col_no - 7 AS col_no, v1 FROM pixels WHERE row_no BETWEEN 5 AND 24 AND col_no BETWEEN 7 AND 36")
def _(p):
    return windows.crop(p.select("img", "row_no", "col_no", "v1"), 5, 7, 20, 30)


@query("w8_mosaic_labels", "pixels", sql="SELECT img, row_no - 5 AS row_no, col_no - 5 AS col_no, CAST(lab AS BIGINT) AS actual FROM pixels WHERE row_no BETWEEN 5 AND 44 AND col_no BETWEEN 5 AND 44")
def _(p):
    labels = p.select("img", "row_no", "col_no", F.col("lab").cast("long").alias("actual"))
    return windows.labels_of_mosaic(windows.stitch(stitched_windows(p), 20), labels, 20).select("img", "row_no", "col_no", "actual")


@query("r11_downsample", "pixels", sql="""WITH t AS (SELECT i.range AS i, (i.range + 0.5) * 2.5 - 0.5 AS y FROM range(20) i), taps AS (SELECT i, CAST(floor(y) AS BIGINT) AS at, 1 - (y - floor(y)) AS wt FROM t UNION ALL SELECT i, CAST(floor(y) AS BIGINT) + 1, y - floor(y) FROM t)
 SELECT img, r.i AS row_no, c.i AS col_no, CAST(round(sum(r.wt * c.wt * v1), 6) AS DOUBLE) AS v1 FROM taps r, taps c, pixels WHERE r.wt * c.wt > 0 AND row_no = r.at AND col_no = c.at GROUP BY 1, 2, 3""")
def _(p):
    sizes = p.select("img").distinct().withColumns({"h": F.lit(50), "w": F.lit(50)})
    return raster.resize(p, sizes, "v1", 20, 20).withColumn("v1", F.round("v1", 6))


@query("r12_boundary_mask", "parcels", sql="""WITH b AS (SELECT id, damage_class, minx, maxx, miny, maxy, unnest(range(minx, maxx + 1)) AS x FROM parcels), c AS (SELECT *, unnest(range(miny, maxy + 1)) AS y FROM b)
 SELECT y AS row_no, x AS col_no, arg_max(damage_class, id) AS class FROM c WHERE x = minx OR x = maxx OR y = miny OR y = maxy GROUP BY 1, 2""")
def _(p):
    d = as_rings(p).join(p.select("id", F.col("damage_class").alias("class")), "id").withColumns({"img": F.lit(0), "order": F.col("id")})
    return raster.draw_outlines(d).select("row_no", "col_no", "class")


def multi_lines(x):
    """Features of two parts; every tenth without geometry."""
    line = lambda a, b, c, d: F.array(G.point(F.col(a), F.col(b)), G.point(F.col(c), F.col(d)))
    parts = F.when(F.col("line_id") % 10 != 0, F.array(line("x0", "y0", "x1", "y1"), line("x1", "y1", "x0", "y0")))
    return x.select("line_id", F.concat(F.lit("type"), (F.col("line_id") % 4).cast("string")).alias("road_type"), parts.alias("parts"), F.lit(32632).alias("epsg"))


PARTS = "p AS (SELECT line_id, 0 AS part, x0, y0 FROM lines WHERE line_id % 10 <> 0 UNION ALL SELECT line_id, 1, x1, y1 FROM lines WHERE line_id % 10 <> 0)"


@query("g1_parts", "lines", sql=f"WITH {PARTS} SELECT line_id, part, CAST(x0 AS DOUBLE) AS x FROM p")
def _(x):
    return vector.explode_parts(multi_lines(x)).select("line_id", "part", F.get("geom", F.lit(0))["x"].alias("x"))


@query("g2_road_lines", "lines", sql=f"WITH {PARTS} SELECT line_id, part, 'type' || line_id % 4 AS category, FALSE AS missing FROM p UNION ALL SELECT line_id, NULL, NULL, TRUE FROM lines WHERE line_id % 10 = 0")
def _(x):
    good, bad = vector.road_lines(multi_lines(x))
    return good.select("line_id", "part", "category", F.lit(False).alias("missing")).unionByName(bad.select("line_id", F.lit(True).alias("missing")), allowMissingColumns=True)


@query("g3_combine", "lines", sql=f"WITH {PARTS} SELECT line_id, part FROM p UNION ALL SELECT line_id, part FROM p WHERE line_id % 4 = 1")
def _(x):
    d = multi_lines(x)
    return vector.combine([d, d.where("road_type = 'type1'").drop("road_type")]).select("line_id", "part")


@query("g5_hulls", "parcels", sql="SELECT id, 4 AS n, CAST((maxx - minx) * (maxy - miny) AS DOUBLE) AS area FROM parcels")
def _(p):
    middle = F.array(G.point((F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2))
    d = as_rings(p).join(p, "id").select("id", F.concat(middle, "ring", middle).alias("points")).withColumn("hull", G.convex_hull())
    return d.select("id", F.size("hull").alias("n"), G.area(F.col("hull")).alias("area"))


@query("g6_uncovered_roofs", "parcels", sql="""WITH px AS (SELECT id, damage_class AS k, unnest(range(minx, maxx)) AS x, miny, maxy FROM parcels), q AS (SELECT id, k, x, unnest(range(miny, maxy)) AS y FROM px)
 SELECT id, count(*) AS pixels FROM q WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM q o WHERE o.k = 2 AND o.x = q.x AND o.y = q.y) GROUP BY 1""")
def _(p):
    d = as_rings(p).join(p.select("id", "damage_class"), "id").withColumn("img", F.lit(0))
    left = raster.without(d.where("damage_class = 1"), d.where("damage_class = 2"))
    return left.groupBy("id").agg(F.count("*").alias("pixels"))


@query("b2_images_of_masks", "manifest", sql="SELECT pos, CASE WHEN label IS NULL THEN NULL ELSE left(regexp_replace(label, '^.*/|[.].*$', '', 'g'), greatest(0, length(regexp_replace(label, '^.*/|[.].*$', '', 'g')) - 2)) END AS image FROM manifest")
def _(m):
    return m.select("pos", manifests.image_of_mask(F.col("label"), 2).alias("image"))


@query("b4_merge_manifests", "manifest", sql="""WITH u AS (SELECT pos, pos % 2 AS split, image FROM manifest UNION ALL SELECT pos + 1000000000, pos % 2, image FROM manifest WHERE pos % 3 = 0)
 SELECT 'first' AS dataset, split, CAST(row_number() OVER (PARTITION BY split ORDER BY pos * 7919 % 10007, pos) - 1 AS BIGINT) AS pos, image FROM u""")
def _(m):
    one = m.select(F.lit("first").alias("dataset"), (F.col("pos") % 2).alias("split"), "pos", "image")
    two_ = one.where("pos % 3 = 0").withColumn("pos", F.col("pos") + 1000000000)
    return manifests.merge(keyed(one), keyed(two_), [F.col("_k"), F.col("pos")]).select("dataset", "split", "pos", "image")


@query("b10_mix_negatives", "mask_stats", sql="WITH p AS (SELECT pos FROM mask_stats WHERE source = 'poc'), n AS (SELECT pos, row_number() OVER (ORDER BY pos) AS r FROM mask_stats WHERE source <> 'poc') SELECT pos, 'images' AS origin FROM p UNION ALL SELECT pos, 'images_negative' FROM n WHERE r <= 4 * (SELECT count(*) FROM p)")
def _(m):
    return balance.mix_negatives(m.where("source = 'poc'").select("pos"), m.where("source <> 'poc'").select("pos"), ["pos"])


@query("b12_blank_annotations", "mask_stats", sql="SELECT filename, NULL AS category, NULL AS x1 FROM mask_stats WHERE roads = 0")
def _(m):
    return balance.blank_annotations(m.where("roads = 0").select("filename")).select("filename", "category", "x1")


@query("b14_crowd_boxes", "parcels", sql="""WITH b AS (SELECT id, CAST(trunc((minx - 10) / 0.5) AS INTEGER) AS x1, CAST(trunc((400 - maxy) / 0.5) AS INTEGER) AS y1, CAST(trunc((maxx - 10) / 0.5) AS INTEGER) AS x2, CAST(trunc((400 - miny) / 0.5) AS INTEGER) AS y2 FROM parcels)
 SELECT *, CASE WHEN greatest(x1, x2) > 700 OR greatest(y1, y2) > 750 THEN 'outside' WHEN x1 >= x2 OR y1 >= y2 THEN 'flipped' END AS reject FROM b""")
def _(p):
    return vector.crowd_boxes(p, AFFINE, F.lit(700), F.lit(750)).select("id", "x1", "y1", "x2", "y2", "reject")


@query("b15_task_boxes", "boxes", sql="SELECT img_name AS name, CASE WHEN category IN ('1-URGENT', '2-HIGH') THEN 'fast' ELSE 'slow' END AS category, CAST(least(x1, x2) AS INTEGER) AS x1, CAST(least(y1, y2) AS INTEGER) AS y1, CAST(greatest(x1, x2) AS INTEGER) AS x2, CAST(greatest(y1, y2) AS INTEGER) AS y2 FROM boxes WHERE category <> '4-NOT SPECIFIED'")
def _(b):
    tasks = b.select(F.col("img_name").alias("name"), F.col("category").alias("tag"), G.box_ring(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("points"))
    return vector.task_boxes(tasks, {"1-URGENT": "fast", "2-HIGH": "fast", "3-MEDIUM": "slow", "5-LOW": "slow"})


@query("b16_class_mapping", "boxes", sql="WITH c AS (SELECT DISTINCT category AS name FROM boxes) SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS \"index\" FROM c")
def _(b):
    return class_mapping(b)


def arithmetic_scorer():
    """A stand-in model: the class is a remainder of the two channels."""
    return lambda batch: batch[["img", "row_no", "col_no"]].assign(predicted=(batch.v1 * 7 + batch.v2 * 3) % 11 % 3)


SCORED = "img long, row_no long, col_no long, predicted long"


@query("e1_score", "pixels", sql="SELECT img, row_no, col_no, (v1 * 7 + v2 * 3) % 11 % 3 AS predicted FROM pixels")
def _(p):
    return score_windows(p.select("img", "row_no", "col_no", "v1", "v2"), arithmetic_scorer, SCORED)


@query("e6_masks_without_class", "pixels", sql="SELECT img, count(*) FILTER ((v1 * 7 + v2 * 3) % 11 % 3 = 1) AS ones FROM pixels GROUP BY 1")
def _(p):
    masks = masks_without(score_windows(p.select("img", "row_no", "col_no", "v1", "v2"), arithmetic_scorer, SCORED), 2)
    return masks.groupBy("img").agg(F.sum("predicted").alias("ones"))


@query("k5_tile_geo_info", "sizes", sql="SELECT img_id, CAST(x.range * ceil(h / 256.0) + y.range AS BIGINT) AS tile_no, 10 + 128.0::DOUBLE * x.range AS world_x, 400 - 128.0::DOUBLE * y.range AS world_y FROM sizes JOIN range(8) x ON x.range * 256 < w JOIN range(8) y ON y.range * 256 < h")
def _(s):
    at = G.to_world(AFFINE, F.col("x0"), F.col("y0"))
    return windows.tiles(s, 256).select("img_id", "tile_no", at["x"].alias("world_x"), at["y"].alias("world_y"))


@query("k8_combined_rows", "boxes", "mask_stats", sql="SELECT concat('data/', img_name) AS filepath, x1, category AS class_name FROM boxes UNION ALL SELECT concat('data/', filename), NULL, NULL FROM mask_stats WHERE roads = 0")
def _(b, m):
    blank = balance.blank_annotations(m.where("roads = 0").select(F.col("filename").alias("img_name")))
    return box_rows(b, "data").select("filepath", "x1", "class_name").unionByName(box_rows(blank, "data").select("filepath", "x1", "class_name"))

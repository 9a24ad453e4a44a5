"""Queries of rasters in blocks: regions, outlines, ensembles, statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.operators import blocks as B
from tilewright.operators import raster
from tilewright.queries.catalog import query, r6
from tilewright.queries.files import folder
from tilewright.sources import readers, sinks

#: Blocks of 20 x 20 pixels, so that the fixture's images of 50 x 50 have several.
SIZE = 20


def cut(p, value: str):
    return B.to_blocks(p, value, SIZE)


def pixels_of(blocks, name: str):
    return B.to_pixels(blocks).withColumnRenamed("v", name)


def region_sql(pixels: str, diagonal: bool = False) -> str:
    """CTEs ending in reg (img, v, row_no, c0, c1, root): runs of the pixels (img, row_no, col_no, v) and the first run of their region."""
    d = int(diagonal)
    return f"""px AS ({pixels}), gi AS (SELECT *, col_no - row_number() OVER (PARTITION BY img, row_no, v ORDER BY col_no) AS g FROM px),
 rn AS (SELECT img, row_no, v, min(col_no) AS c0, max(col_no) AS c1, img * 10000000 + row_no * 10000 + min(col_no) AS id FROM gi GROUP BY img, row_no, v, g),
 ad AS (SELECT a.id, b.id AS other FROM rn a JOIN rn b ON a.img = b.img AND a.v = b.v AND abs(a.row_no - b.row_no) = 1 AND a.c0 <= b.c1 + {d} AND b.c0 <= a.c1 + {d}),
 rc AS (SELECT id, id AS root FROM rn UNION SELECT ad.other, root FROM rc JOIN ad ON ad.id = rc.id WHERE ad.other > root),
 reg AS (SELECT rn.img, v, row_no, c0, c1, (SELECT min(root) FROM rc WHERE rc.id = rn.id) AS root FROM rn)"""


BOXES = "SELECT img, v AS value, min(c0) AS x1, min(row_no) AS y1, max(c1) + 1 AS x2, max(row_no) + 1 AS y2, CAST(sum(c1 - c0 + 1) AS BIGINT) AS pixels FROM reg GROUP BY img, v, root"
LAB = "SELECT img, row_no, col_no, lab AS v FROM pixels"
ONES = f"{LAB} WHERE lab = 1"
NAME = "img || '/' || root // 10000 % 1000 || '/' || root % 10000"


def categories(spark):
    rows = [(1, "field", True, False, None, None), (0, "ground", True, True, None, 100.0), (7, "none", False, None, None, None)]
    return spark.createDataFrame(rows, "pixel_value int, category_name string, vectorize boolean, bbox_flag boolean, kernel_size int, min_area double")


@query("r5_regions", "pixels", sql=f"WITH RECURSIVE {region_sql(LAB)} {BOXES}")
def _(p):
    return B.region_boxes(B.regions(cut(p, "lab"), False, SIZE)).select("img", "value", "x1", "y1", "x2", "y2", "pixels")


@query("r5_vectorise", "pixels", sql=f"WITH RECURSIVE {region_sql(LAB)}, b AS ({BOXES}) SELECT img, value AS num, CASE value WHEN 1 THEN 'field' ELSE 'ground' END AS category, x1, y1, x2, y2, pixels, 4 AS corners FROM b WHERE value = 1 OR pixels >= 100")
def _(p):
    found = B.vectorise(cut(p, "lab"), categories(p.sparkSession), SIZE)
    return found.select("img", "num", "category", "x1", "y1", "x2", "y2", "pixels", F.size(F.flatten("polygon")).alias("corners"))


#: Letters of 9 x 9 pixels in cells of 10: a ring with an island in its hole, a U, a comb, a cross of arms that meet at corners only.
LETTERS = {
    0: ["#########", "#.......#", "#.......#", "#..###..#", "#..###..#", "#..###..#", "#.......#", "#.......#", "#########"],
    1: ["##.....##", "##.....##", "##.....##", "##.....##", "##.....##", "##.....##", "##.....##", "#########", "#########"],
    2: ["#########", "#.#.#.#.#", "#.#.#.#.#", "#.#.#.#.#", "#.#.#.#.#", "#.#.#.#.#", "#.#.#.#.#", "#.#.#.#.#", "#.#.#.#.#"],
    3: ["###...###", "###...###", "###...###", "...###...", "...#.#...", "...###...", "###...###", "###...###", "###...###"],
}
TEXT = "".join("".join(rows) for rows in LETTERS.values())
#: 1 where a letter, by its cell, has a pixel; 0 elsewhere.
LETTER = f"CASE WHEN row_no % 10 < 9 AND col_no % 10 < 9 AND substr('{TEXT}', CAST((CAST(floor(row_no / 10) * 5 + floor(col_no / 10) + img AS BIGINT) % 4) * 81 + row_no % 10 * 9 + col_no % 10 + 1 AS INTEGER), 1) = '#' THEN 1 ELSE 0 END"


def letters(p):
    return p.select("img", "row_no", "col_no", F.expr(LETTER).alias("lab"))


#: Per region of letters: its pixels, unit edges, corners (of each four pixels around a point), and rings by Euler's formula for 4-connected pixels.
SHAPES_SQL = f"""WITH RECURSIVE {region_sql(f'SELECT img, row_no, col_no, {LETTER} AS v FROM pixels WHERE {LETTER} = 1')}, q AS (SELECT img, root, row_no AS r, unnest(range(c0, c1 + 1)) AS c FROM reg),
 s AS (SELECT *, unnest([{{'dr': -1, 'dc': 0}}, {{'dr': 0, 'dc': 1}}, {{'dr': 1, 'dc': 0}}, {{'dr': 0, 'dc': -1}}]) AS e FROM q), ed AS (SELECT s.img, s.root, count(*) AS n FROM s ANTI JOIN q o ON o.img = s.img AND o.r = s.r + e.dr AND o.c = s.c + e.dc GROUP BY 1, 2),
 pt AS (SELECT img, root, r + dr.range AS y, c + dc.range AS x, count(*) AS k, sum(CASE WHEN dr.range = dc.range THEN 1 ELSE 0 END) AS diag FROM q, range(2) dr, range(2) dc GROUP BY 1, 2, 3, 4),
 co AS (SELECT img, root, sum(CASE WHEN k IN (1, 3) THEN 1 WHEN k = 2 AND diag <> 1 THEN 2 ELSE 0 END) AS corners, sum(CASE WHEN k = 1 THEN 1 WHEN k = 3 THEN -1 WHEN k = 2 AND diag <> 1 THEN 2 ELSE 0 END) AS turn FROM pt GROUP BY 1, 2),
 px1 AS (SELECT img, root, count(*) AS pixels FROM q GROUP BY 1, 2)"""


@query("r5_letters", "pixels", sql=f"{SHAPES_SQL} SELECT img, CAST(pixels AS BIGINT) AS pixels, CAST(pixels * 0.25 AS DOUBLE) AS area, CAST(n * 0.5 AS DOUBLE) AS outline, CAST(corners AS INTEGER) AS corners, CAST(2 - turn / 4 AS INTEGER) AS rings, 'letter' AS category FROM px1 JOIN ed USING (img, root) JOIN co USING (img, root)")
def _(p):
    """Concave regions with holes and islands, in world coordinates through a GeoJSON file and back."""
    spark = p.sparkSession
    wanted = spark.createDataFrame([(1, "letter", True, False, None, None)], "pixel_value int, category_name string, vectorize boolean, bbox_flag boolean, kernel_size int, min_area double")
    found = B.vectorise(cut(letters(p), "lab"), wanted, SIZE)
    # half a metre a pixel, rows going south, and a place for each image
    transforms = p.select("img").distinct().selectExpr("img", "0.5D as a", "0D as b", "500000D + img * 100 as c", "0D as d", "-0.5D as e", "5400000D as f")
    path = folder(p, "letters")
    sinks.write_geojson(B.region_features(found, transforms, 32632), path, ["img", "category", "pixels"], 32632)
    d = readers.read_features(spark, path, "img:bigint,category:string,pixels:bigint", lines=True)
    outline = F.aggregate("parts", F.lit(0.0), lambda s, r: s + G.length(F.concat(r, F.slice(r, 1, 1))))
    near = F.forall(F.flatten("parts"), lambda q: (q["x"] >= 500000 + F.col("img") * 100) & (q["x"] <= 500025 + F.col("img") * 100) & (q["y"] <= 5400000) & (q["y"] >= 5400000 - 25))
    return d.where(near).select("img", "pixels", F.round(G.polygon_area(F.col("polygons")), 6).alias("area"), F.round(outline, 6).alias("outline"), F.size(F.flatten("parts")).alias("corners"), F.size("parts").alias("rings"), "category")


@query("r6_ensemble_regions", "pixels", sql=f"WITH RECURSIVE {region_sql('SELECT img, row_no, col_no, 1 AS v FROM pixels WHERE floor(v1 / 2) + floor(v2 / 2) > 127')} {BOXES}")
def _(p):
    both = B.combine_blocks(cut(p, "v1"), cut(p, "v2"), lambda a, b: np.where(a // 2 + b // 2 > 127, 1, B.NONE))
    return B.region_boxes(B.regions(both, False, SIZE)).select("img", "value", "x1", "y1", "x2", "y2", "pixels")


def ones(p):
    return cut(p.where("lab = 1"), "lab")


@query("r7_outlines", "pixels", sql=f"""WITH RECURSIVE {region_sql(ONES)}, q AS (SELECT img, row_no AS r, unnest(range(c0, c1 + 1)) AS c, {NAME} AS component FROM reg),
 s AS (SELECT *, unnest([{{'dr': -1, 'dc': 0, 'a': 0, 'b': 0, 'c2': 1, 'd': 0}}, {{'dr': 0, 'dc': 1, 'a': 1, 'b': 0, 'c2': 1, 'd': 1}}, {{'dr': 1, 'dc': 0, 'a': 1, 'b': 1, 'c2': 0, 'd': 1}}, {{'dr': 0, 'dc': -1, 'a': 0, 'b': 1, 'c2': 0, 'd': 0}}]) AS e FROM q)
 SELECT s.img, s.component, s.c + e.a AS x0, s.r + e.b AS y0, s.c + e.c2 AS x1, s.r + e.d AS y1 FROM s LEFT JOIN q o ON o.img = s.img AND o.r = s.r + e.dr AND o.c = s.c + e.dc WHERE o.img IS NULL""")
def _(p):
    b = ones(p)
    return B.outlines(b, B.regions(b, False, SIZE)).select("img", B.component_name(), "x0", "y0", "x1", "y1")


@query("r7_rings", "pixels", sql=f"""WITH RECURSIVE {region_sql(ONES)}, b AS (SELECT img, {NAME} AS component, min(c0) AS x1, min(row_no) AS y1, max(c1) + 1 AS x2, max(row_no) + 1 AS y2 FROM reg GROUP BY img, root)
 SELECT img, component, unnest([x1, x2, x2, x1]) AS x, unnest([y1, y1, y2, y2]) AS y, CAST(unnest([0, x2 - x1, x2 - x1 + y2 - y1, 2 * (x2 - x1) + y2 - y1]) AS BIGINT) AS place, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS signed_area FROM b""")
def _(p):
    b = ones(p)
    return raster.rings(B.outlines(b, B.regions(b, False, SIZE)), SIZE).select("img", B.component_name(), "x", "y", "place", "signed_area")


@query("r8_mask_boxes", "pixels", sql=f"WITH RECURSIVE {region_sql(ONES, True)}, b AS ({BOXES}), i AS (SELECT DISTINCT img FROM pixels) SELECT img, x1, y1, x2, y2, pixels FROM i LEFT JOIN (SELECT * FROM b WHERE pixels >= 60) USING (img)")
def _(p):
    return B.mask_boxes(cut(p, "lab"), 60, size=SIZE).select("img", "x1", "y1", "x2", "y2", "pixels")


@query("r10_brightness", "pixels", sql="SELECT img, row_no, col_no, CAST(least(255, floor(v1 * (1 + 0.5::DOUBLE * (img * 7919 % 1048576) / 1048576))) AS INTEGER) AS v1 FROM pixels")
def _(p):
    return raster.brighten(p, "v1", 3, key=F.col("img") * 7919).select("img", "row_no", "col_no", "v1")


@query("r10_some_blocks", "pixels", sql="SELECT img, row_no, col_no, CAST(least(255, floor(v1 * (1 + 0.5::DOUBLE * (img * 7919 % 1048576) / 1048576))) AS INTEGER) AS v1 FROM pixels")
def _(p):
    lit = cut(p, "v1").withColumn("factor", raster.brightness(3, key=F.col("img") * 7919))
    return pixels_of(B.map_blocks(lit, lambda a, f: np.minimum(255, np.floor(a * f)), extra="factor"), "v1")


@query("r1_threshold_blocks", "pixels", sql="SELECT img, row_no, col_no, CASE WHEN v1 > 127 THEN 1 ELSE 0 END AS v1 FROM pixels")
def _(p):
    return pixels_of(B.map_blocks(cut(p, "v1"), lambda a: a > 127), "v1")


TWO = {
    "r2_ensemble_blocks": ("CASE WHEN floor(v1 / 2) + floor(v2 / 2) > 127 THEN 1 ELSE 0 END", lambda a, b: a // 2 + b // 2 > 127),
    "r3_votes_blocks": ("CASE WHEN v1 > 127 THEN 1 ELSE 0 END + CASE WHEN v2 > 127 THEN 1 ELSE 0 END", lambda a, b: (a > 127).astype(int) + (b > 127)),
    "r4_logical_or_blocks": ("CASE WHEN v1 % 4 <> 0 OR v2 % 4 <> 0 THEN 1 ELSE 0 END", lambda a, b: (a % 4 != 0) | (b % 4 != 0)),
    "j15_raster_sum_blocks": ("CAST(v1 + v2 AS INTEGER)", lambda a, b: a + b),
}
for _name, (_sql, _f) in TWO.items():
    query(_name, "pixels", sql=f"SELECT img, row_no, col_no, {_sql} AS v FROM pixels")(lambda p, f=_f: B.to_pixels(B.combine_blocks(cut(p, "v1"), cut(p, "v2"), f)))


@query("a1_histogram_blocks", "pixels", sql="SELECT CAST(v1 AS BIGINT) AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM pixels GROUP BY 1")
def _(p):
    return B.histogram(cut(p, "v1")).select("class", "n", r6(F.col("share"), "share"))


@query("a9_channel_mean_blocks", "pixels", sql="WITH a AS (SELECT img, avg(v1) AS v1 FROM pixels GROUP BY 1) SELECT round(avg(v1), 6) AS v1 FROM a")
def _(p):
    return B.image_stats(cut(p, "v1")).agg(F.round(F.avg("mean"), 6).alias("v1"))


@query("a14_nonzero_ratio_blocks", "pixels", sql="SELECT img, round(count(*) FILTER (lab <> 0) / count(*), 6) AS ratio, bool_and(lab = 0) AS empty FROM pixels GROUP BY 1")
def _(p):
    return B.image_stats(cut(p, "lab")).select("img", r6(F.col("nonzero") / F.col("n"), "ratio"), (F.col("nonzero") == 0).alias("empty"))


@query("a6_confusion_blocks", "pixels", sql="SELECT CAST(v1 % 5 AS BIGINT) AS actual, CAST(v2 % 6 AS BIGINT) AS predicted, count(*) AS n FROM pixels WHERE v2 % 6 < 5 GROUP BY 1, 2")
def _(p):
    return B.confusion(cut(p.withColumn("a", F.col("v1") % 5), "a"), cut(p.withColumn("b", F.col("v2") % 6), "b"), 5)


@query("p16_remap_blocks", "pixels", sql="SELECT img, row_no, col_no, CAST(CASE WHEN v1 % 3 = 2 THEN 0 ELSE v1 % 3 END AS INTEGER) AS v FROM pixels")
def _(p):
    return B.to_pixels(B.map_blocks(cut(p, "v1"), lambda a: np.where(a % 3 == 2, 0, a % 3)))

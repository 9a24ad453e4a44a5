"""Queries of rasters in blocks of several channels: window scoring, overlap-add, stitching, reports, moments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tilewright.operators import blocks as B
from tilewright.operators import raster
from tilewright.operators import stacks as S
from tilewright.queries.catalog import CM, REPORT, as_rings, query, r6, rounded_report
from tilewright.queries.files import folder, window_sizes
from tilewright.queries.rasters import SIZE, cut
from tilewright.sources import geotiff, sinks

BOX = 20
#: First rows and columns of patches of 20 with a step of 16 in images of 50.
STARTS = "s AS (SELECT unnest([0, 16, 30]) AS at)"
#: Numbers of two classes of every window, multiples of 1/128: equal in 32 and 64 bits.
SAID = f"{STARTS}, said AS (SELECT img, row_no, col_no, lab, k.range AS class, max((v1 + v2 * k.range + y.at * 3 + x.at) % 128) AS p FROM pixels JOIN s y ON row_no BETWEEN y.at AND y.at + 19 JOIN s x ON col_no BETWEEN x.at AND x.at + 19, range(2) k GROUP BY 1, 2, 3, 4, 5)"
OVERLAPPING = f"{SAID}, pr AS (SELECT img, row_no, col_no, any_value(lab) AS lab, CAST(arg_max(class, p * 10 - class) AS BIGINT) AS predicted FROM said GROUP BY 1, 2, 3)"
STITCHED = "st AS (SELECT img, row_no, col_no, CAST(lab AS BIGINT) AS lab, CAST((v1 + row_no * 5 + col_no + floor((row_no - 5) / 10) * 30 + floor((col_no - 5) / 10) * 10) % 3 AS BIGINT) AS predicted FROM pixels WHERE row_no BETWEEN 5 AND {last} AND col_no BETWEEN 5 AND {last})"


def report_sql(pairs: str, n: int) -> str:
    return CM.replace("label_pixels", "q").replace("range(7)", f"range({n})").replace("cells AS", f"q AS ({pairs}), cells AS") + REPORT


def bands(p):
    return S.stack_bands(cut(p, "v1"), cut(p, "v2"))


def response_model():
    """A stand-in model: the numbers of two classes from both channels and the window's place."""

    def score(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        place = (at[:, 0] * 3 + at[:, 1])[:, None, None]
        return np.stack([(x[..., 0] + x[..., 1] * k + place) % 128 / 128 for k in (0, 1)], 3)

    return score


def class_model():
    """A stand-in model: one of three classes from the first channel, the pixel's and the window's place."""

    def score(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        row = at[:, 0][:, None, None] + np.arange(x.shape[1])[None, :, None]
        col = at[:, 1][:, None, None] + np.arange(x.shape[2])[None, None, :]
        found = (np.nan_to_num(x[..., 0]) + row * 5 + col + at[:, 0][:, None, None] * 3 + at[:, 1][:, None, None]) % 3
        return np.eye(3, dtype=np.float32)[found.astype(int)]

    return score


def overlapping(p):
    return S.predict_overlapping(bands(p), window_sizes(p), BOX, response_model, size=SIZE)


def half_stride(p):
    """Half-stride windows up to one flush with the edge."""
    axis = F.explode(F.sequence(F.lit(0), F.lit(30), F.lit(10)))
    return p.select("img").distinct().select("img", axis.alias("x1")).select("img", "x1", axis.alias("y1"))


def patches(p):
    axis = F.explode(F.array(*[F.lit(k) for k in (0, 16, 30)]))
    return p.select("img").distinct().select("img", axis.alias("x1")).select("img", "x1", axis.alias("y1"))


def stitched(p):
    found = S.score_windows(bands(p), half_stride(p), (BOX, BOX), class_model, SIZE, centre=True)
    return S.class_blocks(found)


def mosaic_rows(blocks, name: str):
    """Pixels counted from the mosaic's first one."""
    return B.to_pixels(blocks).select("img", (F.col("row_no") - BOX // 4).alias("row_no"), (F.col("col_no") - BOX // 4).alias("col_no"), F.col("v").cast("long").alias(name))


@query("a17_max_merge_blocks", "pixels", sql=f"WITH {SAID} SELECT img, row_no, col_no, class, CAST(p / 128.0 AS DOUBLE) AS p FROM said")
def _(p):
    return S.to_pixels(S.score_windows(bands(p), patches(p), (BOX, BOX), response_model, SIZE))


@query("e2_overlapping_blocks", "pixels", sql=f"WITH {OVERLAPPING} SELECT img, row_no, col_no, CAST(predicted AS INTEGER) AS predicted FROM pr")
def _(p):
    return B.to_pixels(overlapping(p)).withColumnRenamed("v", "predicted")


@query("e4_overlapping_blocks_report", "pixels", sql=f"WITH {OVERLAPPING}, {report_sql('SELECT CAST(lab AS BIGINT) AS actual, predicted FROM pr', 2)}")
def _(p):
    return rounded_report(S.report(overlapping(p), cut(p, "lab"), 2))


@query("w7_stitch_blocks", "pixels", sql=f"WITH {STITCHED.format(last=44)} SELECT img, row_no - 5 AS row_no, col_no - 5 AS col_no, predicted FROM st")
def _(p):
    return mosaic_rows(stitched(p), "predicted")


@query("w8_mosaic_labels_blocks", "pixels", sql=f"WITH {STITCHED.format(last=44)} SELECT img, row_no - 5 AS row_no, col_no - 5 AS col_no, lab AS actual FROM st")
def _(p):
    return mosaic_rows(B.combine_blocks(cut(p, "lab"), stitched(p), lambda a, b: a), "actual")


@query("e3_stitched_blocks", "pixels", sql=f"WITH {STITCHED.format(last=34)} SELECT img, row_no - 5 AS row_no, col_no - 5 AS col_no, predicted FROM st")
def _(p):
    return mosaic_rows(S.predict_stitched(bands(p), window_sizes(p), BOX, class_model, SIZE), "predicted")


@query("e5_stitched_blocks_report", "pixels", sql=f"WITH {STITCHED.format(last=34)}, {report_sql('SELECT lab AS actual, predicted FROM st', 3)}")
def _(p):
    return rounded_report(S.report(S.predict_stitched(bands(p), window_sizes(p), BOX, class_model, SIZE), cut(p, "lab"), 3))


@query("a11_moments_blocks", "pixels", sql="SELECT img, c.range AS channel, count(*) AS n, round(avg(CASE c.range WHEN 0 THEN v1 ELSE v2 END), 6) AS mean, round(stddev_pop(CASE c.range WHEN 0 THEN v1 ELSE v2 END), 6) AS deviation FROM pixels, range(2) c GROUP BY 1, 2")
def _(p):
    return S.channel_moments(bands(p)).select("img", "channel", "n", r6(F.col("mean"), "mean"), r6(F.sqrt(F.col("m2") / F.col("n")), "deviation"))


@query("a9_channel_means_blocks", "pixels", sql="WITH a AS (SELECT img, c.range AS channel, avg(CASE c.range WHEN 0 THEN v1 ELSE v2 END) AS m FROM pixels, range(2) c GROUP BY 1, 2) SELECT channel, round(avg(m), 6) AS mean FROM a GROUP BY 1")
def _(p):
    return S.channel_means(bands(p)).select("channel", r6(F.col("mean"), "mean"))


@query("r11_downsample_blocks", "pixels", sql="""WITH t AS (SELECT i.range AS i, (i.range + 0.5) * 2.5 - 0.5 AS y FROM range(20) i), taps AS (SELECT i, CAST(floor(y) AS BIGINT) AS at, 1 - (y - floor(y)) AS wt FROM t UNION ALL SELECT i, CAST(floor(y) AS BIGINT) + 1, y - floor(y) FROM t)
 SELECT img, r.i AS row_no, c.i AS col_no, CAST(round(sum(r.wt * c.wt * v1), 6) AS DOUBLE) AS p FROM taps r, taps c, pixels WHERE r.wt * c.wt > 0 AND row_no = r.at AND col_no = c.at GROUP BY 1, 2, 3""")
def _(p):
    """Images over nine blocks, made smaller over four; of an image's last row pixels may be missing, and so may new ones."""
    small = S.resize_stacks(S.stack_bands(cut(p, "v1")), window_sizes(p), 20, 20, SIZE)
    return S.to_pixels(small).select("img", "row_no", "col_no", F.round("p", 6).alias("p"))


@query("w2_random_crop_blocks", "pixels", sql="SELECT img, row_no - img * 7919 % 31 AS row_no, col_no - (img * 7919 + 1) % 21 AS col_no, CAST(c.range AS BIGINT) AS class, CAST(CASE c.range WHEN 0 THEN v1 ELSE v2 END AS DOUBLE) AS p FROM pixels, range(2) c WHERE row_no BETWEEN img * 7919 % 31 AND img * 7919 % 31 + 19 AND col_no BETWEEN (img * 7919 + 1) % 21 AND (img * 7919 + 1) % 21 + 29")
def _(p):
    return S.to_pixels(S.random_crops(bands(p), window_sizes(p), 20, 30, 3, F.col("img") * 7919, SIZE))


@query("r12_outline_blocks", "parcels", sql="""WITH b AS (SELECT id, damage_class, minx, maxx, miny, maxy, unnest(range(minx, maxx + 1)) AS x FROM parcels), c AS (SELECT *, unnest(range(miny, maxy + 1)) AS y FROM b)
 SELECT y AS row_no, x AS col_no, CAST(arg_max(damage_class, id) AS INTEGER) AS class FROM c WHERE x = minx OR x = maxx OR y = miny OR y = maxy GROUP BY 1, 2""")
def _(p):
    d = as_rings(p).join(p.select("id", F.col("damage_class").alias("class")), "id").withColumns({"img": F.lit(0).cast("long"), "order": F.col("id")})
    return B.to_pixels(raster.outline_blocks(d, 64)).select("row_no", "col_no", F.col("v").alias("class"))


@query("r12_instance_masks", "parcels", sql="SELECT id, damage_class AS class, CAST(minx AS DOUBLE) AS x1, CAST(maxy AS DOUBLE) AS y2, miny AS row0, minx AS col0, maxy - miny + 1 AS h, maxx - minx + 1 AS w, 2 * (maxy - miny + maxx - minx) AS pixels FROM parcels")
def _(p):
    d = as_rings(p).join(p.select("id", F.col("damage_class").alias("class")), "id")
    # two hexadecimal digits a pixel, of which outline pixels have one 1
    drawn = F.length(F.regexp_replace(F.hex("mask"), "0", ""))
    return raster.instance_masks(d.select("id", "class", "ring")).select("id", "class", "x1", "y2", "row0", "col0", "h", "w", drawn.cast("long").alias("pixels"))


@query("s12_geotiff", "pixels", sql="SELECT img, row_no, col_no, c.range AS class, CAST(CASE c.range WHEN 0 THEN v1 ELSE v2 END AS DOUBLE) AS p, 1000 + img * 100 + 0.5::DOUBLE * (col_no + 0.5) AS x, 9000 - 0.5::DOUBLE * (row_no + 0.5) AS y, 32632 AS epsg FROM pixels, range(2) c")
def _(p):
    """Each image as a GeoTIFF file of two bands, in tiles or strips; read in blocks, with the place of every pixel from the file's own transform."""
    images = S.stack_bands(B.to_blocks(p, "v1", 50), B.to_blocks(p, "v2", 50))

    def encoded(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], np.float32).reshape(r["h"], r["w"], r["channels"])
                where = (0.5, 0.0, 1000.0 + r["img"] * 100, 0.0, -0.5, 9000.0)
                body = geotiff.encode(np.where(np.isnan(a), -1, a).astype(np.int16), where, 32632, tile=16 if r["img"] % 2 else None, rows=7, nodata=-1)
                yield pa.RecordBatch.from_arrays([pa.array([f"r{r['img']}.tif"]), pa.array([body])], names=["name", "body"])

    path = folder(p, "rasters")
    sinks.write_files(images.mapInArrow(encoded, "name string, body binary"), path)
    stacks, profile, _ = geotiff.read_geotiff(p.sparkSession, path, SIZE)
    of = profile.select("img", F.substring("stem", 2, 20).cast("long").alias("_img"), *"abcdef", F.col("epsg").cast("int").alias("epsg"))
    px = S.to_pixels(stacks).join(of, "img")
    x, y = F.col("col_no") + 0.5, F.col("row_no") + 0.5
    return px.select(F.col("_img").alias("img"), "row_no", "col_no", "class", "p", (F.col("a") * x + F.col("b") * y + F.col("c")).alias("x"), (F.col("d") * x + F.col("e") * y + F.col("f")).alias("y"), "epsg")

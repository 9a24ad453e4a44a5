"""Tile annotation jobs: features of images to annotation records of tiles, by preset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import boxes as B
from tilewright.functions import geometry as G
from tilewright.functions.kernels import keep_intersecting
from tilewright.operators import manifests, windows
from tilewright.operators.vector import clipped_bounds, with_bounds

#: How each preset cuts edge tiles, and whether it keeps every tile that a feature meets or only those with a box left.
PRESETS = {"harvey": ("short", True), "roof": ("short", False), "tank": ("full", False), "tank_negative": ("skip", False)}


def tile_annotations(features: DataFrame, images: DataFrame, size: int, preset: str, name: str = "tile") -> tuple[DataFrame, DataFrame]:
    """(boxes, records) of a preset.

    ``features`` has img, id, category and ring, in pixels of the image; ``images`` img, h and w. Images are cut into tiles, features that
    share a point with a tile are clipped to it, their bounds become whole pixels of the tile, the preset's size rule drops boxes,
    and each kept tile has one record of its boxes. ``boxes``: img, tile_no, img_name, box_id, category, x1, y1, x2, y2. ``records``: img_name, bboxes. Every
    step is a row-wise expression, but for one grid join and one grouping by tile.
    """
    edge, keeps_all = PRESETS[preset]
    tiles = windows.tiles(images.withColumnRenamed("img", "img_id"), size, edge).select(F.col("img_id").alias("img"), "tile_no", F.col("x0").alias("minx"), F.col("y0").alias("miny"), (F.col("x0") + size).alias("maxx"), (F.col("y0") + size).alias("maxy"))
    shapes = with_bounds(features.withColumn("parts", F.array("ring"))).drop("ring")
    corners = [F.col(f"b_{c}").cast("double") for c in ("minx", "miny", "maxx", "maxy")]
    met = G.spatial_join(shapes, tiles, float(size), by="img").withColumn("b_parts", F.array(G.box_ring(*corners)))
    met = keep_intersecting(met, "a_parts", "b_parts", True, True, drop=False)
    # behind a generator the bounds are computed once; filters on them would otherwise be pushed down and repeat them
    cut = met.select("*", F.explode(F.array(clipped_bounds(F.get("a_parts", F.lit(0)), *corners))).alias("c")).where("c is not null")
    pixel = lambda c, low: (F.col(f"c.{c}") - F.col(low)).cast("int")
    found = cut.select(F.col("a_img").alias("img"), F.col("b_tile_no").alias("tile_no"), F.format_string(f"{name}_%d_%06d", "a_img", "b_tile_no").alias("img_name"), F.col("a_id").alias("box_id"), F.col("a_category").alias("category"), pixel("minx", "b_minx").alias("x1"), pixel("miny", "b_miny").alias("y1"), pixel("maxx", "b_minx").alias("x2"), pixel("maxy", "b_miny").alias("y2"))
    kept = found.where(B.preset(preset))
    of = (found if keeps_all else kept).select("img_name").distinct()
    return kept, manifests.records(kept, of)

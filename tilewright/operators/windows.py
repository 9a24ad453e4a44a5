"""Tiles, sliding windows and their stitching, as sequences exploded per image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_boxes(sizes: DataFrame, box_w: int, box_h: int, stride: float, offset: tuple[int, int] = (0, 0), as_fraction: bool = False, boundary: tuple[int, int, int, int] = (0, 0, 0, 0), centre: bool = False, padding: bool = False) -> DataFrame:
    """Windows of every image (img_id, h, w), x-major: starts from the offset while the window's end stays below the edge.

    A stride as a fraction f is an overlap: round(size * (1 - f)) pixels. ``boundary`` (left, top, right, bottom) keeps windows that
    far from the edges, or, with ``centre``, keeps their centres that far; centres also keep half a window's distance, unless ``padding`` lets
    windows reach outside the image. Without padding an image that is not larger than a window gives none.
    """
    step_x, step_y = (round(box_w * (1 - stride)), round(box_h * (1 - stride))) if as_fraction else (int(stride), int(stride))
    if step_x < 1 or step_y < 1 or not 0 <= offset[0] < step_x or not 0 <= offset[1] < step_y:
        raise ValueError("the stride must be positive and larger than the offset")
    if min(boundary) < 0 or (padding and not centre):
        raise ValueError("boundaries must not be negative, and padding needs boundaries of centres")

    def starts(size: Column, box: int, first: int, before: int, after: int, step: int) -> Column:
        if centre and not padding:
            before, after = max(box // 2, before), max(box // 2 + box % 2, after)
        elif not centre:
            after += box
        low, back = before + first, box // 2 if centre else 0
        last = size - after - (step - first) % step - 1
        fits = last >= low if padding else (last >= low) & (size > box)
        return F.when(fits, F.sequence(F.lit(low - back).cast("long"), (last - back).cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    left, top, right, bottom = boundary
    xs = sizes.select("img_id", "h", F.explode(starts(F.col("w"), box_w, offset[0], left, right, step_x)).alias("x1"))
    both = xs.select("img_id", "x1", F.explode(starts(F.col("h"), box_h, offset[1], top, bottom, step_y)).alias("y1"))
    return both.select("img_id", "x1", "y1", (F.col("x1") + box_w).alias("x2"), (F.col("y1") + box_h).alias("y2"))


def too_small(sizes: DataFrame, box_w: int, box_h: int) -> DataFrame:
    """Images that hold no window."""
    return sizes.where((F.col("w") < box_w) | (F.col("h") < box_h))


def tiles(sizes: DataFrame, size: int, edge: str = "short") -> DataFrame:
    """Disjoint tiles of an image: edge tiles short, shifted back to full size ("full"), or left out with their number used up ("skip")."""
    axis = lambda d: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), d - 1).cast("long"), F.lit(size).cast("long")))
    grid = sizes.select("img_id", "h", "w", axis(F.col("w")).alias("x0")).select("*", axis(F.col("h")).alias("y0"))
    across = F.ceil(F.col("h") / size)
    grid = grid.withColumn("tile_no", (F.expr(f"x0 div {size}") * across + F.expr(f"y0 div {size}")).cast("long"))
    if edge == "full":
        grid = grid.withColumns({"x0": F.greatest(F.lit(0), F.least("x0", F.col("w") - size)).cast("long"), "y0": F.greatest(F.lit(0), F.least("y0", F.col("h") - size)).cast("long")})
    if edge == "skip":
        grid = grid.where((F.col("x0") + size <= F.col("w")) & (F.col("y0") + size <= F.col("h")))
    return grid.select("img_id", "tile_no", "x0", "y0", F.least(F.lit(size), F.col("w") - F.col("x0")).cast("long").alias("tile_w"), F.least(F.lit(size), F.col("h") - F.col("y0")).cast("long").alias("tile_h"))


def clamped_patches(sizes: DataFrame, patch: int, share: float = 0.8) -> DataFrame:
    """Overlapping patches with step int(share * patch), the last ones moved back to the edge; images smaller than a patch give none."""
    step = int(share * patch)

    def starts(size: Column) -> Column:
        raw = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), size - 1).cast("long"), F.lit(step).cast("long"))
        return F.explode(F.array_distinct(F.transform(raw, lambda s: F.least(s, (size - patch).cast("long")))))

    fits = sizes.where((F.col("w") >= patch) & (F.col("h") >= patch))
    return fits.select("img_id", "h", starts(F.col("w")).alias("x0")).select("img_id", "x0", starts(F.col("h")).alias("y0"))


def crop(pixels: DataFrame, row0: Column | int, col0: Column | int, h: int, w: int) -> DataFrame:
    """Pixels of a crop, numbered from its corner."""
    r, c = F.col("row_no") - row0, F.col("col_no") - col0
    return pixels.where((r >= 0) & (r < h) & (c >= 0) & (c < w)).withColumns({"row_no": r, "col_no": c})


def random_offset(image: str, room: Column, seed: int, key: Column | None = None) -> Column:
    """A reproducible offset from 0 to room for each image, from a hash of it or from a whole number of one's own."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(image)) if key is None else key, room + 1)


def random_crop(pixels: DataFrame, sizes: DataFrame, h: int, w: int, seed: int, key: Column | None = None) -> DataFrame:
    """A crop of h x w pixels from each image (img, h, w in ``sizes``) at a reproducible place; images smaller on either side are left out."""
    fits = sizes.where((F.col("h") >= h) & (F.col("w") >= w))
    rows = random_offset("img", F.col("h") - h, seed, key)
    cols = random_offset("img", F.col("w") - w, seed + 1, None if key is None else key + 1)
    at = fits.select("img", rows.alias("_r"), cols.alias("_c"))
    return crop(pixels.join(at, "img"), F.col("_r"), F.col("_c"), h, w).drop("_r", "_c")


def window_of_pixel(x: Column, box: int) -> Column:
    """Start of the only half-stride window whose centre half holds the pixel."""
    half, quarter = box // 2, box // 4
    return F.floor((x - quarter) / half) * half


def stitch(responses: DataFrame, box: int) -> DataFrame:
    """Of half-stride window responses (win_row, win_col, row_no, col_no in the image) keep each pixel's centre window.

    Each pixel of the mosaic lies in one window's centre half, so this is a filter. Rows and columns are counted from (box/4, box/4).
    """
    own = (F.col("win_row") == window_of_pixel(F.col("row_no"), box)) & (F.col("win_col") == window_of_pixel(F.col("col_no"), box))
    q = box // 4
    return responses.where(own).withColumns({"row_no": F.col("row_no") - q, "col_no": F.col("col_no") - q}).drop("win_row", "win_col")


def labels_of_mosaic(mosaic: DataFrame, labels: DataFrame, box: int) -> DataFrame:
    q = box // 4
    moved = labels.withColumns({"row_no": F.col("row_no") - q, "col_no": F.col("col_no") - q})
    return mosaic.join(moved, ["img", "row_no", "col_no"])


def max_merge(responses: DataFrame) -> DataFrame:
    """Elementwise maximum, at least 0, of overlapping responses (img, row_no, col_no, class, p)."""
    return responses.groupBy("img", "row_no", "col_no", "class").agg(F.greatest(F.lit(0.0), F.max("p")).alias("p"))


def predicted_class(merged: DataFrame) -> DataFrame:
    """The class of the highest merged response; the lower class of equals."""
    best = F.max_by("class", F.struct(F.col("p"), -F.col("class")))
    return merged.groupBy("img", "row_no", "col_no").agg(best.alias("predicted"))

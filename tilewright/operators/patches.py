"""Tables of patches: foreground shares, look-ups by name, orders and sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.evaluate import channel_means
from tilewright.operators.manifests import file_name
from tilewright.plans.order import prefix_sum


def foreground(columns: list[str]) -> Column:
    """Sum of all foreground columns; a null counts as 0."""
    return reduce(lambda a, c: a + F.coalesce(F.col(c), F.lit(0)), columns, F.lit(0))


def foreground_ratio(columns: list[str], background: str = "background") -> Column:
    """Foreground over foreground and background; null for a patch without pixels."""
    return F.try_divide(foreground(columns), foreground(columns) + F.col(background))


def without_foreground(patches: DataFrame, columns: list[str]) -> DataFrame:
    """Background patches: the sum of all foreground columns is 0."""
    return patches.where(foreground(columns) == 0)


def not_all_background(patches: DataFrame, background: str = "background", full: int = 1_000_000) -> DataFrame:
    """Patches whose background is not a full patch."""
    return patches.where(F.col(background) != full)


def positive_share(patches: DataFrame, columns: list[str], threshold: float, background: str = "background") -> DataFrame:
    """One row: share of the patches whose foreground ratio exceeds the threshold."""
    return patches.agg((F.count_if(foreground_ratio(columns, background) > threshold) / F.count("*")).alias("share"))


def patches_per_category(patches: DataFrame, columns: list[str], key: str = "pos") -> DataFrame:
    """(category, n): patches in which a category has pixels."""
    return patches.unpivot([key], columns, "category", "pixels").groupBy("category").agg(F.count_if(F.col("pixels") > 0).alias("n"))


def nonzero_ratio(pixels: DataFrame, value: str, image: str = "img") -> DataFrame:
    """(image, ratio, empty) of each mask."""
    return pixels.groupBy(image).agg((F.count_if(F.col(value) != 0) / F.count("*")).alias("ratio"), F.bool_and(F.col(value) == 0).alias("empty"))


def duplicate_names(paths: DataFrame, path: str = "url") -> DataFrame:
    """One row: how many paths, and how many different file names (n, names)."""
    return paths.agg(F.count("*").alias("n"), F.count_distinct(file_name(F.col(path))).alias("names"))


def scale_pixels(value: Column) -> Column:
    """0 to 255 as -1 to 1."""
    return value / 127.5 - 1


def remap(value: Column, old: int, new: int) -> Column:
    return F.when(value == old, new).otherwise(value)


def subtract_means(pixels: DataFrame, channels: list[str], image: str = "img") -> DataFrame:
    """Channels less their global mean (every image weighs the same), over 255."""
    means = channel_means(pixels, image, channels).select(*[F.col(c).alias(f"_{c}") for c in channels])
    return pixels.join(F.broadcast(means)).withColumns({c: (F.col(c) - F.col(f"_{c}")) / 255 for c in channels}).drop(*[f"_{c}" for c in channels])


def with_patch_file(stats: DataFrame, name: str = "filename") -> DataFrame:
    """Add patch_id: the patch's image file."""
    return stats.withColumn("patch_id", F.concat(name, F.lit(".jpg")))


def in_bounds(stats: DataFrame, bounds: DataFrame, name: str = "filename", path: str = "url") -> DataFrame:
    """Rows whose patch file is among the paths' file names."""
    return with_patch_file(stats, name).join(bounds.select(file_name(F.col(path)).alias("patch_id")), "patch_id", "left_semi")


def attach_labels(stats: DataFrame, labels: DataFrame, label_key: str, name: str = "filename") -> DataFrame:
    """Label rows of each patch, by its file."""
    return with_patch_file(stats, name).join(labels, F.col("patch_id") == F.col(label_key))


def attach(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with what the right side has for them, or nulls; the keys it lacks)."""
    same = left[left_key] == right[right_key]
    return left.join(right, same, "left"), left.select(left_key).join(right, same, "left_anti")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many different values two one-column tables share (n)."""
    return a.intersect(b).agg(F.count("*").alias("n"))


def rest(every: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not chosen, such as training rows beside a validation set."""
    return every.join(chosen.select(key), key, "left_anti")


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows of lists or manifests; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def hardest(losses: DataFrame, n: int, loss: str = "loss", unique: str = "patch_name") -> DataFrame:
    """The n rows of highest loss; of equals, the first names."""
    return losses.orderBy(F.desc(loss), unique).limit(n)


def patch_names(patches: DataFrame, order: list, out: str = "patch", parity: bool = False) -> DataFrame:
    """Add sequential names of patch files, with six digits at least; ``parity``: the first six only, as the query's SQL has them, so names recur from a million patches on."""
    number = F.lpad(F.col("_n").cast("string"), 6, "0") if parity else F.format_string("%06d", "_n")
    return prefix_sum(patches, order, out="_n").withColumn(out, F.concat(F.lit("patch_"), number, F.lit(".jpg"))).drop("_n")

"""Manifests as long tables (dataset, split, pos, image, label, probability), and joins on file stems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.plans.order import hash_key, prefix_sum


def path_of(prefix: Column, item: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(prefix, "/+$", ""), item)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name up to its first dot."""
    return F.substring_index(file_name(path), ".", 1)


def paired(images: DataFrame, masks: DataFrame, image: str = "image", label: str = "label") -> DataFrame:
    """Images and masks of equal stem."""
    a = images.select(stem(F.col(image)).alias("stem"), image)
    return a.join(masks.where(F.col(label).isNotNull()).select(stem(F.col(label)).alias("stem"), label), "stem")


def orphans(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Files of the left side whose stem the right side lacks."""
    return left.withColumn("stem", stem(F.col(a))).join(right.select(stem(F.col(b)).alias("stem")).where("stem is not null"), "stem", "left_anti")


def image_of_mask(mask: Column, drop: int = 4) -> Column:
    """A mask's stem without its last characters."""
    s = stem(mask)
    return F.substring(s, F.lit(1), F.greatest(F.lit(0), F.length(s) - drop))


def lookup(keys: DataFrame, stats: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``stats`` for the keys, and the keys it lacks."""
    return keys.join(stats, key), keys.join(stats, key, "left_anti")


def first_url(names: DataFrame, urls: DataFrame) -> DataFrame:
    """For each name the URL first listed (lowest pos) with that file name; null where there is none."""
    first = urls.groupBy(file_name(F.col("url")).alias("name")).agg(F.min_by("url", "pos").alias("url"))
    return names.join(first, "name", "left")


def merge(one: DataFrame, two: DataFrame, key: list | None = None, seed: int = 0) -> DataFrame:
    """Rows of two manifests shuffled within each split; metadata is the first one's."""
    both = one.unionByName(two.withColumn("dataset", F.lit(None).cast("string")), allowMissingColumns=True)
    name = one.agg(F.max("dataset").alias("_d"))
    ranked = prefix_sum(both, ["split", *(key or [hash_key(seed, "split", "pos"), "pos"])], out="_rank")
    start = ranked.groupBy("split").agg(F.min("_rank").alias("_s"))
    return ranked.join(F.broadcast(start), "split").join(F.broadcast(name)).withColumns({"pos": F.col("_rank") - F.col("_s"), "dataset": F.col("_d")}).drop("_rank", "_s", "_d")


def by_rank(*sides: tuple[DataFrame, list]) -> DataFrame:
    """Rows of several tables side by side by their places in their own orders."""
    ranked = [prefix_sum(df, order, out="rank") for df, order in sides]
    return reduce(lambda a, b: a.join(b, "rank"), ranked)


def records(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """One annotation record for each image, its boxes sorted; an image without boxes has an empty list."""
    box = F.struct("box_id", "category", "x1", "x2", "y1", "y2")
    lists = boxes.groupBy("img_name").agg(F.array_sort(F.collect_list(box)).alias("bboxes"))
    none = F.array().cast(lists.schema["bboxes"].dataType)
    return images.join(lists, "img_name", "left").withColumn("bboxes", F.coalesce("bboxes", none))

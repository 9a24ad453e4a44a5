"""Splits, samples and sampling probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.plans.order import hash_key, prefix_sum, rank_within


def shuffled(df: DataFrame, key: list | None = None, seed: int = 0, unique: str = "pos") -> DataFrame:
    """Add ``rank``: the place of each row, from 0, in a reproducible shuffle."""
    return prefix_sum(df, key or [hash_key(seed, unique), F.col(unique)], out="rank")


def split(df: DataFrame, ratios: dict[str, float], key: list | None = None, seed: int = 0, unique: str = "pos") -> DataFrame:
    """Exact splits of a shuffle: each gets int(n * ratio) rows in turn; the rest is dropped."""
    n, low, name = df.count(), 0, F.lit(None).cast("string")
    for part, ratio in ratios.items():
        high = low + int(n * ratio)
        name = F.when((F.col("rank") >= low) & (F.col("rank") < high), part).otherwise(name)
        low = high
    return shuffled(df, key, seed, unique).withColumn("split", name).where("split is not null")


def sample_validation(df: DataFrame, n: int, key: list | None = None, seed: int = 0, unique: str = "pos") -> DataFrame:
    """Exactly n rows (or all, if fewer) are validation, the others training; a row's columns stay together."""
    return shuffled(df, key, seed, unique).withColumn("split", F.when(F.col("rank") < n, "validation").otherwise("training"))


def ratio_bucket(ratio: Column, threshold: float, closed: bool = False) -> Column:
    """negative without foreground, positive above the threshold (or at it, when closed), else median."""
    above = ratio >= threshold if closed else ratio > threshold
    return F.when(ratio == 0, "negative").when(above, "positive").otherwise("median")


def bucket_probabilities(df: DataFrame, ratio: Column, threshold: float, by: list[str], weights: DataFrame | None = None, closed: bool = False) -> DataFrame:
    """Add bucket and probability: a third of the group's weight, shared by the rows of a bucket.

    ``weights`` gives each group of ``by`` its share as column weight; otherwise each group sums to 1.
    """
    marked = df.withColumn("bucket", ratio_bucket(ratio, threshold, closed))
    counts = marked.groupBy(*by, "bucket").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_w", F.lit(1.0)) if weights is None else counts.join(F.broadcast(weights), by).withColumnRenamed("weight", "_w")
    p = F.col("_w") / (3 * F.col("_n"))
    return marked.join(F.broadcast(counts), [*by, "bucket"]).withColumn("probability", p).drop("_n", "_w")


def positive_negative(df: DataFrame, positive: Column, n: int, factor: float, key: list, unique: str = "pos") -> DataFrame:
    """n positives and n negatives by hash order are validation; of the rest p(positive) = 1/S, p(negative) = factor/(S * negatives), S = positives + factor."""
    marked = df.withColumn("positive", positive)
    both = rank_within(marked.where("positive is not null"), ["positive"], key, few=True).withColumn("split", F.when(F.col("rank") < n, "validation").otherwise("training"))
    totals = both.where("split = 'training'").agg(F.count_if("positive").alias("np"), F.count_if(~F.col("positive")).alias("nn"))
    s = F.col("np") + F.lit(float(factor))
    p = F.when(F.col("split") == "training", F.when(F.col("positive"), 1 / s).otherwise(F.try_divide(F.lit(float(factor)), s * F.col("nn"))))
    return both.join(F.broadcast(totals)).withColumn("probability", p).drop("np", "nn")


def category_quotas(df: DataFrame, categories: list[str], quota: int, key: list[Column], unique: str = "pos", parity: bool = False) -> DataFrame:
    """(pos, split): of each category's patches the first ``quota`` by hash order are validation, the others training.

    A patch of several categories can be on both sides; validation wins, unless parity keeps both.
    """
    wanted = F.filter(F.array(*[F.when(F.col(c) > 0, c) for c in categories]), lambda c: c.isNotNull())
    ranked = rank_within(df.withColumn("_category", F.explode(wanted)), ["_category"], key, few=True)
    both = ranked.select(unique, F.when(F.col("rank") < quota, "validation").otherwise("training").alias("split")).distinct()
    if parity:
        return both
    return both.groupBy(unique).agg(F.max("split").alias("split"))


def rank_ranges(df: DataFrame, ranges: dict[str, int], key: list, unique: str = "pos") -> DataFrame:
    """The first rows of a shuffle go to the first name, the next to the second, and so on; the rest is dropped."""
    low, name = 0, F.lit(None).cast("string")
    ranked = prefix_sum(df, key, out="rank")
    for part, n in ranges.items():
        name = F.when((F.col("rank") >= low) & (F.col("rank") < low + n), part).otherwise(name)
        low += n
    return ranked.withColumn("split", name).where("split is not null")


def bucket_counts(df: DataFrame, foreground: Column, total: Column, ratio: float) -> DataFrame:
    """One row: rows above the ratio, between 0 and it, and without foreground; a row at the ratio counts nowhere."""
    r = F.try_divide(foreground, total)
    return df.agg(F.count_if(r > ratio).alias("positive"), F.count_if((r > 0) & (r < ratio)).alias("median"), F.count_if(foreground == 0).alias("negative"))


def keep_some_empty(df: DataFrame, keep: int, of: int, key: Column) -> DataFrame:
    """Empty tiles kept with probability about keep/of, reproducibly, each with the box (0, 0, 1, 1)."""
    kept = df.where(F.pmod(key, F.lit(of)) >= of - keep)
    return kept.withColumns({"x1": F.lit(0), "y1": F.lit(0), "x2": F.lit(1), "y2": F.lit(1)})


def mix_negatives(positive: DataFrame, negative: DataFrame, order: list, times: int = 4) -> DataFrame:
    """All positive rows and, in the given order, the first ``times`` as many negative ones; origin tells which."""
    n = positive.agg((F.count("*") * times).alias("_n"))
    first = prefix_sum(negative, order, out="_r").join(F.broadcast(n)).where("_r < _n").drop("_r", "_n")
    return positive.withColumn("origin", F.lit("images")).unionByName(first.withColumn("origin", F.lit("images_negative")), allowMissingColumns=True)


def blank_annotations(images: DataFrame) -> DataFrame:
    """One row without a box for each background image."""
    return images.withColumns({"category": F.lit(None).cast("string"), **{c: F.lit(None).cast("int") for c in ("x1", "y1", "x2", "y2")}})


def first_of_each(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group, with their ``rank`` from 0; fewer where there are fewer. Each task sends on no more than n rows of a group."""
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n)
    return first.withColumn("rank", F.col("_n") - 1).drop("_n")


def class_list(names: str) -> list[dict]:
    """{index, name} of a comma-separated list."""
    return [{"index": i, "name": n.strip()} for i, n in enumerate(names.split(","))]

"""Confusion matrices and class statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_matrix(pairs: DataFrame, n: int, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(actual, predicted, n) over all n*n cells; pairs outside 0..n-1 are dropped, empty cells are 0."""
    spark = pairs.sparkSession
    inside = F.col(actual).between(0, n - 1) & F.col(predicted).between(0, n - 1)
    counts = pairs.where(inside).groupBy(F.col(actual).cast("long").alias("actual"), F.col(predicted).cast("long").alias("predicted")).agg(F.count("*").alias("n"))
    cells = spark.range(n * n).select(F.expr(f"id div {n}").alias("actual"), (F.col("id") % n).alias("predicted"))
    return cells.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def accuracy(cm: DataFrame) -> DataFrame:
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    return cm.agg(F.try_divide(hit, F.sum("n")).alias("accuracy"))


def class_report(cm: DataFrame, orientation: str = "actual") -> DataFrame:
    """Per class precision, recall, F1 (0 where undefined) and the number of samples.

    ``orientation="predicted"`` counts samples by predictions and swaps precision and recall.
    """
    rows = cm.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("row"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    cols = cm.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("col"))
    r = rows.join(cols, "class")
    of_row, of_col = F.coalesce(F.try_divide("hit", "row"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "col"), F.lit(0.0))
    recall, precision, samples = (of_row, of_col, "row") if orientation == "actual" else (of_col, of_row, "col")
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("row") + F.col("col")), F.lit(0.0))
    return r.select("class", recall.alias("recall"), precision.alias("precision"), f1.alias("f1"), F.col(samples).alias("number_samples"))


def class_histogram(pixels: DataFrame, label: str) -> DataFrame:
    """(class, n, share) of all label pixels."""
    counts = pixels.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("class", "n", (F.col("n") / F.col("total")).alias("share"))


def class_weights(histogram: DataFrame, mu: float = 0.15) -> DataFrame:
    """max(1, ln(mu / share)); null for a class without pixels."""
    weight = F.greatest(F.lit(1.0), F.ln(F.lit(mu) / F.nullif(F.col("share"), F.lit(0.0))))
    return histogram.select("class", F.when(F.col("n") > 0, weight).alias("weight"))


def kl_rows(actual: Column, predicted: Column, eps: float = 1e-7) -> Column:
    """Kullback-Leibler divergence of two arrays after adding eps and normalising each."""

    def norm(a: Column) -> Column:
        total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x + eps)
        return F.transform(a, lambda x: (x + eps) / total)

    return F.aggregate(F.zip_with(norm(actual), norm(predicted), lambda p, q: p * F.ln(p / q)), F.lit(0.0), lambda s, x: s + x)


def argmax(probs: Column, threshold: float = 0.5) -> Column:
    """Class of a probability vector, the first of equals; a single channel is compared with the threshold."""
    one = (F.get(probs, F.lit(0)) > threshold).cast("long")
    return F.when(F.size(probs) == 1, one).otherwise(F.array_position(probs, F.array_max(probs)) - 1)


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins; the last is closed, values outside are dropped, empty bins are 0."""
    width = (high - low) / bins
    b = F.least(F.lit(bins - 1), F.floor((value - low) / width)).cast("long")
    counts = df.where((value >= low) & (value <= high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def channel_means(pixels: DataFrame, image: str, channels: list[str]) -> DataFrame:
    """Average over images of each image's channel mean; every image weighs the same."""
    per_image = pixels.groupBy(image).agg(*[F.avg(c).alias(c) for c in channels])
    return per_image.agg(*[F.avg(c).alias(c) for c in channels])


def standardise(pixels: DataFrame, image: str, channels: list[str]) -> DataFrame:
    """(x - mean) / (population deviation + 1e-9) within each image and channel."""
    stats = pixels.groupBy(image).agg(*[f(c).alias(f"{c}_{k}") for c in channels for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    return pixels.join(stats, image).select(*[((F.col(c) - F.col(f"{c}_m")) / (F.col(f"{c}_s") + 1e-9)).alias(c) if c in channels else F.col(c) for c in pixels.columns])

"""Window scoring with a user's model, and evaluation jobs built on it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.evaluate import class_report, confusion_matrix
from tilewright.operators.windows import clamped_patches, labels_of_mosaic, max_merge, predicted_class, stitch, window_boxes


def score_windows(windows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Apply a model to batches of windows; ``load`` runs once in each task and returns the callable."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            model = model or load()
            yield model(batch)

    return windows.mapInPandas(run, schema)


def window_pixels(pixels: DataFrame, windows: DataFrame) -> DataFrame:
    """The pixels of every window: all of pixels' columns, win_row and win_col. ``windows`` has img, x1, y1, x2, y2 (ends exclusive)."""
    met = F.col("row_no").between(F.col("y1"), F.col("y2") - 1) & F.col("col_no").between(F.col("x1"), F.col("x2") - 1)
    joined = pixels.join(windows.select("img", "x1", "y1", "x2", "y2"), "img").where(met)
    return joined.withColumnsRenamed({"y1": "win_row", "x1": "win_col"}).drop("x2", "y2")


def predict_overlapping(pixels: DataFrame, sizes: DataFrame, patch: int, load: Callable, share: float = 0.8) -> DataFrame:
    """(img, row_no, col_no, predicted) of whole images by overlapping patches.

    ``load`` returns a model that turns batches of window pixels into rows (img, row_no, col_no, class, p); the highest p of
    overlapping patches counts, the class with the highest p wins, the lower of equals. ``sizes`` has img, h, w.
    """
    at = clamped_patches(sizes.withColumnRenamed("img", "img_id"), patch, share)
    boxes = at.select(F.col("img_id").alias("img"), F.col("x0").alias("x1"), F.col("y0").alias("y1"), (F.col("x0") + patch).alias("x2"), (F.col("y0") + patch).alias("y2"))
    scored = score_windows(window_pixels(pixels, boxes), load, "img long, row_no long, col_no long, class long, p double")
    return predicted_class(max_merge(scored))


def predict_stitched(pixels: DataFrame, sizes: DataFrame, box: int, load: Callable) -> DataFrame:
    """(img, row_no, col_no, predicted) of whole images: half-stride windows, each pixel from the centre half of its window.

    ``load`` returns a model that turns batches of window pixels into rows (img, win_row, win_col, row_no, col_no, predicted). The
    mosaic is counted from (box/4, box/4) and ends where the last window's centre half does.
    """
    boxes = window_boxes(sizes.withColumnRenamed("img", "img_id"), box, box, box // 2).withColumnRenamed("img_id", "img")
    scored = score_windows(window_pixels(pixels, boxes), load, "img long, win_row long, win_col long, row_no long, col_no long, predicted long")
    return stitch(scored, box)


def evaluate_overlapping(responses: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Class report of max-merged responses against labels (img, row_no, col_no, actual)."""
    predicted = predicted_class(max_merge(responses))
    return class_report(confusion_matrix(predicted.join(labels, ["img", "row_no", "col_no"]), n))


def evaluate_stitched(responses: DataFrame, labels: DataFrame, n: int, box: int) -> DataFrame:
    """Class report of centre-stitched predictions (win_row, win_col, ..., predicted)."""
    return class_report(confusion_matrix(labels_of_mosaic(stitch(responses, box), labels, box), n))


def masks_without(predicted: DataFrame, drop_class: int) -> DataFrame:
    """Predicted masks with one class turned into background."""
    return predicted.withColumn("predicted", F.when(F.col("predicted") == drop_class, 0).otherwise(F.col("predicted")))

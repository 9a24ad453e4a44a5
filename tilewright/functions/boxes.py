"""Box columns x1, y1, x2, y2: predicates, reject reasons, flips, category maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _c() -> tuple[Column, Column, Column, Column]:
    return F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")


def sane() -> Column:
    """Corners in order and not negative."""
    x1, y1, x2, y2 = _c()
    return ~((x1 > x2) | (y1 > y2) | (x1 < 0) | (y1 < 0))


def preset(name: str) -> Column:
    """Size rules of the tile presets: "harvey", "roof" or "tank"."""
    x1, y1, x2, y2 = _c()
    w, h = x2 - x1, y2 - y1
    if name == "harvey":
        ratio = F.coalesce(F.try_divide(w, h), F.try_divide(h, w))
        return ~((w * h < 400) | ((x1 == x2) & (y1 == y2)) | (ratio > 40) | (ratio < 1 / 40))
    if name == "roof":
        return ~((x1 == x2) | (y1 == y2) | (w < 24) | (h < 24))
    if name in ("tank", "tank_negative"):
        return ~((x1 == x2) | (y1 == y2) | (w * h < 256))
    raise ValueError(f"unknown preset {name}")


def reject_reason(width: Column, height: Column) -> Column:
    """"outside" an image of that size, "flipped", or null for a good box."""
    x1, y1, x2, y2 = _c()
    outside = (F.greatest(x1, x2) > width) | (F.greatest(y1, y2) > height)
    return F.when(outside, "outside").when((x1 > x2) | (y1 > y2), "flipped")


def flip(boxes: DataFrame, sizes: DataFrame, how: str, image: str = "img_name") -> DataFrame:
    """Boxes of mirrored images; names get ``v_`` or ``h_``. ``sizes`` has the image and its h and w."""
    if how not in ("v", "h"):
        raise ValueError("flip is v or h")
    low, high, size = ("y1", "y2", "h") if how == "v" else ("x1", "x2", "w")
    joined = boxes.join(sizes.select(image, size), image)
    return joined.select(
        *[
            F.concat(F.lit(f"{how}_"), image).alias(image) if c == image else (F.col(size) - F.col(high)).alias(low) if c == low else (F.col(size) - F.col(low)).alias(high) if c == high else F.col(c)
            for c in boxes.columns
        ]
    )


def map_category(column: str, mapping: dict, strict: bool = False) -> Column:
    """The mapped value; a miss is null, or an error when strict."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.try_element_at(table, F.col(column))
    if not strict:
        return found
    return F.when(F.col(column).isNull(), F.lit(None)).otherwise(F.coalesce(found, F.raise_error(F.concat(F.lit("unknown category "), F.col(column).cast("string")))))


def with_one_category(df: DataFrame, number: int, column: str = "category") -> DataFrame:
    return df.withColumn(column, F.lit(number))


def filter_features(df: DataFrame, threshold: float | None = None, constants: dict | None = None, geometry: str = "geom") -> DataFrame:
    """Drop null geometries and, with a threshold, lower scores; set constant columns."""
    kept = df.where(F.col(geometry).isNotNull())
    kept = kept if threshold is None else kept.where(F.col("score") >= threshold)
    return kept.withColumns({k: F.lit(v) for k, v in (constants or {}).items()})

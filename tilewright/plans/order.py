"""Global order numbers and reproducible shuffles without an un-partitioned window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.plans.staging import stage


def prefix_sum(df: DataFrame, order: list, value: Column | None = None, out: str = "pos") -> DataFrame:
    """Add ``out``: the sum of ``value`` (whole numbers) over all rows before this one in the given order.

    Without ``value`` it is the row number from 0. The rows are range-partitioned once, numbered or summed in
    place and staged; only one total per partition is brought together, to be added back as an offset.
    Ties in ``order`` get distinct numbers in an arbitrary way, so give a total order.
    """
    sort = [c if isinstance(c, Column) else F.col(c) for c in order]
    rows = df if value is None else df.withColumn("_v", value.cast("long"))
    # the number of a row: its partition in the upper bits, its place there in the lower 33
    dealt = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_o", F.monotonically_increasing_id())
    part, place = F.shiftright("_o", 33), F.col("_o").bitwiseAND(F.lit((1 << 33) - 1))
    if value is not None:
        dealt, place = _running(dealt), F.col("_w")
    staged = stage(dealt, "prefix")
    sums = staged.groupBy(part.alias("_p")).agg((F.count("*") if value is None else F.sum("_v")).alias("_s"))
    # one row per partition: a window over it is as small as the task list
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
    ranked = staged.join(F.broadcast(offsets), part == F.col("_p"))
    return ranked.withColumn(out, place + F.col("_b")).drop("_p", "_o", "_v", "_w", "_b")


def rank_within(df: DataFrame, by: list[str], order: list, out: str = "rank", few: bool = False) -> DataFrame:
    """Add ``out``: the place of each row, from 0, in its group, by one global order; no task sorts a whole group.

    ``few`` says that the groups are few enough to broadcast one number for each. Nulls in ``by`` are a group.
    """
    ranked = prefix_sum(df, [*by, *order], out="_at")
    first = ranked.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("_at").alias("_first"))
    same = None
    for c in by:
        one = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = one if same is None else same & one
    joined = ranked.join(F.broadcast(first) if few else first, same)
    return joined.withColumn(out, F.col("_at") - F.col("_first")).drop("_at", "_first", *[f"_{c}" for c in by])


def _running(sorted_rows: DataFrame) -> DataFrame:
    """Add ``_w``: the sum of ``_v`` over the rows before this one in its partition."""
    schema = T.StructType([*sorted_rows.schema.fields, T.StructField("_w", T.LongType())])
    at = sorted_rows.columns.index("_v")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = 0
        for batch in batches:
            v = batch.column(at).fill_null(0).to_numpy(zero_copy_only=False)
            upto = total + np.cumsum(v, dtype=np.int64)
            total = int(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - v, pa.int64())], names=[*batch.schema.names, "_w"])

    return sorted_rows.mapInArrow(run, schema)


def hash_key(seed: int, *cols) -> Column:
    """The key of a reproducible shuffle: sort by it, then by a unique column."""
    return F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols])

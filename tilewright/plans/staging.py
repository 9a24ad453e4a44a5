"""Tables written to the shared folder of the cluster, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application under the one named by ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a folder of its own; a cluster raises, since its executors share no local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tilewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tilewright-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The files live on storage that every executor sees, so losing an executor loses no part
    of them, and plans built on the result start from the files.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Staged:
    """Tables staged within a ``with`` block; at its end all but the kept ones are deleted.

    What is read after the block must be kept, or have been staged itself.
    """

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Staged:
        return self

    def __call__(self, df: DataFrame, label: str, **options: str) -> DataFrame:
        self.tables.append(stage(df, label, **options))
        return self.tables[-1]

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables = [t for t in self.tables if t is not df]
        return df

    def __exit__(self, *error) -> None:
        for df in self.tables:
            drop_staged(df)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has staged; call it once its results are written."""
    _delete(spark, scratch_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

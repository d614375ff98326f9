"""Shared scratch folders for written intermediate tables and stream checkpoints."""

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below `spark.checkpoint.dir`, which all executors share.

    A session without that setting uses a folder in its warehouse, which is shared too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for folders in _noting:
        folders.append(path)
    return path


_noting: list[list[str]] = []


@contextmanager
def noted(folders: list[str]):
    """Add the scratch folders that are named meanwhile to a list, so that `remove_scratch` can remove them
    when no result is read from them any more."""
    _noting.append(folders)
    try:
        yield
    finally:
        _noting.pop()


def remove_scratch(spark: SparkSession, folders: list[str]) -> None:
    """Remove scratch folders and empty the list."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while folders:
        path = hadoop.Path(folders.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written_rows(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Write `df` to scratch and read it back, with the number of rows from the write itself."""
    path = scratch_dir(df.sparkSession, name)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to scratch and read it back: later steps do not recompute it."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Bytes of different values up to which a Parquet file keeps each once; by itself it keeps to a megabyte.
ONCE_BYTES = 64 * 1024 * 1024
ONCE = {"parquet.dictionary.page.size": str(ONCE_BYTES)}


def written_once(df: DataFrame, name: str) -> DataFrame:
    """`written` for rows that have long values in common: each file holds a value once."""
    path = scratch_dir(df.sparkSession, name)
    df.write.options(**ONCE).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

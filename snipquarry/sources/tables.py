"""Stored tables: scan, append, idempotent append."""

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None, rebalance=False) -> int:
    """Append rows to a table and return how many, counted during the write itself.

    `rebalance` brings the rows of each partition together first, for partitions so many that
    every task would write a file to each; a large one is still written by several tasks.
    """
    if rebalance:
        df = df.hint("rebalance", *partition_by)
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)
    return seen.get["rows"]


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Write `df`, replacing only the partitions it has rows for."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


def new_rows(df: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not in `existing`: appending them twice changes nothing."""
    return df.join(existing.select(*key), key, "left_anti")

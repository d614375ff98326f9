"""Spark's own size estimates, and what follows from them."""

import re

from pyspark.sql import DataFrame, SparkSession

PIECE_BYTES = 128 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate, without running anything.  Joins are estimated far too large."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_bytes(spark: SparkSession) -> int:
    """Size up to which Spark copies a side of a join by itself; negative if it never does."""
    setting = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", setting.strip().lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def spread(df: DataFrame, piece_bytes=PIECE_BYTES) -> DataFrame:
    """Spread a small input over all cores before costly per-row work.

    Tables are read in pieces by size, so a small one gives fewer tasks than there are cores.
    Inputs that fill the cores anyway are left as they are: nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) < cores * piece_bytes else df

"""Row numbers inside groups of any size."""

from pyspark.sql import Column, DataFrame, Window, functions as F


def number_in_group(
    df: DataFrame, group: list[str], order: list[str], slot: Column, name="position"
) -> DataFrame:
    """Zero-based position of each row in its group, ordered by `order`.

    `slot` must not decrease along `order`; it cuts a group into pieces that are numbered in
    separate tasks, e.g. `floor(turn / 4096)`.  Only the per-piece counts meet per group.
    """
    cut = df.withColumn("_slot", slot)
    counts = cut.groupBy(*group, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_slot").orderBy(*order)
    numbered = cut.withColumn("_i", F.row_number().over(inside) - 1)
    return (
        numbered.join(starts, [*group, "_slot"])
        .withColumn(name, F.col("_start") + F.col("_i"))
        .drop("_slot", "_start", "_i")
    )

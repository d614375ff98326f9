"""Joins and first-row picks that hold when one key has a large share of the rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from snipquarry.plans.size import broadcast_bytes, estimated_bytes

# No sub-key of a join gets more than this share of the rows, unless it has fewer than HOT_ROWS.
HOT_SHARE = 1e-4
HOT_ROWS = 100_000
NULL_SPREAD = 1_000


def hot_keys(df: DataFrame, keys: list[str], share=HOT_SHARE, rows=HOT_ROWS) -> DataFrame:
    """Keys with more than `share` of all rows and more than `rows`, and in how many parts to cut them.

    There are at most 1 / share such keys, and at most 2 / share parts of them.  Counting
    combines on the map side, so the hot keys themselves do not skew it.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)))
    part = F.greatest(total.scalar() * share, F.lit(float(rows)))
    return counts.filter(F.col("_n") > part).select(*keys, F.ceil(F.col("_n") / part).cast("int").alias("_parts"))


def salted_join(
    big: DataFrame,
    single: DataFrame,
    on: list[str],
    spread: list[str],
    how="inner",
    condition: Column | None = None,
    share=HOT_SHARE,
    rows=HOT_ROWS,
    copy_bytes: int | None = None,
) -> DataFrame:
    """Join `big` with `single`, which has at most one row per key.

    `big` is read once more for its keys: give a stored table, not the end of a long plan.
    Where `single` is estimated to be below Spark's bound for copying a side to all tasks
    (or below `copy_bytes`), this is a plain join and `big` is not shuffled.  Otherwise rows of
    hot keys are spread over sub-keys by the hash of their `spread` columns
    (deterministic, so a retried task sends each row to the same place), in as many parts as
    their share asks for, and only the rows of `single` for those keys are repeated.  NULL keys
    match nothing and are spread as well.  `how` is inner, left, left_semi or left_anti.
    """
    if copy_bytes is None:
        copy_bytes = broadcast_bytes(big.sparkSession)
    renamed = single.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in single.columns])
    match = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_r_{c}") for c in on])
    if condition is not None:
        match = match & condition
    if estimated_bytes(single) <= copy_bytes:
        return big.join(renamed, match, how).drop(*[f"_r_{c}" for c in on])
    # At most 1 / share rows, whatever the size of the data.
    hot = F.broadcast(hot_keys(big, on, share, rows))
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    parts = F.when(no_key, NULL_SPREAD).otherwise(F.coalesce("_parts", F.lit(1)))
    salt = F.when(parts > 1, F.pmod(F.xxhash64(*spread), parts)).otherwise(0).cast("int")
    left = big.join(hot, on, "left").withColumn("_salt", salt).drop("_parts")
    every = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    hot_right = hot.select(*[F.col(c).alias(f"_r_{c}") for c in on], "_parts")
    right = renamed.join(hot_right, [f"_r_{c}" for c in on], "left").withColumn("_r__salt", F.explode(every))
    joined = left.join(right.drop("_parts"), match & (F.col("_salt") == F.col("_r__salt")), how)
    return joined.drop("_salt", "_r__salt", *[f"_r_{c}" for c in on])


def first_per_key(df: DataFrame, keys: list[str], order: list[str], last=False) -> DataFrame:
    """One whole row per key, the first (or last) by `order`.

    An aggregate and not a window: each task reduces its own rows to one per key before the
    shuffle, so a hot key costs one row per task.
    """
    pick = F.max_by if last else F.min_by
    row = F.struct(*df.columns)
    picked = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        pick(row, F.struct(*order)).alias("_row")
    )
    return picked.select("_row.*")

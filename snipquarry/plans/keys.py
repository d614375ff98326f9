"""Lookups that hold when one key has a large share of the rows, and bounded pre-filters."""

import functools
import math

from pyspark.sql import Column, DataFrame, functions as F

# A key with more than this share of all rows counts as hot: there are at most 1 / share of them.
HOT_SHARE = 1e-4
SALTS = 100_000


def lookup(rows: DataFrame, table: DataFrame, on: list[str], weight: str, share=HOT_SHARE) -> DataFrame:
    """Left join of `rows` with `table` (one row per key, no NULL keys), which says in `weight` how
    many rows have the key.

    Hot keys are at most 1 / `share`, so their rows of `table` are copied to all tasks.  Their
    rows then go through the shuffle of all others spread by a hash, matching nothing there.
    Weights are looked at first: where all keys are hot or none is, one join does, so that plans,
    which take memory of the driver, stay small.  `table` is used up to three times and should be stored.
    """
    extra = [c for c in table.columns if c not in on]
    least, most, total = table.agg(F.min(weight), F.max(weight), F.sum(weight)).first()
    limit = (total or 0) * share
    if most is None or most <= limit or least > limit:
        found = table.select(*on, *[F.col(c).alias(f"_own_{c}") for c in extra])
        if most is not None and least > limit:
            found = F.broadcast(found)
        return rows.join(found, on, "left").select(*rows.columns, *[F.col(f"_own_{c}").alias(c) for c in extra])
    hot = table.filter(F.col(weight) > limit)
    cold = table.filter(F.col(weight) <= limit)
    hot = F.broadcast(hot.select(*on, *[F.col(c).alias(f"_hot_{c}") for c in extra], F.lit(1).alias("_is_hot")))
    marked = rows.join(hot, on, "left")
    spread = F.when(F.col("_is_hot") == 1, 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0)
    cold = cold.select(*on, F.lit(0).cast("long").alias("_salt"), *[F.col(c).alias(f"_cold_{c}") for c in extra])
    found = marked.withColumn("_salt", spread.cast("long")).join(cold, [*on, "_salt"], "left")
    return found.select(
        *rows.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in extra]
    )


# Bits of a filter for each id, words of 64 bits in a block of it, and most blocks: 64 MB.
ID_BITS = 16
BLOCK_WORDS = 64
MOST_BLOCKS = 131_072
# So many ids are copied as they are, without a filter.
FEW_IDS = 10_000


def marked_likely(rows: DataFrame, ids: DataFrame, keys: list[str], name: str, most_blocks: int | None = None) -> DataFrame:
    """`rows` with a mark `name`: true wherever the key is in `ids`, and false for nearly all other rows.

    A blocked Bloom filter is copied to all tasks: a cheap filter ahead of a shuffle.  It has 16 bits an id, so
    that some 2 % of the others pass, and is cut off at 64 MB: beyond 32 million ids more pass (5 % at twice as
    many, 40 % at eight times), which costs shuffles and no rows.  Not exact: join the marked rows
    afterwards.  `ids` are counted first and should be stored; a few are copied themselves.
    """
    n = ids.count()
    if n == 0:
        return rows.withColumn(name, F.lit(False))
    if n <= FEW_IDS and most_blocks is None:
        few = ids.select(*[F.col(k).alias(f"_id{i}") for i, k in enumerate(keys)]).distinct().withColumn("_few", F.lit(True))
        same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_id{i}")) for i, k in enumerate(keys)])
        return rows.join(F.broadcast(few), same, "left").select(*rows.columns, F.coalesce("_few", F.lit(False)).alias(name))
    wanted = math.ceil(n * ID_BITS / (BLOCK_WORDS * 64))
    blocks = min(most_blocks or MOST_BLOCKS, 1 << max(0, wanted - 1).bit_length())
    size = BLOCK_WORDS * 64
    # One hash: its lowest bits name the block, and two other runs of its bits a place there each.
    hashed = F.xxhash64(*keys)
    block = F.pmod(hashed, F.lit(blocks)).cast("int")
    places = [F.pmod(F.shiftrightunsigned(hashed, shift), F.lit(size)).cast("int") for shift in (20, 40)]

    def bit(place):
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))

    def word(place):
        return F.floor(place / 64).cast("int")

    set_ = ids.select(block.alias("_block"), F.explode(F.array(*places)).alias("_place"))
    words = set_.groupBy("_block", word(F.col("_place")).alias("_word")).agg(F.bit_or(bit(F.col("_place"))).alias("_bits"))
    held = F.map_from_entries(F.collect_list(F.struct("_word", "_bits")))
    none = F.lit(0).cast("long")
    packed = words.groupBy("_block").agg(held.alias("_held")).select(
        "_block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("_held", i), none)).alias("_bits")
    )
    # At most `most_blocks` rows of 512 bytes.
    joined = rows.withColumns({"_block": block, "_a": places[0], "_b": places[1]}).join(F.broadcast(packed), "_block", "left")
    found = [F.get("_bits", word(F.col(p))).bitwiseAND(bit(F.col(p))) != 0 for p in ("_a", "_b")]
    return joined.select(*rows.columns, F.coalesce(found[0] & found[1], F.lit(False)).alias(name))


def cut_points(df: DataFrame, column: str, parts: int) -> list:
    """About even cuts of a number column into `parts`, rising; none where it has no values."""
    if parts < 2:
        return []
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = df.agg(F.percentile_approx(column, shares, 1000)).first()[0]
    return sorted(set(found or []))

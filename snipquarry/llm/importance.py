"""Importance resampling towards a target corpus, with weights from bit planes of bucket counts."""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from snipquarry.llm.common import utf8
from snipquarry.llm.decontaminate import words
from snipquarry.plans.scratch import written

BUCKETS = 10_000
# Documents whose counts are held as planes at a time.
BLOCK = 64


class _Feature(dict):
    """Bucket of each feature; forgets all once it holds `most`, to bound memory."""

    def __init__(self, buckets, most=200_000):
        self.buckets, self.most = buckets, most

    def __missing__(self, feature):
        if len(self) >= self.most:
            self.clear()
        self[feature] = value = zlib.crc32(feature) % self.buckets
        return value


def _features(w: list[bytes], runs: tuple[int, int], known: _Feature) -> np.ndarray:
    """Buckets of all runs of words of a text."""
    parts = []
    for n in range(runs[0], runs[1] + 1):
        made = w if n == 1 else map(b" ".join, zip(*[w[i:] for i in range(n)]))
        parts.append(np.fromiter(map(known.__getitem__, made), np.int64, max(0, len(w) - n + 1)))
    return np.concatenate(parts)


def bucket_counts(texts: DataFrame, runs=(1, 1), buckets=BUCKETS) -> np.ndarray:
    """How many features of all texts (column text) fall into each bucket.

    Each task adds up its own texts, so at most `buckets` rows leave it, and as many the driver.
    """

    def run(batches):
        known, sums = _Feature(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in utf8(batch.column("text")):
                sums += np.bincount(_features(words(text), runs, known), minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int64()), "n": pa.array(sums[used], pa.int64())})

    rows = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(buckets, np.int64)
    sums[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return sums


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What one feature of each bucket adds to a weight, in thousandths of a natural logarithm, rounded down."""
    n, s, t = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n))))
        for a, b in zip(source.astype(float).tolist(), target.astype(float).tolist())
    ], np.int64)


def planes(numbers: np.ndarray) -> np.ndarray:
    """Bit planes of rows of numbers from 0: (bits, rows, words of 64 bits)."""
    bits = max(1, int(numbers.max(initial=0)).bit_length())
    packed = [np.packbits((numbers >> i).astype(np.uint8) & 1, axis=1) for i in range(bits)]
    width = -(-numbers.shape[1] // 64) * 8
    out = np.zeros((bits, numbers.shape[0], width), np.uint8)
    for i, plane in enumerate(packed):
        out[i, :, :plane.shape[1]] = plane
    return out.view(np.uint64)


def weigh(counts: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Sum of counts times gains per row of counts, from planes of the gains' sizes by sign.

    A bit of a count and a bit of a gain that stand in the same bucket add a power of two: each pair
    of planes is ANDed, and its set bits are counted.
    """
    total = np.zeros(len(counts), np.int64)
    for i, plane in enumerate(planes(counts)):
        for sign, sizes in ((1, positive), (-1, negative)):
            for j, gain in enumerate(sizes):
                total += sign * (np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) << (i + j))
    return total


def weights(documents: DataFrame, gain: np.ndarray, runs=(1, 1)) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for every row of documents (doc_id, text).

    A missing or empty text has no features and the weight 0.
    """
    buckets = len(gain)
    copied = documents.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        known, gain = _Feature(buckets), copied.value
        positive, negative = (planes(np.maximum(s * gain, 0)[None])[:, 0] for s in (1, -1))
        for batch in batches:
            made = [_block(batch.slice(i, BLOCK), known, positive, negative) for i in range(0, batch.num_rows, BLOCK)]
            columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (zip(*made) if made else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "n_words", "n_features", "weight"])

    def _block(batch, known, positive, negative):
        n_words, found = [], []
        for text in utf8(batch.column("text")):
            w = words(text)
            n_words.append(len(w))
            found.append(_features(w, runs, known))
        sizes = np.array([*map(len, found)], np.int64)
        at = np.repeat(np.arange(len(found)) * buckets, sizes) + np.concatenate(found)
        counts = np.bincount(at, minlength=len(found) * buckets).reshape(-1, buckets)
        return np.array(n_words, np.int64), sizes, weigh(counts, positive, negative)

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the id: the same in every run."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _ranked(rows: DataFrame, order: list) -> DataFrame:
    """The rows with `rank` from 1 in their order; a global sort, and only sizes of its partitions meet."""
    # Of each row: its partition of the sorted rows and its place there.
    placed = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a partition of the sort.
    starts = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    found = placed.withColumn("_part", part).join(starts, "_part")
    return found.withColumn("rank", F.col("_start") + inside + 1).drop("_part", "_start", "_at")


def resample(
    documents: DataFrame, target: DataFrame, runs=(1, 1), buckets=BUCKETS, seed=2024, least_words=20, percent=10
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) for every row of documents (doc_id, text).

    Features are runs of `runs[0]` to `runs[1]` words in hashed buckets.  A document's weight is how
    much likelier its features are in the target's texts (column text) than in all documents; its score adds
    Gumbel noise, so that the highest scores are a sample without replacement in proportion to the
    weights.  Of the N documents with at least `least_words` words, floor(percent * N / 100) are drawn and ranked
    by score, ties to the smaller id; the others' rank is NULL.  A missing id has the noise of an empty one
    and goes after the others of its score; repeated rows are documents of their own; a missing or empty text weighs 0
    and is never drawn (unless `least_words` is 0); empty tables count nothing.  Other columns are not looked at.
    """
    gain = gains(bucket_counts(documents, runs, buckets), bucket_counts(target, runs, buckets))
    scored = weights(documents, gain, runs).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    # Numbered, so that a sort can cut rows that are alike.
    scored = written(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    pool = F.col("n_words") >= least_words
    drawn = scored.agg(F.count_if(pool)).first()[0] * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("_row")]
    ranked = _ranked(scored.filter(pool), order)
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~pool).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns).unionByName(rest.select(*columns))

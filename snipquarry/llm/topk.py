"""Exact top-k search by distributed selection on score histograms."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from snipquarry.llm.common import per_batch

BINS = 1024
# Bytes of one copied block of queries, and score cells that a task holds at a time.
BLOCK_BYTES = 16 * 1024 * 1024
CELLS = 2_000_000


def quantised(column, scale) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """{width: (rows, matrix)} of floor(scale * x); lists that are null or hold null or non-finite values are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64())
    values = np.floor(scale * flat.to_numpy(zero_copy_only=False))
    ends = np.cumsum(np.maximum(lengths, 0))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    fine = (lengths >= 0) & (bad[ends] == bad[ends - np.maximum(lengths, 0)])
    out = {}
    for width in np.unique(lengths[fine]).tolist():
        rows = np.flatnonzero(fine & (lengths == width))
        out[width] = rows, values[(ends[rows] - width)[:, None] + np.arange(width)[None, :]]
    return out


def _scores(candidates: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products; as doubles where these are exact, else as 64-bit integers."""
    most = np.abs(candidates).max(initial=0) * np.abs(queries).max(initial=0) * max(1, queries.shape[1])
    if most < 2 ** 53:
        return candidates @ queries.T
    return candidates.astype(np.int64) @ queries.astype(np.int64).T


def _blocks_of_scores(batch, groups, scale):
    """(candidate ids, query numbers, score cells, own) in pieces; own marks a query's own row."""
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    for width, (rows, matrix) in quantised(batch.column("embedding"), scale).items():
        if width not in groups:
            continue
        numbers, query_ids, queries = groups[width]
        step = max(1, CELLS // len(numbers))
        for i in range(0, len(rows), step):
            part = ids[rows[i:i + step]]
            yield part, numbers, _scores(matrix[i:i + step], queries), part[:, None] == query_ids[None, :]


def _query_blocks(queries: DataFrame, width: int, block_bytes: int):
    """Queries in blocks of a bounded size; each is copied to all tasks in its turn."""
    n = queries.count()
    blocks = max(1, -(-n * 8 * max(1, width) // block_bytes))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    for i in range(blocks):
        table = queries.filter(part == i).toArrow()
        if table.num_rows:
            yield table


def topk(queries: DataFrame, vectors: DataFrame, k=5, scale=256, bins=BINS, block_bytes=BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    Both sides have (vec_id, embedding); components become floor(scale * x).  A row whose id is
    the query's own is no candidate for it.  Rows without an id or vector, or with a null or
    non-finite component, take no part, and vectors of another width than the query's are not
    compared with it.  Repeated candidate rows count each; repeated query rows (one id) are asked
    once.  Scores must fit a 64-bit integer.

    Queries are copied to the tasks in blocks of `block_bytes`; vectors are only scanned.  Per
    block all vectors are scored and each query's global histogram of scores is refined until the
    bin that holds the k-th value is one score wide: log(range) / log(bins) passes.  A task sends
    only its bins from the top down to its own k-th score, as lower ones cannot hold the k-th.
    A last pass keeps scores above the k-th value, and of the ties with it the smallest ids.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    queries = queries.select("vec_id", "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    queries = queries.dropDuplicates(["vec_id"])
    width = queries.agg(F.max(F.size("embedding"))).first()[0] or 0

    def largest(batch):
        made = [np.abs(m).max(initial=0) for _, m in quantised(batch.column("embedding"), scale).values()]
        return {"most": [float(max(made, default=0))]}

    most = per_batch(vectors, largest, "most double").agg(F.max("most")).first()[0] or 0.0
    found = None
    for table in _query_blocks(queries, width, block_bytes):
        part = _block(spark, table, vectors, k, scale, bins, most)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return found


def _block(spark, table: pa.Table, vectors: DataFrame, k, scale, bins, most) -> DataFrame:
    all_ids = table.column("vec_id").to_numpy()
    groups, low, span = {}, np.zeros(len(all_ids), np.int64), np.ones(len(all_ids), np.int64)
    for w, (rows, matrix) in quantised(table.column("embedding"), scale).items():
        groups[w] = rows, all_ids[rows], matrix
        bound = np.ceil(np.abs(matrix).sum(axis=1) * most).astype(np.int64)
        low[rows], span[rows] = -bound, 2 * bound + 1
    # Each query's window of scores: `span` from `low`, in bins of equal size; and how many scores lie above.
    size = -(-span // bins)
    above = np.zeros(len(all_ids), np.int64)
    open_ = np.zeros(len(all_ids), bool)
    open_[np.concatenate([g[0] for g in groups.values()] or [np.empty(0, int)])] = True
    every = np.zeros(len(all_ids), bool)
    while open_.any():
        state = spark.sparkContext.broadcast((groups, low.copy(), span.copy(), size.copy(), open_.copy()))

        def histogram(batches, state=state):
            groups, low, span, size, is_open = state.value
            counts = {}
            for batch in batches:
                for _, numbers, cells, own in _blocks_of_scores(batch, groups, scale):
                    at = np.flatnonzero(is_open[numbers])
                    n = numbers[at]
                    over = cells[:, at] - low[n]
                    use = (over >= 0) & (over < span[n]) & ~own[:, at]
                    place = np.floor_divide(over, size[n])
                    q = np.broadcast_to(at, place.shape)[use]
                    key = (id(numbers), len(numbers))
                    got = np.bincount(q * bins + place[use].astype(np.int64), minlength=len(numbers) * bins)
                    kept = counts.setdefault(key, (numbers, np.zeros(len(numbers) * bins, np.int64)))
                    kept[1][:] += got
            for numbers, flat in counts.values():
                per_query = flat.reshape(len(numbers), bins)
                from_top = np.cumsum(per_query[:, ::-1], axis=1)[:, ::-1]
                # Bins that hold the task's own k-th score or lie above it.
                sent = (per_query > 0) & (from_top - per_query < k)
                q, b = np.nonzero(sent)
                yield pa.RecordBatch.from_pydict({
                    "q": numbers[q].astype(np.int64), "bin": b.astype(np.int64), "n": per_query[q, b],
                })

        sums = vectors.mapInArrow(histogram, "q bigint, bin bigint, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        need = sums.withColumn("upto", F.sum("n").over(down))
        start = spark.createDataFrame([(int(i), int(above[i])) for i in np.flatnonzero(open_)], "q bigint, above bigint")
        holds = need.join(F.broadcast(start), "q").filter((F.col("above") + F.col("upto") >= k) & (F.col("above") + F.col("upto") - F.col("n") < k))
        rows = holds.select("q", "bin", (F.col("above") + F.col("upto") - F.col("n")).alias("above")).collect()
        seen = np.zeros(len(all_ids), bool)
        for q, b, more in rows:
            seen[q] = True
            low[q] += b * size[q]
            above[q] = more
            open_[q] = size[q] > 1
            span[q] = size[q]
            size[q] = -(-span[q] // bins)
        # Fewer than k candidates: all of them are results.
        every |= open_ & ~seen
        open_ &= seen
    # The k-th value is now `low`; of the scores that tie with it, k - above are results.
    value = np.where(every, np.iinfo(np.int64).min, low)
    state = spark.sparkContext.broadcast((groups, value, np.where(every, 0, k - above), all_ids))

    def select(batches):
        groups, value, ties, all_ids = state.value
        tied = {}
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        for batch in batches:
            for ids, numbers, cells, own in _blocks_of_scores(batch, groups, scale):
                c, q = np.nonzero((cells > value[numbers]) & ~own)
                if len(c):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(all_ids[numbers[q]]), pa.array(ids[c]), pa.array(cells[c, q].astype(np.int64))], schema=schema
                    )
                c, q = np.nonzero((cells == value[numbers]) & ~own)
                for number in np.unique(numbers[q]).tolist():
                    same = np.concatenate([tied.get(number, ids[:0]), ids[c[numbers[q] == number]]])
                    tied[number] = np.sort(same)[:ties[number]]
        if tied:
            n = np.repeat(list(tied), [len(v) for v in tied.values()]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(all_ids[n]), pa.array(np.concatenate(list(tied.values()))), pa.array(value[n])], schema=schema
            )

    found = vectors.mapInArrow(select, "query_id bigint, vec_id bigint, score bigint")
    order = [F.desc("score"), F.col("vec_id")]
    # In two steps: many tasks may each send a few ties of the same query.
    some = Window.partitionBy("query_id", F.pmod("vec_id", F.lit(64))).orderBy(*order)
    best = found.withColumn("_r", F.row_number().over(some)).filter(F.col("_r") <= k)
    last = Window.partitionBy("query_id").orderBy(*order)
    ranked = best.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

"""Nearest vectors for many queries at once.

Every search is a set of *asks* (query_id, embedding, k, routes).  An ask with routes is
compared with the vectors of those routes only (a repository, or cells of an inverted file);
an ask without is compared with all vectors.  Two ways to run them:

* few asks: they are copied to every task and the vectors stay where they are.  One scan, no
  shuffle but that of each task's best k per query;
* many asks: asks and vectors meet in blocks of bounded size.  A large route is cut into
  many blocks on both sides, so no task holds a whole route.

A task compares blocks by matrix products and gives back at most k rows per query
and block; query-vector pairs never become rows.  Distances are recomputed by subtraction
before they are ranked, and equal distances rank by id.
"""

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from snipquarry import settings
from snipquarry.functions import scores
from snipquarry.plans.keys import marked_likely
from snipquarry.plans.scratch import written_rows
from snipquarry.plans.skew import salted_join

# Above either bound the asks are not copied to the tasks but meet the vectors in blocks.
COPY_ROWS = 16_384
COPY_BYTES = 32 * 1024 * 1024


def _matrix(column) -> np.ndarray:
    """Vectors of an Arrow list column as rows of a float64 matrix.

    The column has no NULLs; vectors of different widths cannot be compared and fail.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    if not (widths == widths[0]).all():
        raise ValueError(f"vectors of {int(widths.min())} to {int(widths.max())} components in one search")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a vector has a missing component")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _same_width(one: np.ndarray, two: np.ndarray):
    if len(one) and len(two) and one.shape[1] != two.shape[1]:
        raise ValueError(f"vectors of {one.shape[1]} and of {two.shape[1]} components in one search")


def _first_copies(vectors, order, keep):
    """Rows of `vectors` without those that have `keep` equal rows before them in `order`."""
    rows = np.ascontiguousarray(vectors + 0.0)
    _, copy_of = np.unique(rows.view(f"V{rows.itemsize * rows.shape[1]}").ravel(), return_inverse=True)
    by = np.lexsort((order, copy_of))
    copy_of = copy_of[by]
    place = np.arange(len(by)) - np.searchsorted(copy_of, copy_of, side="left")
    return np.sort(by[place < keep])


# Most bytes of a block of vectors, and fewest vectors that are worth a block.
BLOCK_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 1_024
# Asks and vectors that are compared by one matrix product.
ASK_SLICE = 256
VECTOR_SLICE = 4_096


def _best(queries, k, vectors, order, bound=None, slice_cells=4_000_000, distinct=False):
    """(query row, vector row, squared distance) of each query's k nearest vectors, within its squared `bound`.

    `order` ranks equal distances.  Vectors are taken by their length, from that of the queries
    outwards: lengths differ by no more than the distance, so those further off than the k-th
    hit so far need no look.  The product form of the distance only narrows the choice; its
    rounding error stays within `slack`.  Where many copies of a vector tie, those that k copies
    precede are left out first.
    """
    n = len(vectors)
    _same_width(queries, vectors)
    if n == 0 or len(queries) == 0:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    squares, asked = np.einsum("ij,ij->i", vectors, vectors), np.einsum("ij,ij->i", queries, queries)
    by = np.argsort(squares, kind="stable")
    rows, squares = vectors[by], squares[by]
    lengths, own = np.sqrt(squares), np.sqrt(asked)
    asking = np.argsort(own, kind="stable")
    asking = asking[np.isfinite(own[asking])]
    step = max(ASK_SLICE, min(16 * ASK_SLICE, 1_000_000 // n))
    step = max(1, min(step, slice_cells // min(n, VECTOR_SLICE)))
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    for start in range(0, len(asking), step):
        at = asking[start:start + step]
        part, norms, length, most = queries[at], asked[at], own[at], k[at]
        limit = np.full(len(at), np.inf) if bound is None else bound[at]
        top = min(int(most.max()), n)
        low = high = int(np.searchsorted(lengths, np.median(length)))
        width = n if n <= 1_024 else max(ASK_SLICE, 4 * top)
        q, v, d = found[0]
        while True:
            reach = np.sqrt(limit) * (1 + 1e-9) + 1e-6 * (1 + length)
            least = int(np.searchsorted(lengths, (length - reach).min(), "left"))
            last = int(np.searchsorted(lengths, (length + reach).max(), "right"))
            if low <= least and high >= last:
                break
            below = high >= last or (low > least and length[0] - lengths[low - 1] < lengths[high] - length[-1])
            if below:
                low, until = max(least, low - width), low
                first = low
            else:
                # Lengths in between are skipped when the nearest one in reach is further off.
                first, until = high, min(last, high + width)
                high = until
            width = min(2 * width, max(VECTOR_SLICE, 4 * top))
            rough = (-2.0 * part) @ rows[first:until].T
            rough += squares[first:until]
            slack = 1e-9 * (1.0 + norms + squares[until - 1])
            near = limit - norms
            if top <= until - first and not np.isfinite(limit).all():
                near = np.minimum(near, np.partition(rough, top - 1, axis=1)[:, top - 1])
            one, other = np.nonzero(rough <= (near + slack)[:, None])
            if not len(one):
                continue
            if len(one) > 16 * top * len(at) and not distinct:
                kept = _first_copies(vectors, order, int(k.max()))
                q, v, d = _best(queries, k, vectors[kept], order[kept], bound, slice_cells, distinct=True)
                return q, kept[v], d
            exact, many = np.empty(len(one)), max(1, slice_cells // max(1, rows.shape[1]))
            for i in range(0, len(one), many):
                gap = part[one[i:i + many]] - rows[first + other[i:i + many]]
                exact[i:i + many] = np.einsum("ij,ij->i", gap, gap)
            within = exact <= limit[one]
            q, v, d = (np.concatenate(c) for c in ((q, one[within]), (v, by[first + other[within]]), (d, exact[within])))
            q, v, d = _cut(q, v, d, order[v], most)
            limit = np.minimum(limit, _last(q, d, most))
        found.append((at[q], v, d))
    q, v, d = (np.concatenate(c) for c in zip(*found))
    by_query = np.argsort(q, kind="stable")
    return q[by_query], v[by_query], d[by_query]


def _last(q, distance, k):
    """Each query's k-th distance in rows sorted by (query, distance); infinite if it has fewer."""
    ends = np.searchsorted(q, np.arange(len(k)), side="right")
    held = np.diff(ends, prepend=0)
    last = np.full(len(k), np.inf)
    full = (held >= k) & (held > 0)
    last[full] = distance[ends[full] - 1]
    return last


def _cut(q, v, distance, order, k):
    """Keep the first k[q] rows of each query by (distance, order)."""
    by = np.lexsort((order, distance, q))
    q, v, distance = q[by], v[by], distance[by]
    first = np.searchsorted(q, q, side="left")
    keep = np.arange(len(q)) - first < k[q]
    return q[keep], v[keep], distance[keep]


def _present(rows, column):
    """Rows that have a vector.

    A filter on the DataFrame would make Spark compute the vectors twice where a model makes them.
    """
    return rows.filter(rows.column(column).is_valid()) if rows.column(column).null_count else rows


def _order_of(ids) -> np.ndarray:
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return ids.to_numpy()
    return pc.rank(ids, tiebreaker="first").to_numpy()


class _Running:
    """The best hits so far of asks (matrix, k), while blocks of vectors come one after another."""

    def __init__(self, matrix, k):
        self.matrix, self.k = matrix, k
        self.bound = np.full(len(k), np.inf)
        self.q, self.distance, self.ids = np.empty(0, int), np.empty(0), None

    def near(self, asking, block, order):
        """What a block adds to the asks of some rows."""
        if asking is None:
            return _best(self.matrix, self.k, block, order, self.bound)
        q, v, d = _best(self.matrix[asking], self.k[asking], block, order, self.bound[asking])
        return asking[q], v, d

    def add(self, parts, ids):
        q, v, d = (np.concatenate(c) for c in zip(*parts))
        if not len(q):
            return
        ids = ids.take(pa.array(v, pa.int64()))
        self.ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        q, d = np.concatenate([self.q, q]), np.concatenate([self.distance, d])
        self.q, kept, self.distance = _cut(q, np.arange(len(q)), d, _order_of(self.ids), self.k)
        self.ids = self.ids.take(pa.array(kept, pa.int64()))
        self.bound = _last(self.q, self.distance, self.k)

    def pairs(self, query_ids):
        """Batches of the hits."""
        for i in range(0, len(self.q), PAIR_ROWS):
            cut = slice(i, i + PAIR_ROWS)
            ids = self.ids.slice(i, PAIR_ROWS)
            yield _pairs(query_ids, ids, self.k, self.q[cut], np.arange(len(ids)), self.distance[cut], pa.RecordBatch.from_pydict)


PAIR_ROWS = 100_000


def _plain(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _pairs(query_ids, ids, k, q, v, distance, make):
    q = pa.array(q, pa.int64())
    return make({
        "query_id": query_ids.take(q),
        "id": ids.take(pa.array(v, pa.int64())),
        "distance": pa.array(distance, pa.float64()),
        "k": pa.array(k, pa.int32()).take(q),
    })


def _pairs_schema(asks, vectors):
    return T.StructType([
        T.StructField("query_id", asks.schema["query_id"].dataType),
        T.StructField("id", vectors.schema["id"].dataType),
        T.StructField("distance", T.DoubleType()),
        T.StructField("k", T.IntegerType()),
    ])


def _scan(asks: pa.Table, vectors: DataFrame, schema) -> DataFrame:
    """Compare copied asks with every vector in one scan."""
    k = asks.column("k").to_numpy().astype(np.int64)
    rows_of = {}
    for i, routes in enumerate(asks.column("routes").to_pylist()):
        for route in [None] if routes is None else routes:
            rows_of.setdefault(route, []).append(i)
    packed = {
        "ids": _plain(asks.column("query_id")),
        "matrix": _matrix(asks.column("embedding")),
        "k": k,
        "rows_of": {r: np.array(rows) for r, rows in rows_of.items()},
    }
    shared = vectors.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        copied = shared.value
        rows_of = copied["rows_of"]
        everywhere = rows_of.get(None)
        best = _Running(copied["matrix"], copied["k"])
        for batch in batches:
            batch = _present(batch, "embedding")
            if batch.num_rows == 0:
                continue
            block = _matrix(batch.column("embedding"))
            order = _order_of(batch.column("id"))
            parts = []
            if everywhere is not None:
                parts.append(best.near(everywhere, block, order))
            if len(rows_of) > (everywhere is not None):
                encoded = pc.dictionary_encode(batch.column("route"))
                codes = encoded.indices.fill_null(-1).to_numpy()
                for code, route in enumerate(encoded.dictionary.to_pylist()):
                    asking = rows_of.get(route)
                    if asking is not None:
                        at = np.flatnonzero(codes == code)
                        q, v, d = best.near(asking, block[at], order[at])
                        parts.append((q, at[v], d))
            if parts:
                best.add(parts, batch.column("id"))
        yield from best.pairs(copied["ids"])

    return vectors.select("id", "embedding", "route").mapInArrow(run, schema)


def _groups(batches):
    """(group, asks, vectors) of batches sorted by group and side: a table of all asks, and an iterator of vector batches."""
    def pieces():
        for batch in batches:
            if batch.num_rows:
                both = pc.binary_join_element_wise(batch.column("_group"), batch.column("_side").cast(pa.string()), "\u0002")
                codes = both.dictionary_encode().indices.to_numpy()
                starts = np.flatnonzero(np.diff(codes, prepend=-1))
                for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)]):
                    yield batch.column("_group")[start].as_py(), batch.column("_side")[start].as_py(), batch.slice(start, end - start)

    group, asks, vectors = None, [], []
    rows = 0
    for at, side, piece in pieces():
        if at != group:
            if asks and vectors:
                yield group, asks, vectors
            group, asks, vectors, rows = at, [], [], 0
        if side == 0:
            asks.append(piece)
        elif asks:
            vectors.append(piece)
            rows += piece.num_rows
            if rows >= FLUSH_ROWS:
                yield group, asks, vectors
                vectors, rows = [], 0
    if asks and vectors:
        yield group, asks, vectors


# Vectors of a block that are compared at once while they stream through a task.
FLUSH_ROWS = 32_768


def _meet(batches):
    """Hits of each group's asks among its vectors.  Asks of a group are held, its vectors stream by."""
    group, best, query_ids = None, None, None
    for at, asks, vectors in _groups(batches):
        if at != group:
            if best is not None:
                yield from best.pairs(query_ids)
            group, held = at, _present(pa.Table.from_batches(asks), "embedding")
            query_ids = _plain(held.column("query_id"))
            best = _Running(_matrix(held.column("embedding")), held.column("k").to_numpy().astype(np.int64))
        block = _present(pa.Table.from_batches(vectors), "embedding")
        ids = _plain(block.column("id"))
        best.add([best.near(None, _matrix(block.column("embedding")), _order_of(ids))], ids)
    if best is not None:
        yield from best.pairs(query_ids)


def _blocks(asks: DataFrame, vectors: DataFrame, schema, sizes, parts, routed=True) -> DataFrame:
    """Let asks and vectors of the same route meet in blocks.

    `sizes` has functions from a route's rows to its number of blocks, for asks and vectors.  With
    `routed` false every ask meets every vector, and routes are ignored.
    """
    n_rows = F.count(F.lit(1))
    of_asks, of_vectors = (lambda n, f=f: f(n).cast("int") for f in sizes)
    if routed:
        both = (
            vectors.groupBy("route").agg(of_vectors(n_rows).alias("_vn"))
            .join(asks.groupBy("route").agg(of_asks(n_rows).alias("_an")), "route")
        )

        def with_sizes(side, key):
            return salted_join(side, both, ["route"], [key])

    else:
        vn, an = vectors.agg(of_vectors(n_rows)), asks.agg(of_asks(n_rows))

        def with_sizes(side, key):
            return side.withColumns({"route": F.lit(""), "_vn": vn.scalar(), "_an": an.scalar()})

    def pieces(side, own, other, own_no, other_no, key):
        own_block = F.pmod(F.xxhash64(key), F.col(own)).cast("int")
        cut = with_sizes(side, key).withColumn(own_no, own_block)
        repeated = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return cut.filter(f"{other} > 0").withColumn(other_no, repeated)

    left = pieces(asks.select("query_id", "embedding", "k", "route"), "_an", "_vn", "_ab", "_vb", "query_id")
    right = pieces(vectors.select("id", "embedding", "route"), "_vn", "_an", "_vb", "_ab", "id")
    kind = asks.schema["embedding"].dataType
    kind = kind if kind == vectors.schema["embedding"].dataType else T.ArrayType(T.DoubleType())
    number = F.col("_ab") * F.col("_vn") + F.col("_vb")
    task = F.pmod(F.xxhash64("route", number), F.lit(parts)) if routed else F.pmod(number, F.lit(parts))

    def side(rows, no):
        def value(name, type_):
            return (F.col(name) if name in rows.columns else F.lit(None).cast(type_)).alias(name)

        return rows.select(
            value("query_id", asks.schema["query_id"].dataType), value("id", vectors.schema["id"].dataType),
            F.col("embedding").cast(kind).alias("embedding"), value("k", T.IntegerType()),
            F.concat_ws("\u0001", "route", number.cast("string")).alias("_group"), F.lit(no).alias("_side"), task.cast("int").alias("_task"),
        )

    rows = side(left, 0).unionByName(side(right, 1)).repartitionById(parts, "_task").drop("_task")
    return rows.sortWithinPartitions("_group", "_side").mapInArrow(_meet, schema)


# Most bytes of asks, and most hits, that a task holds.
ASK_BYTES = 16 * 1024 * 1024
HELD_HITS = 1_000_000


def _block_rows(n_asks, n_vectors, dim, tasks):
    """Rows of a vector block and of an ask block that fill the `tasks`, with all asks in as few blocks as can be."""
    most = max(1, BLOCK_BYTES // (4 * dim))
    asks = max(1, min(most, n_asks))
    even = -(-n_vectors * -(-n_asks // asks) // tasks)
    return min(most, max(BLOCK_ROWS, even)), asks


def _grid(n_asks, n_vectors, dim, k, tasks):
    """In how many blocks to cut asks and vectors that all meet.

    Every row is sent once to each block of the other side, and each block of vectors gives k hits for
    every ask: of the grids with as many pairs as `_block_rows` asks for, the one that sends least.
    """
    rows, asks = _block_rows(n_asks, n_vectors, dim, tasks)
    pairs = -(-n_vectors // rows) * -(-n_asks // asks)
    least_asks, least_vectors = _bounded(n_asks, dim, k), max(1, -(-n_vectors * 4 * dim // BLOCK_BYTES))
    grids = [(a, max(least_vectors, -(-pairs // a))) for a in range(least_asks, max(least_asks, pairs) + 1)]
    return min(grids, key=lambda g: g[0] * n_vectors * 4 * dim + g[1] * n_asks * (4 * dim + 40 * k))


def _bounded(n_asks, dim, k):
    return max(1, -(-n_asks * 4 * dim // ASK_BYTES), -(-n_asks * k // HELD_HITS))


def _sizes(n_asks, n_vectors, dim, k, tasks, block_vectors, block_asks):
    """Functions from a route's rows to its number of blocks, for asks and vectors.

    Given sizes are those of small inputs: a side is cut into no more blocks than the root of
    the tasks, as it is sent once for each block of the other side, unless memory asks for more.
    """
    a, v = _grid(n_asks, n_vectors, dim, k, tasks)
    most = max(2, math.isqrt(tasks))

    def number(given, blocks, n, bounds):
        size = given or max(1, -(-n // blocks))
        most_blocks = F.lit(most if given else blocks)
        return lambda rows: F.greatest(F.least(F.ceil(rows / size), most_blocks), *[F.ceil(rows / float(b)) for b in bounds])

    in_asks = (max(1, ASK_BYTES // (4 * dim)), max(1, HELD_HITS // k))
    return number(block_asks, a, n_asks, in_asks), number(block_vectors, v, n_vectors, (max(1, BLOCK_BYTES // (4 * dim)),))


def nearest(
    asks: DataFrame, vectors: DataFrame, copy_rows=COPY_ROWS, copy_bytes=COPY_BYTES,
    block_vectors: int | None = None, block_asks: int | None = None, squared=True,
) -> DataFrame:
    """Ranked hits (query_id, rank, id, distance) for asks (query_id, embedding, k, routes).

    `vectors` has (id, embedding, route) and should be stored: blocks read it more than once.
    Rows without an embedding are left out; widths that differ fail.  Asks are written once, so
    that a model which makes their vectors runs once, and their number and bytes decide whether
    they are copied to the tasks.
    """
    asks, n_asks = written_rows(asks.select("query_id", "embedding", "k", "routes"), "asks")
    schema = _pairs_schema(asks, vectors)
    some = asks.agg(F.max(F.size("embedding")).alias("dim"), F.max("k").alias("k"), F.count_if(F.col("routes").isNull()).alias("everywhere")).first()
    dim, k = max(some.dim or 1, 1), max(some.k or 1, 1)
    everywhere = asks.filter("routes IS NULL").withColumn("route", F.lit(""))
    routed = asks.filter("routes IS NOT NULL").withColumn("route", F.explode("routes"))
    if not some.everywhere:
        # Reaches the scan: only the folders or row groups of these routes are read.
        wanted = routed.select(F.col("route").alias("_route")).distinct()
        vectors = vectors.join(wanted, F.col("route") == F.col("_route"), "left_semi")
    if n_asks <= copy_rows and n_asks * 4 * dim <= copy_bytes:
        best = _merged(_scan(_present(asks.toArrow(), "embedding"), vectors, schema))
    else:
        tasks, n = 4 * vectors.sparkSession.sparkContext.defaultParallelism, vectors.count()
        found = []
        for rows, by_route in ((routed, True), (everywhere, False)):
            n_rows = rows.count() if by_route else some.everywhere
            if n_rows:
                sizes = _sizes(n_rows, n, dim, k, tasks, block_vectors, block_asks)
                sent = (n_rows + n) * 4 * dim * math.isqrt(tasks)
                found.append(_blocks(rows, vectors, schema, sizes, max(tasks, sent // BLOCK_BYTES), by_route))
        best = _ranked(reduce(DataFrame.unionByName, found)) if found else _ranked(asks.sparkSession.createDataFrame([], schema))
    distance = F.col("distance") if squared else F.sqrt("distance")
    return best.select("query_id", "rank", "id", distance.alias("distance"))


def _ranked(found: DataFrame) -> DataFrame:
    ranked = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter("rank <= k")


MERGE_PARTS = 64


def _merged(found: DataFrame) -> DataFrame:
    """The k best rows of each query, of those that the tasks found.

    In two steps: each task gives up to k rows per query, so one query's rows can be many.  They
    are cut to k in parts by a hash first, and only what is left of the parts meets.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(MERGE_PARTS))
    in_part = Window.partitionBy("query_id", part).orderBy("distance", "id")
    some = found.withColumn("_place", F.row_number().over(in_part)).filter("_place <= k")
    return _ranked(some)


def _asks(queries: DataFrame, route=None) -> DataFrame:
    k = scores.clamp_k(F.col("k")) if "k" in queries.columns else F.lit(settings.DEFAULT_K)
    routes = F.lit(None).cast("array<string>") if route is None else F.when(route.isNotNull(), F.array(route))
    return queries.select("query_id", "embedding", k.alias("k"), routes.alias("routes"))


def exact_topk(queries: DataFrame, vectors: DataFrame, **options) -> DataFrame:
    """Exact top-k over all vectors; each query may bring its own `k`."""
    routed = vectors.select("id", "embedding", F.lit(None).cast("string").alias("route"))
    return nearest(_asks(queries), routed, **options)


def scoped_topk(queries: DataFrame, vectors: DataFrame, **options) -> DataFrame:
    """Exact top-k inside each query's `repo_id`; NULL or empty means everywhere."""
    scope = F.when(F.col("repo_id") != "", F.col("repo_id"))
    routed = vectors.select("id", "embedding", F.col("repo_id").alias("route"))
    return nearest(_asks(queries, scope), routed, **options)


# --- inverted file ---------------------------------------------------------------------

# Centroids beyond this size are not copied to the tasks but met in blocks.
COPY_CENTROID_BYTES = 64 * 1024 * 1024


def train_centroids(vectors: DataFrame, cells=settings.NLIST, seed=42, iterations=20, fraction=1.0) -> DataFrame:
    """Centroids (cell, embedding) by k-means over the vectors, or over a share of them."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = vectors if fraction >= 1.0 else vectors.sample(fraction=fraction, seed=seed)
    features = sample.select(array_to_vector("embedding").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=iterations).fit(features)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cell int, embedding array<double>")


def _centroid_bytes(centroids: DataFrame) -> int:
    size = centroids.agg(F.sum(F.size("embedding")).alias("n")).first().n
    return 8 * (size or 0)


def _collect_centroids(centroids: DataFrame, *extra):
    """Centroids as a table in the order of their cells.  Their size is checked by the caller."""
    return centroids.select("cell", "embedding", *extra).toArrow().sort_by("cell")


def _masked(values: pa.Array):
    """(rows that have a vector, their matrix)."""
    present = values.is_valid().to_numpy(zero_copy_only=False)
    return np.flatnonzero(present), _matrix(values.drop_null())


def assign_cells(vectors: DataFrame, centroids: DataFrame, copy_bytes=COPY_CENTROID_BYTES) -> DataFrame:
    """Add each vector's nearest `cell` and the squared `cell_distance` to its centroid.

    Rows without a vector get neither.  Any number of cells will do: beyond `copy_bytes` of
    centroids, vectors (which then need an `id`) and centroids meet in blocks.
    """
    if _centroid_bytes(centroids) > copy_bytes:
        asks = vectors.select(F.col("id").alias("query_id"), "embedding", F.lit(1).alias("k"), F.lit(None).cast("array<string>").alias("routes"))
        cells = centroids.select(F.col("cell").alias("id"), "embedding", F.lit(None).cast("string").alias("route"))
        found = nearest(asks, cells, copy_rows=0)
        best = found.select(F.col("query_id").alias("id"), F.col("id").alias("cell"), F.col("distance").alias("cell_distance"))
        return vectors.join(best, "id", "left")
    table = _collect_centroids(centroids)
    shared = vectors.sparkSession.sparkContext.broadcast(
        (_matrix(table.column("embedding")), _plain(table.column("cell")))
    )

    def nearest_cell(embedding: pa.Array) -> pa.Array:
        matrix, cells = shared.value
        at, rows = _masked(embedding)
        _, c, d = _best(rows, np.ones(len(rows), int), matrix, np.arange(len(matrix)))
        cell, distance = np.zeros(len(embedding), int), np.zeros(len(embedding))
        cell[at], distance[at] = c, d
        missing = np.ones(len(embedding), bool)
        missing[at] = False
        return pa.StructArray.from_arrays(
            [cells.take(pa.array(cell, mask=missing)), pa.array(distance, mask=missing)], ["cell", "distance"]
        )

    cell_type = centroids.schema["cell"].dataType
    result = T.StructType().add("cell", cell_type).add("distance", T.DoubleType())
    # "Nondeterministic" keeps a later filter on the cell from computing it twice.
    found = vectors.withColumn("_c", F.arrow_udf(nearest_cell, result).asNondeterministic()("embedding"))
    return found.withColumns({"cell": F.col("_c.cell"), "cell_distance": F.col("_c.distance")}).drop("_c")


def write_cells(assigned: DataFrame, path: str) -> None:
    """Store assigned vectors by cell.

    Rebalancing brings each cell together in files of even size, and cuts a large cell into
    several tasks; the vectors are assigned and shuffled once.
    """
    assigned.hint("rebalance", "cell").write.partitionBy("cell").mode("overwrite").parquet(path)


def _probe(queries: DataFrame, centroids: DataFrame, choose) -> DataFrame:
    """Asks of each query for the cells that `choose(distances, k)` marks."""
    table = _collect_centroids(centroids)
    shared = queries.sparkSession.sparkContext.broadcast(
        (_matrix(table.column("embedding")), _plain(table.column("cell")))
    )

    def cells_of(embedding: pa.Array, k: pa.Array) -> pa.Array:
        matrix, cells = shared.value
        at, rows = _masked(embedding)
        counts, picked = np.zeros(len(embedding), int), []
        _same_width(rows, matrix)
        # A few rows at a time, so that distances to all centroids stay small.
        step = max(1, 4_000_000 // max(1, matrix.size))
        limits = k.to_numpy()[at]
        for i in range(0, len(rows), step):
            gap = rows[i:i + step, None, :] - matrix[None, :, :]
            chosen = choose(np.einsum("qcd,qcd->qc", gap, gap), limits[i:i + step])
            counts[at[i:i + step]] = chosen.sum(axis=1)
            picked.append(np.nonzero(chosen)[1])
        ends = np.concatenate([[0], np.cumsum(counts)])
        flat = np.concatenate(picked) if picked else np.empty(0, int)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells.take(pa.array(flat)))

    cell_type = centroids.schema["cell"].dataType
    probe = F.arrow_udf(cells_of, T.ArrayType(cell_type))
    asks = _asks(queries).withColumn("routes", probe("embedding", "k"))
    return asks.withColumn("routes", F.transform("routes", lambda c: c.cast("string")))


def _in_cells(queries: DataFrame, asks: DataFrame, assigned: DataFrame, **options) -> DataFrame:
    """Search the cells that asks name; a query with a `repo_id` only sees that repository's part of them."""
    by_cell = assigned.select("id", "embedding", F.col("cell").cast("string").alias("route"))
    asks = asks.withColumn("routes", F.transform("routes", lambda c: c.cast("string")))
    if "repo_id" not in queries.columns:
        return nearest(asks, by_cell, **options)
    scopes = queries.select("query_id", F.when(F.col("repo_id") != "", F.col("repo_id")).alias("_scope"))
    asks, _ = written_rows(asks.join(scopes, "query_id"), "asks")
    inside = F.transform("routes", lambda c: F.concat(c, F.lit("\u0001"), F.col("_scope")))
    by_both = assigned.select("id", "embedding", F.concat(F.col("cell").cast("string"), F.lit("\u0001"), "repo_id").alias("route"))
    everywhere = nearest(asks.filter("_scope IS NULL").drop("_scope"), by_cell, **options)
    scoped = nearest(asks.filter("_scope IS NOT NULL").withColumn("routes", inside).drop("_scope"), by_both, **options)
    return everywhere.unionByName(scoped)


def ivf_topk(
    queries: DataFrame, assigned: DataFrame, centroids: DataFrame, nprobe=settings.NPROBE,
    copy_bytes=COPY_CENTROID_BYTES, **options
) -> DataFrame:
    """Top-k inside each query's `nprobe` nearest cells, and inside its `repo_id` if it has one; approximate.

    NULL or empty scopes mean everywhere.  Queries without a vector have no hits.
    """
    if _centroid_bytes(centroids) > copy_bytes:
        ask = _asks(queries)
        cells = centroids.select(F.col("cell").alias("id"), "embedding", F.lit(None).cast("string").alias("route"))
        near = nearest(ask.withColumn("k", F.lit(nprobe)), cells, copy_rows=0)
        probed = near.groupBy("query_id").agg(F.collect_list("id").alias("routes"))
        asks = ask.drop("routes").join(probed, "query_id").select("query_id", "embedding", "k", "routes")
        return _in_cells(queries, asks, assigned, **options)

    def closest(distance, k):
        width = min(nprobe, distance.shape[1])
        place = np.argsort(distance, axis=1, kind="stable")[:, :width]
        chosen = np.zeros(distance.shape, bool)
        np.put_along_axis(chosen, place, True, axis=1)
        return chosen

    return _in_cells(queries, _probe(queries, centroids, closest), assigned, **options)


def cell_exact_topk(queries: DataFrame, assigned: DataFrame, centroids: DataFrame, **options) -> DataFrame:
    """Exact top-k that leaves out the cells which cannot hold a hit.

    All vectors of a cell lie within its radius, so the nearest cells that hold k vectors
    bound the k-th distance, and cells that begin beyond that bound are skipped.  Queries with a
    `repo_id` are compared with all vectors of that repository.
    """
    if "repo_id" in queries.columns:
        scoped = F.coalesce(F.col("repo_id") != "", F.lit(False))
        inside = scoped_topk(queries.filter(scoped), assigned, **options)
        return inside.unionByName(cell_exact_topk(queries.filter(~scoped).drop("repo_id"), assigned, centroids, **options))
    stats = assigned.filter("cell IS NOT NULL").groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.max("cell_distance")).alias("radius")
    )
    table = _collect_centroids(centroids.join(stats, "cell"), "n", "radius")
    n = table.column("n").to_numpy()
    radius = table.column("radius").to_numpy()

    def possible(distance, k):
        gap = np.sqrt(distance)
        far = gap + radius
        order = np.argsort(far, axis=1)
        held = np.cumsum(n[order], axis=1)
        enough = np.minimum((held < k[:, None]).sum(axis=1), held.shape[1] - 1)
        bound = np.take_along_axis(far, np.take_along_axis(order, enough[:, None], 1), 1)
        return gap - radius <= bound + 1e-9 * (1.0 + bound)

    asks = _probe(queries, centroids.join(stats, "cell", "left_semi"), possible)
    return nearest(asks, assigned.filter("cell IS NOT NULL").select("id", "embedding", F.col("cell").cast("string").alias("route")), **options)


# --- results ---------------------------------------------------------------------------

# A hit is two ids, a rank and a distance: some tens of MB at most are copied.
COPY_HITS = 200_000


def join_hits(hits: DataFrame, single: DataFrame, copy_hits=COPY_HITS) -> DataFrame:
    """Hits joined with a table that has one row per `id`."""
    hits, rows = written_rows(hits, "hits")
    if rows <= copy_hits:
        return F.broadcast(hits).join(single, "id")
    # Most snippets are in no hit; they go before any shuffle.
    found = marked_likely(single, hits.select("id"), ["id"], "_hit").filter("_hit").drop("_hit")
    return salted_join(hits, found, ["id"], ["query_id", "rank"])


RESULT_FIELDS = [
    "file_path", "language", "content", "start_line", "end_line", "function_name", "class_name",
]


def with_snippets(hits: DataFrame, snippets: DataFrame, fields=None) -> DataFrame:
    """Hits with their snippet and score.  Hits without a snippet drop out; ranks stay.

    The hits are written first, which also counts them.  Up to `COPY_HITS` they are copied to
    the tasks and the snippets stay where they are.  Beyond it both are shuffled by id, and a
    snippet that is hit very often is split over tasks.
    """
    fields = [f for f in (fields or RESULT_FIELDS) if f in snippets.columns]
    found = join_hits(hits, snippets.select("id", *fields))
    return found.select(
        "query_id", "rank", "id", *fields, scores.similarity(F.col("distance")).alias("score")
    )


def responses(queries: DataFrame, results: DataFrame) -> DataFrame:
    """One row per query: its results in rank order, and their `count`.

    A query has at most the maximum k results, so its group is small.
    """
    fields = [c for c in results.columns if c != "query_id"]
    ordered = F.array_sort(F.collect_list(F.struct(*["rank"] + [c for c in fields if c != "rank"])))
    grouped = results.groupBy("query_id").agg(ordered.alias("results"))
    joined = queries.join(grouped, "query_id", "left")
    return joined.withColumn("count", F.greatest(F.coalesce(F.size("results"), F.lit(0)), F.lit(0)))

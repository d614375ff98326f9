"""An inverted file of two levels: coarse cells, and in each as many fine cells as it needs.

Only the coarse centroids are ever copied to the tasks, and their size is checked.  Fine centroids
stay in a table: vectors and queries meet those of a coarse cell in blocks, so their number may
grow with the data.  How many vectors a cell has, and how far they reach, is kept at build.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from snipquarry import settings
from snipquarry.operators.search import (
    _asks, _centroid_bytes, _collect_centroids, _in_cells, _masked, _matrix, _plain, _probe, _same_width, assign_cells,
    nearest, scoped_topk, train_centroids,
)
from snipquarry.operators.vectors import mean_pool
from snipquarry.plans.scratch import written

# Most bytes of coarse centroids, which every task holds.
COARSE_BYTES = 64 * 1024 * 1024
# Vectors that coarse centroids, and those of one coarse cell, are trained on: about this many, chosen by a hash.
COARSE_SAMPLE, FINE_SAMPLE = 1_000_000, 20_000
# Vectors that a fine cell should have, and most fine cells of a coarse one.
CELL_ROWS, MOST_FINE = 1_000, 1_024
# Rows of a block that meets the fine centroids of a coarse cell.
BLOCK = 20_000
# A query that reaches more fine cells of a coarse one than this is compared with the whole of it: one row, not one a cell.
MOST_OPENED = 8
_SHARE = 1 << 20


@dataclass
class Tree:
    """Stored tables: coarse (cell, embedding, n, radius), fine (coarse, cell, embedding, n, radius), and the vectors
    with their coarse cell, cell and squared distances to both centroids."""

    coarse: DataFrame
    fine: DataFrame
    assigned: DataFrame


def _squares(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, by one matrix product; not exact to the last digits."""
    _same_width(rows, centroids)
    return np.maximum((rows ** 2).sum(1)[:, None] - 2 * rows @ centroids.T + (centroids ** 2).sum(1)[None], 0)


def _means(rows: np.ndarray, k: int, iterations: int) -> np.ndarray:
    """Centroids of at most k groups of rows by Lloyd's steps, from distinct rows evenly spread over the rows."""
    distinct = np.unique(rows, axis=0)
    # Rows in the order of their first component would begin side by side.
    distinct = distinct[np.argsort((distinct @ np.sin(np.arange(1, distinct.shape[1] + 1))) % 1.0, kind="stable")]
    at = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)]
    for _ in range(iterations):
        own = _squares(rows, at).argmin(axis=1)
        counts = np.bincount(own, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, own, rows)
        at = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], at)
    return at


def _fine_centroids(assigned: DataFrame, sizes: DataFrame, iterations: int, sample: int) -> DataFrame:
    """(coarse, cell, embedding), trained in each coarse cell on about `sample` of its vectors."""
    rows = assigned.join(F.broadcast(sizes), "coarse")
    chosen = F.pmod(F.xxhash64("id"), F.lit(_SHARE)) < F.ceil(F.lit(float(_SHARE) * sample) / F.col("size"))

    def train(table: pa.Table) -> pa.Table:
        fine = table.column("fine")[0].as_py()
        order = np.argsort(table.column("id").cast(pa.string()).to_numpy(zero_copy_only=False), kind="stable")
        at = _means(_matrix(table.column("embedding"))[order], fine, iterations)
        coarse = table.column("coarse").slice(0, 1).combine_chunks().take(pa.array([0] * len(at)))
        return pa.table({"coarse": coarse, "cell": [f"{coarse[0]}.{i}" for i in range(len(at))], "embedding": list(at)})

    kind = assigned.schema["coarse"].dataType.simpleString()
    grouped = rows.filter(chosen).select("coarse", "fine", "id", "embedding").groupBy("coarse")
    return grouped.applyInArrow(train, f"coarse {kind}, cell string, embedding array<double>")


def _meet(rows: DataFrame, fine: DataFrame, run, schema) -> DataFrame:
    """`run(rows, cells)` for each coarse cell's fine cells and each block of the rows that name it (`coarse`, `id`)."""
    sizes = rows.groupBy("coarse").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = written(sizes, "coarse_blocks")
    left = rows.join(F.broadcast(sizes), "coarse").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    right = fine.join(F.broadcast(sizes), "coarse").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = right.drop("blocks").withColumnRenamed("coarse", "_coarse")
    return left.groupBy("coarse", "block").cogroup(right.groupBy("_coarse", "_block")).applyInArrow(run, schema)


def _assigned(rows: DataFrame, fine: DataFrame) -> DataFrame:
    """The rows with the nearest fine cell of their coarse cell, and the squared distance to its centroid."""
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.StringType()), T.StructField("cell_distance", T.DoubleType())])
    names = rows.columns

    def run(held: pa.Table, cells: pa.Table) -> pa.Table:
        if not held.num_rows or not cells.num_rows:
            return pa.table({c: held.column(c).slice(0, 0) if c in names else pa.array([], pa.string() if c == "cell" else pa.float64()) for c in [*names, "cell", "cell_distance"]})
        vectors, at = _matrix(held.column("embedding")), _matrix(cells.column("embedding"))
        own = np.concatenate([_squares(vectors[i:i + 4096], at).argmin(axis=1) for i in range(0, len(vectors), 4096)])
        distance = ((vectors - at[own]) ** 2).sum(axis=1)
        made = held.select(names).append_column("cell", _plain(cells.column("cell")).take(pa.array(own)))
        return made.append_column("cell_distance", pa.array(distance))

    return _meet(rows, fine, run, schema)


def build(
    vectors: DataFrame, coarse=64, cell_rows=CELL_ROWS, iterations=8, seed=42,
    coarse_sample=COARSE_SAMPLE, fine_sample=FINE_SAMPLE,
) -> Tree:
    """A tree over stored vectors (id, embedding, and columns to keep, such as repo_id); rows without an embedding are left out.

    A coarse cell of n vectors gets n / `cell_rows` fine cells, at most MOST_FINE; equal vectors share a cell, however
    many they are.
    """
    present = vectors.filter("embedding IS NOT NULL")
    n = present.count()
    if not n:
        raise ValueError("no vectors to build cells from")
    if min(coarse, n) > 1:
        centroids = train_centroids(present, min(coarse, n), seed, fraction=min(1.0, coarse_sample / n))
    else:
        centroids = mean_pool(present.select(F.lit(0).alias("cell"), F.col("embedding").alias("vec"), F.lit(1).alias("mask")), "cell")
    centroids = written(centroids, "coarse")
    if (size := _centroid_bytes(centroids)) > COARSE_BYTES:
        raise ValueError(f"{size} bytes of coarse centroids; every task holds them, so at most {COARSE_BYTES}: ask for fewer")
    rows = assign_cells(present, centroids).withColumnsRenamed({"cell": "coarse", "cell_distance": "coarse_distance"})
    rows = written(rows, "coarse_cells")
    # One row a coarse cell.
    sizes = rows.groupBy("coarse").agg(F.count(F.lit(1)).alias("size"))
    sizes = written(sizes.withColumn("fine", F.least(F.ceil(F.col("size") / cell_rows), F.lit(MOST_FINE)).cast("int")), "coarse_sizes")
    fine = written(_fine_centroids(rows, sizes, iterations, fine_sample), "fine")
    assigned = written(_assigned(rows, fine), "cells")

    def reach(distance):
        return F.count(F.lit(1)).alias("n"), F.sqrt(F.max(distance)).alias("radius")

    by_coarse = assigned.groupBy(F.col("coarse").alias("cell")).agg(*reach("coarse_distance"))
    return Tree(
        written(centroids.join(by_coarse, "cell"), "coarse_index"),
        written(fine.join(assigned.groupBy("cell").agg(*reach("cell_distance")), "cell"), "fine_index"),
        assigned,
    )


def _closest(width: int):
    def choose(distance, k):
        place = np.argsort(distance, axis=1, kind="stable")[:, :min(width, distance.shape[1])]
        chosen = np.zeros(distance.shape, bool)
        np.put_along_axis(chosen, place, True, axis=1)
        return chosen

    return choose


def tree_topk(queries: DataFrame, tree: Tree, nprobe=settings.NPROBE, coarse_probe=4, **options) -> DataFrame:
    """Top-k inside the `nprobe` nearest fine cells of each query's `coarse_probe` nearest coarse cells, and inside
    its `repo_id` if it has one; approximate.  Queries without a vector have no hits."""
    asks = written(_probe(queries.filter("embedding IS NOT NULL"), tree.coarse, _closest(coarse_probe)), "coarse_asks")
    cells = tree.fine.select(F.col("cell").alias("id"), "embedding", F.col("coarse").cast("string").alias("route"))
    near = nearest(asks.withColumn("k", F.lit(nprobe)), cells)
    probed = near.groupBy("query_id").agg(F.collect_list("id").alias("routes"))
    asks = asks.drop("routes").join(probed, "query_id").select("query_id", "embedding", "k", "routes")
    return _in_cells(queries, asks, tree.assigned, **options)


def _within_coarse(asks: DataFrame, coarse: DataFrame) -> DataFrame:
    """Asks (..., embedding, bound) with the coarse cells that reach into their bound, one row each."""
    table = _collect_centroids(coarse, "radius")
    shared = asks.sparkSession.sparkContext.broadcast((_matrix(table.column("embedding")), _plain(table.column("cell")), table.column("radius").to_numpy()))

    def possible(embedding: pa.Array, bound: pa.Array) -> pa.Array:
        matrix, cells, radius = shared.value
        at, rows = _masked(embedding)
        picked = []
        limits = bound.to_numpy(zero_copy_only=False)[at]
        for i in range(0, len(rows), 1024):
            picked.append(_reaching(rows[i:i + 1024], matrix, radius, limits[i:i + 1024]))
        chosen = np.concatenate(picked) if picked else np.zeros((0, len(cells)), bool)
        counts = np.zeros(len(embedding), int)
        counts[at] = chosen.sum(axis=1)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), cells.take(pa.array(np.nonzero(chosen)[1])))

    udf = F.arrow_udf(possible, T.ArrayType(coarse.schema["cell"].dataType))
    return asks.withColumn("coarse", F.explode(udf("embedding", "bound")))


def _reaching(rows, centroids, radius, bound) -> np.ndarray:
    """Which cells can hold a vector within the bound of each row.  Rounding opens a cell rather than not."""
    square = _squares(rows, centroids)
    slack = 1e-6 * (1 + (rows ** 2).sum(1)[:, None] + (centroids ** 2).sum(1)[None])
    return np.sqrt(np.maximum(square - slack, 0)) - radius[None] <= bound[:, None] * (1 + 1e-9) + 1e-9


def tree_exact_topk(queries: DataFrame, tree: Tree, nprobe=settings.NPROBE, coarse_probe=4, **options) -> DataFrame:
    """Exact top-k that opens only cells which can hold a hit.

    The k-th distance in the cells that `tree_topk` probes bounds the true one.  Coarse cells that begin
    beyond it are skipped as a whole, and of the others the fine cells that do, unless the query
    reaches more than MOST_OPENED of them: so a query names few cells, however many there are.  A query
    whose probed cells hold fewer than k vectors has no bound and is compared with all.  Queries with a
    `repo_id` are compared with all vectors of that repository.
    """
    if "repo_id" in queries.columns:
        scoped = F.coalesce(F.col("repo_id") != "", F.lit(False))
        inside = scoped_topk(queries.filter(scoped), tree.assigned, **options)
        return inside.unionByName(tree_exact_topk(queries.filter(~scoped).drop("repo_id"), tree, nprobe, coarse_probe, **options))
    asks = written(_asks(queries.filter("embedding IS NOT NULL")), "asks")
    found = tree_topk(asks, tree, nprobe, coarse_probe, squared=True, **{k: v for k, v in options.items() if k != "squared"})
    last = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("held"), F.sqrt(F.max("distance")).alias("last"))
    endless = F.lit(float("inf"))
    bounded = asks.join(last, "query_id", "left").withColumn("bound", F.when(F.col("held") >= F.col("k"), F.col("last")).otherwise(endless))
    rows = _within_coarse(bounded.select("query_id", "embedding", "bound"), tree.coarse)
    rows = written(rows.withColumn("id", F.col("query_id")), "coarse_candidates")
    kind = asks.schema["query_id"].dataType

    def run(held: pa.Table, cells: pa.Table) -> pa.Table:
        if not held.num_rows or not cells.num_rows:
            return pa.table({"query_id": held.column("query_id").slice(0, 0), "cell": pa.array([], pa.string())})
        vectors, bound, at = _matrix(held.column("embedding")), held.column("bound").to_numpy(), _matrix(cells.column("embedding"))
        radius, parts = cells.column("radius").to_numpy(), []
        for i in range(0, len(vectors), 1024):
            reached = _reaching(vectors[i:i + 1024], at, radius, bound[i:i + 1024])
            many = reached.sum(axis=1) > MOST_OPENED
            reached[many] = False
            q, c = np.nonzero(reached)
            whole = np.flatnonzero(many)
            parts.append((np.concatenate([q, whole]) + i, np.concatenate([c, np.full(len(whole), len(at))])))
        q, c = (np.concatenate(x) for x in zip(*parts))
        # The last name is that of the whole coarse cell.
        names = pa.array([*cells.column("cell").to_pylist(), _whole(held.column("coarse")[0].as_py())], pa.string())
        return pa.table({"query_id": held.column("query_id").take(pa.array(q)), "cell": names.take(pa.array(c))})

    schema = T.StructType([T.StructField("query_id", kind), T.StructField("cell", T.StringType())])
    opened = _meet(rows, tree.fine, run, schema).groupBy("query_id").agg(F.collect_list("cell").alias("routes"))
    asks = asks.drop("routes").join(opened, "query_id").select("query_id", "embedding", "k", "routes")
    cells = tree.assigned.withColumn("cell", F.explode(F.array("cell", F.concat(F.lit(WHOLE), F.col("coarse").cast("string")))))
    return _in_cells(asks.drop("routes"), asks, cells, **options)


WHOLE = "all of "


def _whole(coarse) -> str:
    return f"{WHOLE}{coarse}"

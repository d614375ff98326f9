"""How asks and vectors meet in blocks: what is sent, and hits over blocks that come one after another."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from snipquarry.operators import search


def test_grids_send_little():
    """Six times the vectors of 1 GB as asks for up to 100 hits each: few copies, and no task holds many hits."""
    n, dim, k = 615_000, 64, 100
    asks, vectors = search._grid(n, n, dim, k, 48)
    assert n * k / asks <= search.HELD_HITS
    sent = asks * n * 4 * dim + vectors * n * (4 * dim + 40 * k)
    assert sent < 25e9


def test_given_blocks_grow_with_the_input(spark):
    of_asks, of_vectors = search._sizes(10**5, 10**5, 64, 5, 48, block_vectors=40, block_asks=60)
    got = spark.createDataFrame([(10**5,), (100,), (0,)], "n long").select(of_asks(F.col("n")), of_vectors(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(6, 6), (2, 3), (0, 0)]


def test_hits_over_many_batches():
    """Groups come in pieces of a few rows; queries carry their own k, and some vectors are missing."""
    rng = np.random.default_rng(5)
    vectors, queries = rng.integers(0, 3, (200, 4)).astype(float), rng.integers(0, 3, (15, 4)) + 0.25
    k = rng.integers(1, 12, 15)
    rows = []
    for group in ("a", "b"):
        rows += [(i, None, queries[i].tolist(), int(k[i]), group, 0) for i in range(15)]
        own = range(0, 200) if group == "a" else range(0, 200, 2)
        rows += [(None, j, vectors[j].tolist() if j % 7 else None, None, group, 1) for j in own]
    types = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.string(), pa.int32()]
    names = ["query_id", "id", "embedding", "k", "_group", "_side"]
    table = pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types))})
    got = [r for b in search._meet(iter(table.to_batches(max_chunksize=13))) for r in b.to_pylist()]
    for ids in (range(200), range(0, 200, 2)):
        part, got = got[:int(k.sum())], got[int(k.sum()):]
        for i in range(15):
            near = sorted((((queries[i] - vectors[j]) ** 2).sum(), j) for j in ids if j % 7)
            assert [r["id"] for r in part if r["query_id"] == i] == [j for _, j in near[:k[i]]]


def test_bounds_and_lengths():
    """Vectors of very different lengths, where most need no look, and hits beyond a given bound stay out."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(5_000, 8)) * rng.lognormal(0, 3, (5_000, 1))
    queries = rng.normal(size=(40, 8)) * rng.lognormal(0, 2, (40, 1))
    k, bound = np.full(40, 6), np.where(np.arange(40) % 2, np.inf, 0.5)
    q, _, d = search._best(queries, k, vectors, np.arange(5_000), bound)
    for i in range(40):
        near = np.sort(((queries[i] - vectors) ** 2).sum(1))[:6]
        assert np.allclose(d[q == i], near[near <= bound[i]])

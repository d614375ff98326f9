"""Nearest vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snipquarry.operators import search

DIM = 8
WAYS = {
    "copied": {},
    "blocks": {"copy_rows": 0},
    "small blocks": {"copy_rows": 0, "block_vectors": 37, "block_asks": 11},
}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(600, DIM)).astype(np.float32)
    # A third of all vectors are copies of one, and a third belong to one repository.
    vectors[::3] = vectors[0]
    repos = ["big" if i % 3 < 2 else f"r{i % 5}" for i in range(600)]
    queries = rng.normal(size=(60, DIM)).astype(np.float32)
    queries[5] = vectors[0]
    scopes = [None if i % 4 == 0 else "" if i % 4 == 1 else "big" if i % 4 == 2 else f"r{i % 7}" for i in range(60)]
    ks = [None if i == 7 else [1, 5, 40, 200, -3][i % 5] for i in range(60)]
    rows = [(f"v{i:04d}", repos[i], vectors[i].tolist()) for i in range(600)] + [("v9998", "big", None)]
    v = spark.createDataFrame(rows, "id string, repo_id string, embedding array<float>").repartition(5)
    q = spark.createDataFrame(
        [(i, queries[i].tolist(), ks[i], scopes[i]) for i in range(60)],
        "query_id int, embedding array<float>, k int, repo_id string",
    )
    return v, q, vectors.astype(float), queries.astype(float), repos, scopes, ks


def _brute(data, scoped):
    _, _, vectors, queries, repos, scopes, ks = data
    out = {}
    for i, query in enumerate(queries):
        k = 5 if ks[i] is None else min(max(ks[i], 1), 100)
        near = sorted(
            (float(((query - vectors[j]) ** 2).sum()), f"v{j:04d}") for j in range(600)
            if not (scoped and scopes[i]) or repos[j] == scopes[i]
        )
        out[i] = [(n + 1, name, round(d, 6)) for n, (d, name) in enumerate(near[:k])]
    return out


def _hits(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.distance, 6)))
    return out


@pytest.mark.parametrize("way", WAYS)
def test_exact(data, way):
    v, q = data[:2]
    assert _hits(search.exact_topk(q, v, **WAYS[way])) == _brute(data, scoped=False)


@pytest.mark.parametrize("way", WAYS)
def test_scoped(data, way):
    v, q = data[:2]
    want = {i: hits for i, hits in _brute(data, scoped=True).items() if hits}
    assert _hits(search.scoped_topk(q, v, **WAYS[way])) == want


def test_distance_itself(data):
    v, q = data[:2]
    squared = _hits(search.exact_topk(q, v))
    plain = _hits(search.exact_topk(q, v, squared=False))
    assert all(abs(a[2] ** 0.5 - b[2]) < 1e-5 for i in squared for a, b in zip(squared[i], plain[i]))


@pytest.fixture(scope="module")
def cells(spark, data):
    v = data[0]
    known = v.filter("embedding IS NOT NULL")
    centroids = search.train_centroids(known, cells=9, seed=1)
    return centroids, search.assign_cells(known, centroids)


@pytest.mark.parametrize("way", WAYS)
def test_cells_are_exact_when_all_or_bounded(data, cells, way):
    q = data[1].drop("repo_id")
    centroids, assigned = cells
    want = _brute(data, scoped=False)
    assert _hits(search.ivf_topk(q, assigned, centroids, nprobe=9, **WAYS[way])) == want
    assert _hits(search.cell_exact_topk(q, assigned, centroids, **WAYS[way])) == want


def test_probing_few_cells(data, cells):
    q, vectors, queries = data[1].drop("repo_id"), data[2], data[3]
    centroids, assigned = cells
    centre = {r.cell: np.array(r.embedding) for r in centroids.collect()}
    names = sorted(centre)
    cell = [min(names, key=lambda c: (((x - centre[c]) ** 2).sum(), c)) for x in vectors]
    got = _hits(search.ivf_topk(q, assigned, centroids, nprobe=2))
    for i in (0, 11, 23):
        probed = sorted(names, key=lambda c: ((queries[i] - centre[c]) ** 2).sum())[:2]
        near = sorted(
            (float(((queries[i] - vectors[j]) ** 2).sum()), f"v{j:04d}") for j in range(600) if cell[j] in probed
        )
        k = min(max([1, 5, 40, 200, -3][i % 5], 1), 100)
        assert [h[1] for h in got[i]] == [n for _, n in near[:k]]


def test_stored_cells(spark, data, cells, tmp_path):
    q = data[1].drop("repo_id")
    centroids, assigned = cells
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        search.write_cells(assigned, str(tmp_path / "cells"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    stored = spark.read.parquet(str(tmp_path / "cells"))
    assert stored.count() == 600
    named = stored.select("cell", F.input_file_name().alias("file"))
    files = named.groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))
    hot = files.orderBy(F.desc("n")).first()
    assert hot.n >= 200 and hot.files > 1
    assert _hits(search.ivf_topk(q, stored, centroids, nprobe=9)) == _brute(data, scoped=False)


@pytest.mark.parametrize("copied", [True, False])
def test_results_and_responses(spark, data, copied, monkeypatch):
    if not copied:
        monkeypatch.setattr(search.join_hits, "__defaults__", (0,))
    v, q = data[:2]
    # Every other snippet is missing.
    snippets = v.filter(F.substring("id", -1, 1).cast("int") % 2 == 0).select(
        "id", F.lit("p").alias("file_path"), F.lit("Go").alias("language"), F.col("id").alias("content"),
        F.lit(1).alias("start_line"), F.lit(2).alias("end_line"),
    )
    hits = search.exact_topk(q, v)
    results = search.with_snippets(hits, snippets)
    want = {
        i: [(n, name, round(1 / (1 + d), 5)) for n, name, d in found if int(name[-1]) % 2 == 0]
        for i, found in _brute(data, scoped=False).items()
    }
    got = {}
    for r in results.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.score, 5)))
    assert got == {i: rows for i, rows in want.items() if rows}
    answered = {r.query_id: r for r in search.responses(q.select("query_id"), results).collect()}
    assert {i: r["count"] for i, r in answered.items()} == {i: len(rows) for i, rows in want.items()}
    assert [x.id for x in answered[3].results] == [x[1] for x in want[3]]


def test_cells_with_scopes(data, cells):
    q = data[1]
    centroids, assigned = cells
    want = {i: hits for i, hits in _brute(data, scoped=True).items() if hits}
    assert _hits(search.ivf_topk(q, assigned, centroids, nprobe=9)) == want
    assert _hits(search.cell_exact_topk(q, assigned, centroids)) == want


def test_any_number_of_cells(data, cells):
    """Centroids that are not copied give the same cells and hits."""
    v, q = data[0], data[1].drop("repo_id")
    centroids, assigned = cells
    met = search.assign_cells(v, centroids, copy_bytes=0)
    own = {r.id: r.cell for r in assigned.collect()}
    assert {r.id: r.cell for r in met.collect()} == {**own, "v9998": None}
    few = _hits(search.ivf_topk(q, assigned, centroids, nprobe=2))
    assert _hits(search.ivf_topk(q, assigned, centroids, nprobe=2, copy_bytes=0)) == few


def test_more_hits_than_a_request_may_ask_for(data):
    v, q = data[:2]
    asks = q.limit(1).select("query_id", "embedding", F.lit(150).alias("k"), F.lit(None).cast("array<string>").alias("routes"))
    found = search.nearest(asks, v.select("id", "embedding", F.lit(None).cast("string").alias("route")))
    assert [r["rank"] for r in found.orderBy("rank").collect()] == list(range(1, 151))


def test_missing_vectors_change_nothing(spark):
    """Asks and vectors without an embedding are left out, and the others keep their own hits."""
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [10.0, 1.0]), (3, None)], "id int, embedding array<double>")
    centroids = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 0.0])], "cell int, embedding array<double>")
    q = spark.createDataFrame([(7, None), (8, [10.0, 0.0]), (9, None)], "query_id int, embedding array<double>").coalesce(1)
    assigned = search.assign_cells(v, centroids)
    assert {r.id: r.cell for r in assigned.collect()} == {1: 0, 2: 1, 3: None}
    for options in ({}, {"copy_rows": 0}):
        assert _hits(search.ivf_topk(q.withColumn("k", F.lit(1)), assigned, centroids, nprobe=1, **options)) == {8: [(1, 2, 1.0)]}
        assert _hits(search.cell_exact_topk(q.withColumn("k", F.lit(1)), assigned, centroids, **options)) == {8: [(1, 2, 1.0)]}


def test_widths_that_differ_fail(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [10.0] * 6)], "id int, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(8, [10.0] * 4)], "query_id int, embedding array<double>")
    with pytest.raises(Exception, match="components in one search"):
        search.exact_topk(q, v).collect()
    with pytest.raises(Exception, match="components in one search"):
        search.exact_topk(q, v.filter("id = 1")).collect()

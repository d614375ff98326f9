"""Two levels of cells against plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snipquarry.operators import cells, evaluation, search

SCHEMA = "id long, repo_id string, embedding array<double>"


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 6, (12, 5))
    rows = [(i, f"r{i % 4}", (middle[rng.integers(12)] + rng.normal(0, 1, 5)).tolist()) for i in range(600)]
    rows += [(1000 + i, "r9", [0.5] * 5) for i in range(300)] + [(2000, "r1", None), (2001, None, [1.0] * 5)]
    path = str(tmp_path_factory.mktemp("v") / "vectors")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def tree(vectors):
    return cells.build(vectors, coarse=6, cell_rows=40, fine_sample=200)


def hits(found):
    return {(r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in found.collect()}


def asked(vectors, scope=None):
    queries = vectors.filter("id % 7 = 0 OR id >= 1290").select(F.col("id").alias("query_id"), "embedding", *([scope] if scope is not None else []))
    return queries.withColumn("k", F.col("query_id") % 9 + 1)


def test_every_vector_is_in_a_cell_of_its_coarse_cell(vectors, tree):
    rows = {r.id: r for r in tree.assigned.collect()}
    assert set(rows) == {r.id for r in vectors.filter("embedding IS NOT NULL").collect()}
    fine = {r.cell: r for r in tree.fine.collect()}
    coarse = {r.cell: r for r in tree.coarse.collect()}
    assert 6 < len(fine) and sum(f.n for f in fine.values()) == sum(c.n for c in coarse.values()) == len(rows)
    for r in rows.values():
        own = [f for f in fine.values() if f.coarse == r.coarse]
        near = min(((np.array(f.embedding) - r.embedding) ** 2).sum() for f in own)
        assert fine[r.cell].coarse == r.coarse and abs(near - r.cell_distance) < 1e-9
        assert r.cell_distance <= fine[r.cell].radius ** 2 + 1e-9 and r.coarse_distance <= coarse[r.coarse].radius ** 2 + 1e-9
    # Copies are in one cell, however many.
    assert len({rows[i].cell for i in range(1000, 1300)}) == 1


@pytest.mark.parametrize("nprobe, coarse_probe", [(1, 1), (4, 2)])
def test_exact_search_is_exact(vectors, tree, nprobe, coarse_probe):
    assert hits(cells.tree_exact_topk(asked(vectors), tree, nprobe, coarse_probe)) == hits(search.exact_topk(asked(vectors), vectors))


def test_it_opens_few_cells(spark, vectors, tree, monkeypatch):
    opened = []
    inside = cells._in_cells
    monkeypatch.setattr(cells, "_in_cells", lambda q, a, v, **o: opened.append(a.agg(F.sum(F.size("routes"))).first()[0]) or inside(q, a, v, **o))
    queries = asked(vectors).withColumn("k", F.lit(3))
    cells.tree_exact_topk(queries, tree, 4, 2).count()
    assert opened[1] < 0.7 * queries.count() * tree.fine.count()


def test_scopes(vectors, tree):
    scope = F.when(F.col("id") % 2 == 0, F.col("repo_id")).alias("repo_id")
    want = hits(search.scoped_topk(asked(vectors, scope), vectors))
    assert hits(cells.tree_exact_topk(asked(vectors, scope), tree, 4, 2)) == want
    assert hits(cells.tree_topk(asked(vectors, scope), tree, 1000, 6)) == want


def test_recall_grows_to_all(vectors, tree):
    exact = search.exact_topk(asked(vectors), vectors)
    few, all_ = (evaluation.overlap(cells.tree_topk(asked(vectors), tree, n, c), exact).first().recall for n, c in ((1, 1), (1000, 6)))
    assert 0.5 < few < all_ == 1


def test_bounds(spark, vectors, monkeypatch):
    with pytest.raises(ValueError, match="no vectors"):
        cells.build(vectors.limit(0))
    monkeypatch.setattr(cells, "COARSE_BYTES", 100)
    with pytest.raises(ValueError, match="coarse centroids"):
        cells.build(vectors, coarse=6)


def test_one_vector(spark, vectors):
    tree = cells.build(vectors.filter("id = 3"), coarse=6)
    found = hits(cells.tree_exact_topk(asked(vectors), tree))
    assert len(found) == asked(vectors).filter("embedding IS NOT NULL").count() and {h[2] for h in found} == {3}

"""Exact search over cells that reach far: how many cells a query names."""

import numpy as np
from pyspark.sql import functions as F

from snipquarry.operators import cells, search


def test_a_query_names_few_cells(spark, tmp_path, monkeypatch):
    """Vectors without structure, so that nearly every cell can hold a hit."""
    rng = np.random.default_rng(8)
    path = str(tmp_path / "vectors")
    spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(500)], "id long, embedding array<double>").write.parquet(path)
    vectors, opened, inside = spark.read.parquet(path), [], cells._in_cells
    tree = cells.build(vectors, coarse=3, cell_rows=5)
    monkeypatch.setattr(cells, "_in_cells", lambda q, a, v, **o: opened.append(a.agg(F.max(F.size("routes"))).first()[0]) or inside(q, a, v, **o))
    queries = vectors.filter("id % 9 = 0").select(F.col("id").alias("query_id"), "embedding")

    def hits(found):
        return {(r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in found.collect()}

    assert hits(cells.tree_exact_topk(queries, tree, 4, 2)) == hits(search.exact_topk(queries, vectors))
    assert tree.fine.count() > 90 and opened[1] <= 3 * 8

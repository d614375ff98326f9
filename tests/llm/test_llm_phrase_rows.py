"""How counts of phrases go to Spark and to their folders."""

from collections import Counter

import numpy as np
import pyarrow as pa

from snipquarry.llm import phrases


class _Rows:
    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    groupBy = agg = select


def test_counts_come_in_small_batches(monkeypatch):
    monkeypatch.setattr(phrases, "COUNT_ROWS", 7)
    words = np.array([*range(1, 31), 0, *range(1, 11), 0], np.uint64)
    scan = phrases._scan(_Rows(), True, {}, 2)
    made = list(scan.run([pa.RecordBatch.from_pydict({"tokens": [words.tobytes()] * 2})]))
    assert max(b.num_rows for b in made) <= 7
    found = Counter()
    for b in made:
        found.update(dict(zip(b.column("w1").to_pylist(), b.column("n").to_pylist())))
    assert found == {w: 4 if w <= 10 else 2 for w in range(1, 31)}


def test_folders_are_written_without_a_sort(spark, tmp_path):
    name, rows = "spark.sql.maxConcurrentOutputFileWriters", spark.range(0, 60, 1, 1).selectExpr("id", "CAST(id % 3 AS int) AS part")
    before = spark.conf.get(name)
    phrases._write_by(rows, "part", str(tmp_path / "out"))
    assert spark.conf.get(name) == before
    # Rows of a folder stand as they came, and all three were open together.
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("id", "part").collect())) == sorted(map(tuple, rows.collect()))
    assert len(list((tmp_path / "out").glob("part=*/*.parquet"))) == 3


def test_stored_rows_stay_small(spark):
    """No row of hashed words takes whole regions of an executor's heap, and none is left out."""
    texts = [("en", " ".join(f"w{(7 * i + j) % 900}" for j in range(2000))) for i in range(60)]
    documents = spark.createDataFrame(texts, "lang string, text string").coalesce(1)
    rows = phrases._stored(documents, 2, 0).filter("shard >= 0").selectExpr("length(tokens) AS n").collect()
    assert max(r.n for r in rows) <= 512 << 10 and sum(r.n for r in rows) == 8 * 60 * 2001

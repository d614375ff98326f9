"""The registered queries against their SQL forms, and the pipeline as a whole."""

import duckdb
import pytest
from conftest import SMALL
from oracle import normal
from pyspark.sql import functions as F

import __spark_entry__ as entries
import corpus_pipeline
from snipquarry.llm import line_dedup
from snipquarry.llm.queries import ORACLES, QUERIES


def sql_rows(sql):
    db = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    found = db.execute(sql)
    return normal([c[0] for c in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n != "pipeline"))
def test_same_as_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    want = sql_rows(ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1] and got[1]


def test_benchmark_items_without_an_id(spark, tmp_path):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    # Passages of documents without an id, next to the items of the table.
    more = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id % 40 = 3").select(
        F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), "text"
    )
    items.select("item_id", "text").unionByName(more).coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{SMALL}/documents.parquet").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["op6_decontaminate"](spark, str(tmp_path))
    assert df.filter("contaminated").count() >= more.filter("length(text) > 100").count() > 0
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = db.execute(ORACLES["op6_decontaminate"])
    assert got == normal([c[0] for c in found.description], found.fetchall())


def test_line_stage_keeps_what_the_operator_keeps(spark):
    # The rows are read in another order than that of their ids.
    line = "this line stands in each of the documents of the table"
    rows = [(i * 7 % 30, f"own words {i}\n{line}" + (f"\n{line} {i % 3}" if i % 2 else "")) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    want = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, SMALL).collect()}
    assert got == want and [d for d, t in got.items() if line in t.split("\n")] == [29]
    # Of rows that share the largest id, one keeps the line; a missing id is the smallest.
    odd = [(None, line), (5, f"a\n{line}"), (5, f"b\n{line}"), (1, line), (2, line), (None, line)]
    odd = spark.createDataFrame(odd, "doc_id bigint, text string").coalesce(1)
    texts = [(r.doc_id, r.text) for r in corpus_pipeline.drop_lines(spark, odd, SMALL).collect()]
    assert sorted(t for d, t in texts if d == 5) in (["a", f"b\n{line}"], [f"a\n{line}", "b"])
    assert len(texts) == 6 and all(t == "" for d, t in texts if d != 5)


def test_registered():
    names = set(entries.queries())
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert "pipeline" in names


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    kept = {r.doc_id for r in pieces}
    assert kept < ids and len(kept) > 0.7 * len(ids)
    by = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


ODD = [
    (1, None, "x"), (None, "some words stand here alone", "x"), (2, "", None), (2, "", None), (3, " \n\t", "x"),
    (4, "one two three four five six seven", "x"), (4, "one two three four five six seven", "x"),
    (5, "ça va? " * 3000, "x"),
]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, empty):
    docs = spark.createDataFrame([] if empty else ODD, "doc_id bigint, text string, _row string").coalesce(1)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        rows = [tuple(r) for r in out.collect()]
        assert set(rows) <= {tuple(r) for r in docs.collect()}, name
        if name != "ngram_jaccard":
            assert len(rows) == (0 if empty else len(ODD)), name
    if not empty:
        # Of the copies one stays; rows without words or id are in no group.
        assert len(rows) in (len(ODD), len(ODD) - 1)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    # The long text has more than 4096 tokens.
    assert packed.count() >= len(ODD) + 1 if not empty else packed.count() == 0

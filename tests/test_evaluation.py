"""Quality figures on small tables with known results."""

import bisect

import pytest
from pyspark.sql import functions as F

from snipquarry.operators import evaluation, repositories


@pytest.fixture(scope="module")
def hits(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "a"), (2, 2, "d"), (3, 1, "b")]
    return spark.createDataFrame([(q, r, i, 0.0) for q, r, i in rows], "query_id int, rank int, id string, distance double")


def test_lists(spark, hits):
    wanted = spark.createDataFrame(
        [(1, "b"), (1, "c"), (1, "z"), (1, "b"), (2, "a"), (4, "a")], "query_id int, id string"
    )
    judged = evaluation.judge_by_list(hits, wanted)
    row = evaluation.mrr_recall(judged, evaluation.totals_by_list(wanted)).first()
    # Queries 1, 2 and 4 have wanted snippets: first found at rank 2, at rank 1, and never.
    assert row.n_queries == 3
    assert abs(row.mrr - (1 / 2 + 1 + 0) / 3) < 1e-12
    assert abs(row.recall - (2 / 3 + 1 + 0) / 3) < 1e-12


def test_overlap(spark, hits):
    row = evaluation.overlap(hits.filter("rank = 1"), hits).first()
    assert (row.n_hits, row.recall) == (6, 0.5)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 4.99, 5.0, 9.99, 10.0, None)], "x double")
    got = {r.bucket: r.n for r in evaluation.histogram(df, "x", 0, 10, 2).collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 1}


def test_job_figures(spark):
    jobs = spark.createDataFrame(
        [("completed", "2024-01-01 00:00:00", "2024-01-01 00:00:02"), ("completed", "2024-01-01 00:00:00", "2024-01-01 00:00:04"),
         ("failed", "2024-01-01 00:00:00", "2024-01-01 01:00:00"), ("lost", None, None)],
        "status string, s string, e string",
    ).select("status", F.col("s").cast("timestamp").alias("started_at"), F.col("e").cast("timestamp").alias("completed_at"))
    row = evaluation.job_stats(jobs).first()
    assert (row.n_jobs, row.n_completed, row.avg_seconds, row.median_seconds) == (4, 2, 3.0, 2.0)
    assert [r.status for r in repositories.invalid_status(jobs).collect()] == ["lost"]


def test_merged_sketches_are_near_the_exact_quantiles(spark):
    # A third of the values are one.
    log = spark.range(30_000).select((F.col("id") % 17).alias("day"), F.when(F.col("id") % 3 == 0, 5000).otherwise(F.col("id")).alias("v"))
    log = log.unionByName(spark.range(50).select(F.col("id").alias("day"), F.lit(None).cast("long").alias("v")))
    sketches = evaluation.quantile_sketches(log, "v", ["day"])
    assert sketches.count() == 17
    values = sorted(r.v for r in log.filter("v IS NOT NULL").collect())
    for r in evaluation.merged_quantiles(sketches, [0, 0.1, 0.5, 0.95, 1]).collect():
        assert r.n == 30_000
        below, to = bisect.bisect_left(values, r.value), bisect.bisect_right(values, r.value)
        assert below / 30_000 - 0.03 <= r["rank"] <= to / 30_000 + 0.03

"""What a cached search really searches."""

from pyspark.sql import functions as F

from snipquarry import schemas
from snipquarry.operators import inference, service


def test_the_same_is_searched_once(spark, monkeypatch):
    """Requests that miss again after the time to live share one search; another scope, or number of results, has its own."""
    snippets = spark.createDataFrame([(f"s{i}", f"r{i % 2}", t) for i, t in enumerate(["a b", "a", "b c", "a a", "z"])], "id string, repo_id string, content string")
    provider = inference.hash_provider(dim=32)
    vectors = inference.embed(snippets, provider, "content").select("id", "repo_id", "embedding")
    rows = [(i, "a", 2, None, i * 2) for i in range(12)] + [(20, "a", 3, None, 99), (21, "a", 2, "r0", 0), (22, None, 2, "r1", 0), (23, None, 2, "r1", 9)]
    asked = spark.createDataFrame(rows, "query_id int, query string, k int, repo_id string, h int")
    asked = asked.withColumn("requested_at", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours="h")).drop("h")
    searched, search = [], service.scoped_topk
    monkeypatch.setattr(service, "scoped_topk", lambda q, v, **o: searched.append(q.select("query_id").count()) or search(q, v, **o))
    answered, entries = service.retrieve(asked, spark.createDataFrame([], schemas.CACHE), vectors, snippets, provider)
    got = {r.query_id: ([x.id for x in r.results or []], r["count"], r.cached) for r in answered.collect()}
    assert searched == [4] and entries.count() == 16
    assert all(got[i] == (["s1", "s0"], 2, False) for i in range(12))
    assert got[20] == (["s1", "s0", "s3"], 3, False) and got[21][0] == ["s0", "s4"] and got[22] == got[23] == ([], 0, False)

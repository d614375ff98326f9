"""What a suggestion service writes."""

from pyspark.sql import functions as F

from snipquarry.operators import service
from snipquarry.sources.store import Store


def test_suggestions_are_written_once(spark, tmp_path, monkeypatch):
    """Prompts are not stored, nor texts of answers; a record that comes twice is the later one, and the cache has the last entry."""
    snippets = spark.createDataFrame([("s1", "one"), ("s2", "two")], "id string, content string")
    rows = [(1, "s1", "lint", "d", 0), (2, "s1", "lint", "d", 100), (3, "s1", "lint", "d", 90_000), (4, "s2", "lint", "d", 5)]
    asked = spark.createDataFrame(rows, "request_id int, snippet_id string, issue_type string, issue_description string, t long")
    asked = asked.withColumn("requested_at", F.timestamp_seconds("t")).drop("t")
    store, written, kept = Store(spark, str(tmp_path)), service.written, []
    monkeypatch.setattr(service, "written", lambda df, name: kept.append((name, df.columns)) or written(df, name))
    answers = service.suggest_stored(store, asked, snippets)
    assert sorted((r.request_id, r.suggested_fix, r.cached) for r in answers.collect()) == [(1, "one", False), (2, "one", True), (3, "one", False), (4, "two", False)]
    records = store.read("suggestion_requests").select("snippet_id", F.unix_seconds("created_at")).collect()
    assert sorted(tuple(r) for r in records) == [("s1", 90_000), ("s2", 5)]
    assert sorted(r[0] for r in store.read("cache").select(F.unix_seconds("written_at")).collect()) == [5, 90_000]
    assert not any("prompt" in c for _, c in kept) and not {"answers", "records"} & {n for n, _ in kept}

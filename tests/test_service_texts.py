"""Texts of a suggestion service are sent and stored once, and not for each request."""

import os
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from snipquarry.operators import cache as entries_cache, service
from snipquarry.sources.store import Store

ASKED = "request_id int, snippet_id string, issue_type string, issue_description string, t long"


def requests(spark, rows):
    return spark.createDataFrame(rows, ASKED).withColumn("requested_at", F.timestamp_seconds("t")).drop("t")


def files(path):
    return [f"{d}/{n}" for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")]


def test_a_text_is_stored_once(spark, tmp_path, monkeypatch):
    rng, size = random.Random(3), 60_000
    texts = {f"s{i}": f"{rng.getrandbits(4 * size):x}" for i in range(120)}
    # Misses of a key are two days apart, so each has a record.
    rows = [(100 * i + k, f"s{i}", "lint", f"d{k}", 172_800 * k + i) for i in range(120) for k in range(6)]
    scratch = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    held = lambda path: sum(map(os.path.getsize, files(path)))
    before, most, removed = held(scratch), [], service.remove_scratch
    monkeypatch.setattr(service, "remove_scratch", lambda *a: most.append(held(scratch) - before) or removed(*a))
    store = Store(spark, f"{tmp_path}/store")
    answers = service.suggest_stored(store, requests(spark, rows), spark.createDataFrame(list(texts.items()), "id string, content string"))
    assert {(r.request_id, r.suggested_fix, r.cached) for r in answers.collect()} == {(r[0], texts[r[1]], False) for r in rows}
    records = store.read("suggestion_requests").select("issue_description", "snippet_id", "suggested_fix").collect()
    assert sorted(records) == sorted((r[3], r[1], texts[r[1]]) for r in rows)
    # Six records have each text of 60 KB; a file holds it once.
    for table in ("suggestion_requests", "cache"):
        assert held(f"{store.path}/{table}") < 1.2 * 120 * size
    assert most[0] < 3 * 120 * size and held(scratch) - before < 1.2 * 120 * size
    for path in files(f"{store.path}/suggestion_requests"):
        table = pq.read_table(path)
        if "suggested_fix" in table.column_names:
            assert table["id"].to_pylist() == sorted(table["id"].to_pylist())


def test_odd_texts(spark, tmp_path, monkeypatch):
    """Missing, empty and equal texts, repeated requests, a key with two last entries, and answers from the store."""
    # More partitions than cores, and texts with more rows than one count as hot.
    monkeypatch.setattr(service, "PIECE_BYTES", 40)
    monkeypatch.setattr(service, "hot_keys", lambda rows, on: rows.groupBy(*on).agg(F.count("*").cast("int").alias("_parts")).filter("_parts > 1"))
    snippets = spark.createDataFrame([("a", "same"), ("b", "same"), ("c", None), ("d", ""), ("e", "own"), ("unasked", "x")], "id string, content string")
    first = [
        (1, "a", "lint", "x", 0), (2, "b", "style", "y", 0), (3, "c", "lint", "x", 5), (4, "d", "lint", "x", 5), (5, "a", "lint", "other", 50),
        (6, "e", "lint", "one", 7), (6, "e", "lint", "two", 7), (7, "gone", "lint", "x", 0), (8, "a", "typo", "x", 0), (9, None, "lint", "x", 0),
        (10, "a", "lint", "x", 90_000),
    ]
    second = [(11, "b", "style", "z", 100), (12, "c", "lint", "z", 100), (13, "a", "lint", "z", 90_001), (14, "e", "lint", "z", 100), (15, "a", "style", "z", 100)]
    # The whole prompt, so that texts differ by description, but for those of one snippet.
    provider = lambda prompt: F.when(prompt.contains("\nsame\n"), "same").otherwise(prompt)
    nothing = spark.createDataFrame([], "key string, value string, written_at timestamp, expires_at timestamp")
    answers, records, entries = service.suggest(requests(spark, first), snippets, nothing, provider)
    store = Store(spark, str(tmp_path))
    stored = service.suggest_stored(store, requests(spark, first), snippets, provider=provider)
    rows = lambda df: sorted(df.collect(), key=repr)
    assert rows(stored) == rows(answers)
    plain = {(r.request_id, r.suggested_fix, r.cached) for r in answers.collect()}
    assert {(1, "same", False), (2, "same", False), (3, None, False), (5, "same", True), (10, "same", False)} <= plain
    assert {r[0] for r in plain} == {1, 2, 3, 4, 5, 6, 10} and len({r[1] for r in plain if r[0] == 6}) == 2
    last = records.groupBy("id").agg(F.max("created_at").alias("created_at"))
    same = ["id", "snippet_id", "issue_type", "issue_description", "suggested_fix", "model_confidence", "created_at"]
    assert {*store.read("suggestion_requests").select(same).collect()} == {*records.join(last, ["id", "created_at"]).select(same).collect()}
    assert rows(store.read("cache")) == rows(entries_cache.current(entries))
    held = {r.key: r.value for r in store.read("cache").collect()}
    again = {(r.request_id, r.cached): r.suggested_fix for r in service.suggest_stored(store, requests(spark, second), snippets, provider=provider).collect()}
    assert set(again) == {(11, True), (12, True), (13, True), (14, True), (15, False)}
    assert again[11, True] == again[13, True] == again[15, False] == "same" and again[12, True] is None
    assert f'"{again[14, True]}"'.replace("\n", "\\n") in held["suggestion:e:lint"]

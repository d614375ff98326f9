"""Cache table, key patterns and replay."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from snipquarry.functions import keys
from snipquarry.operators import cache


def _cache(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, written_at string, ttl int").select(
        "key", "value", F.col("written_at").cast("timestamp").alias("written_at"),
        (F.unix_micros(F.col("written_at").cast("timestamp")) + F.col("ttl") * 1_000_000).alias("_e"),
    ).select("key", "value", "written_at", F.timestamp_micros("_e").alias("expires_at"))


def test_lifecycle(spark):
    log = spark.createDataFrame(
        [("test:key", 1, "2024-01-01 00:00:00"), ("prefix:one", 1, "2024-01-01 00:00:00"),
         ("prefix:two", 2, "2024-01-01 00:00:00"), ("test:key", 7, "2024-01-01 00:00:01")],
        "key string, a int, written_at string",
    )
    current = cache.current(cache.entries(log, ["a"]))
    got = {r.key: r.value for r in current.collect()}
    assert got == {"test:key": '{"a":7}', "prefix:one": '{"a":1}', "prefix:two": '{"a":2}'}
    gone = spark.createDataFrame([("test:key",), ("unknown",)], "key string")
    assert {r.key for r in cache.delete(current, gone).collect()} == {"prefix:one", "prefix:two"}
    assert {r.key for r in cache.clear_pattern(current, "prefix:*").collect()} == {"test:key"}


@pytest.mark.parametrize("ttl,seconds", [(None, 3600), (0, 3600), (5, 5)])
def test_default_ttl(spark, ttl, seconds):
    log = spark.createDataFrame([("k", 1, "2024-01-01 00:00:00")], "key string, a int, written_at string")
    row = cache.entries(log, ["a"], ttl=ttl).first()
    assert (row.expires_at - row.written_at).total_seconds() == seconds


def test_lookup_at_the_edges(spark):
    stored = _cache(spark, [("k", "v", "2024-01-01 00:00:00", 10)])
    asked = spark.createDataFrame(
        [("k", "2023-12-31 23:59:59"), ("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 00:00:09.999999"),
         ("k", "2024-01-01 00:00:10"), ("other", "2024-01-01 00:00:05"), (None, "2024-01-01 00:00:05")],
        "key string, t string",
    ).select("key", F.col("t").cast("timestamp").alias("request_ts"), "t")
    got = {(r.key, r.t): r.value for r in cache.lookup(asked, stored, spread=["t"]).collect()}
    assert len(got) == 6
    assert {k for k, v in got.items() if v} == {("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 00:00:09.999999")}


def test_json_keeps_times_and_nulls(spark):
    row = spark.createDataFrame([(None, datetime(2024, 1, 2, 3, 4, 5, 60))], "a int, t timestamp")
    value = row.select(cache.to_value(["a", "t"]).alias("v"))
    assert value.first().v == '{"a":null,"t":"2024-01-02 03:04:05.000060"}'
    back = value.select(cache.from_value(F.col("v"), "a int, t timestamp").alias("x")).first().x
    assert (back.a, back.t) == (None, datetime(2024, 1, 2, 3, 4, 5, 60))


PATTERNS = {
    "*": ["", "a", "a:b\nc"],
    "retrieve:*": ["retrieve:", "retrieve:all:x"],
    "h?llo": ["hello", "hallo", "hillo"],
    "h[ae]llo": ["hello", "hallo"],
    "h[^e]llo": ["hallo", "hillo"],
    "h[!e]llo": ["hallo", "hillo"],
    "h[a-b]llo": ["hallo"],
    "a.b": ["a.b"],
    "x\\*y": ["x*y"],
    "(a)+$": ["(a)+$"],
    "[a": ["[a"],
}


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns(spark, pattern):
    every = sorted({k for found in PATTERNS.values() for k in found} | {"hillo", "axb", "xxy", "aa", "Retrieve:"})
    df = spark.createDataFrame([(k,) for k in every], "key string")
    got = {r.key for r in df.filter(keys.matches(F.col("key"), pattern)).collect()}
    assert got == (set(every) if pattern == "*" else set(PATTERNS[pattern]))


def test_keys(spark):
    df = spark.createDataFrame([("q", None, 5), ("q", "", 5), ("q", "r", 50)], "query string, repo string, k int")
    short = df.select(keys.search_key(F.col("query"), F.col("repo")).alias("x"))
    assert [r.x for r in short.collect()] == ["retrieve:all:q", "retrieve:all:q", "retrieve:r:q"]
    long = df.select(keys.search_key(F.col("query"), F.col("repo"), F.col("k")).alias("x"))
    assert [r.x for r in long.collect()] == ["retrieve:all:q:5", "retrieve:all:q:5", "retrieve:r:q:50"]


def _replayed(rows, ttl):
    hits, anchor = {}, {}
    for key, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        hits[i] = key in anchor and t < anchor[key] + ttl
        if not hits[i]:
            anchor[key] = t
    return hits


@pytest.fixture(scope="module")
def log():
    rng, rows = random.Random(3), []
    for _ in range(4000):
        rows.append(("hot", rng.randrange(200_000_000), len(rows)))
    for _ in range(1500):
        rows.append(("bursts", rng.choice([0, 7, 8, 900]) * 1_000_000 + rng.randrange(500), len(rows)))
    for i in range(3000):
        rows.append((f"k{i % 400}", rng.randrange(100_000_000), len(rows)))
    return rows


@pytest.mark.parametrize("large_key", [10**6, 1000])
@pytest.mark.parametrize("ttl", [1, 30])
def test_replay(spark, log, ttl, large_key):
    df = spark.createDataFrame(log, "key string, t long, id long").withColumn("ts", F.timestamp_micros("t"))
    got = {r.id: r.hit for r in cache.ttl_replay(df, ttl=ttl, large_key=large_key).collect()}
    assert got == _replayed(log, ttl * 1_000_000)


def test_replay_of_large_keys_with_short_windows(spark, log):
    """Rounds that end early, for lack of kept rows or of windows, go on where they stopped."""
    rows = [r for r in log if r[0] in ("hot", "bursts")]
    df = spark.createDataFrame(rows, "key string, t long, id long")
    got = {r.id: r.hit for r in cache._replay_large(df, 5_000_000, windows=20, rows_kept=3).collect()}
    assert got == _replayed(rows, 5_000_000)

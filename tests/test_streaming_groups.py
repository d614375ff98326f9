"""The cache stream calls Python for groups of keys."""

import pandas as pd
from pyspark.sql import functions as F

from snipquarry.operators import cache
from snipquarry.streaming import ttl


class _Held(dict):
    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value


class _Handle:
    def getMapState(self, name, key, value):
        self.held = _Held()
        return self.held


def test_one_call_replays_many_keys():
    processor, handle = ttl._LastMiss(10), _Handle()
    processor.init(handle)

    def replay(*rows):
        part = pd.DataFrame(rows, columns=["key", "t", "id", "no_id"])
        out = pd.concat(processor.handleInputRows((0,), iter([part.iloc[:2], part.iloc[2:]]), None))
        return {(None if pd.isna(i) else int(i)): bool(h) for i, h in zip(out["id"], out["hit"])}

    big = (1 << 62) + 1
    first = replay(("a", 5, 1, False), ("b", 0, 2, False), ("a", 0, 3, False), (None, 3, big, False), ("b", 12, 0, True))
    assert first == {1: True, 2: False, 3: False, big: False, None: False}
    assert handle.held == {("a",): (0,), ("b",): (12,), (None,): (3,)}
    assert replay(("a", 9, 4, False), ("a", 10, 5, False), ("b", 21, 6, False), (None, 13, 7, False)) == {4: True, 5: False, 6: True, 7: False}


def test_keys_that_share_a_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ttl, "GROUPS", 3)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ttl.STATE_STORE)
    n = F.col("id")
    log = spark.range(600).select(
        (n + F.lit(1 << 60)).alias("id"),
        F.when(n % 11 > 0, F.concat(F.lit("k"), (n * n % 41).cast("string"))).alias("key"), F.timestamp_micros(n * 1_300_000).alias("ts"),
    )
    log = log.withColumn("id", F.when(F.col("id") % 97 > 0, F.col("id")))
    for i in range(3):
        log.filter(F.floor(F.unix_micros("ts") / 260_000_000) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = ttl.ttl_stream(source, ttl=60).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
    run.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = sorted((str(r.id), r.hit) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((str(r.id), r.hit) for r in cache.ttl_replay(log, ttl=60).collect())
    assert got == want and len(got) == 600 and 0 < sum(h for _, h in got) < 600

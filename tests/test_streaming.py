"""Streams against the batch forms."""

from pyspark.sql import functions as F

from snipquarry.operators import cache, indexing
from snipquarry.sources.store import Store
from snipquarry.sources.streams import read_stream
from snipquarry.streaming import audit, indexing as stream_indexing, ttl


def test_replay_over_several_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ttl.STATE_STORE)
    log = spark.range(600).select(
        F.col("id"), F.concat(F.lit("k"), (F.col("id") * F.col("id") % 7).cast("string")).alias("key"),
        F.timestamp_micros(F.col("id") * 1_300_000).alias("ts"),
    )
    for i in range(3):
        log.filter(F.floor(F.col("id") / 200) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = ttl.ttl_stream(source, ttl=10).writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "state")
    ).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    got = {r.id: r.hit for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.id: r.hit for r in cache.ttl_replay(log, ttl=10).collect()}
    assert got == want and 0 < sum(got.values()) < 600


def test_index_adds_only_new_files(spark, tmp_path):
    files = spark.range(40).select(
        F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("repo_id"),
        F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".go")).alias("file_path"),
        F.repeat(F.lit("line\n"), F.col("id").cast("int")).alias("content"),
    )
    source, table, state, results = (str(tmp_path / x) for x in ("in", "table", "state", "results"))

    def run():
        stream = read_stream(spark, source, files.schema)
        stream_indexing.index_stream(stream, table, state, results, size=8, overlap=2).awaitTermination()
        return sorted((r.id, r.content) for r in spark.read.parquet(table).collect())

    def batch(rows):
        return sorted((r.id, r.content) for r in indexing.snippets(indexing.index_chunks(rows, 8, 2)).collect())

    files.filter("repo_id <> 'r1'").write.parquet(source)
    assert run() == batch(files.filter("repo_id <> 'r1'"))
    assert run() == batch(files.filter("repo_id <> 'r1'"))
    files.filter("repo_id = 'r1'").write.mode("append").parquet(source)
    assert run() == batch(files)
    repos = spark.createDataFrame([("r0",), ("r1",), ("r2",)], "id string")
    jobs = indexing.index_jobs(spark.read.parquet(results), repos)
    assert sorted(r.total_files for r in jobs.collect()) == [13, 13, 14]
    assert sum(r.total_snippets for r in jobs.collect()) == len(run())


def test_audit_on_a_stream(spark, tmp_path):
    log = spark.range(100).select(
        F.timestamp_micros(F.col("id") * 3_600_000_000).alias("ts"), F.when(F.col("id") % 2 == 0, "index").otherwise("suggest").alias("action")
    )
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = audit.audit_daily(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("audit").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.table("audit").collect()}
    assert got == {tuple(r) for r in audit.audit_daily(log).collect()} and len(got) == 10


def test_late_entries_count(spark, tmp_path):
    def part(hours):
        return spark.createDataFrame([(h,) for h in hours], "h long").select(F.timestamp_seconds(F.col("h") * 3600).alias("ts"), F.lit("x").alias("action")).coalesce(1)

    part([0, 1, 300]).write.parquet(str(tmp_path / "in"))
    part([2, 301]).write.mode("append").parquet(str(tmp_path / "in"))
    log = spark.read.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    audit.audit_daily(source).writeStream.format("memory").queryName("late").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    last = spark.table("late").groupBy("day", "action").agg(F.max("n").alias("n"))
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in audit.audit_daily(log).collect()}


def test_late_entries_are_kept_apart(spark, tmp_path):
    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    schema = "ts timestamp, action string"

    def part(*hours):
        rows = spark.createDataFrame([(h, a) for h in hours for a in ("x", None)], "h int, action string")
        rows.select(F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "action").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        audit.audit_stream(stream, store, str(tmp_path / "state")).awaitTermination()
        log = spark.read.schema(schema).parquet(source)
        assert sorted(map(str, audit.audit_counts(store).collect())) == sorted(map(str, audit.audit_daily(log).collect()))
        return {t: store.read(t).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for t in (audit.CLOSED, audit.OPEN, audit.LATE)}

    assert part(1, 2, 30) == {audit.CLOSED: 0, audit.OPEN: 6, audit.LATE: 0}
    assert part(3, 80) == {audit.CLOSED: 8, audit.OPEN: 2, audit.LATE: 0}
    closed = sorted(map(str, store.read(audit.CLOSED).collect()))
    assert part(4, 31, 81) == {audit.CLOSED: 8, audit.OPEN: 4, audit.LATE: 4}
    assert sorted(map(str, store.read(audit.CLOSED).collect())) == closed
    assert part(500) == {audit.CLOSED: 12, audit.OPEN: 2, audit.LATE: 4}

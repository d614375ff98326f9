"""Streaming forms, run over all files there are and then read back."""

from pyspark.sql import functions as F

from snipquarry.operators.inference import hash_provider
from snipquarry.plans.scratch import scratch_dir
from snipquarry.sources.store import Store
from snipquarry.sources.streams import read_stream
from snipquarry.streaming import audit, indexing, ttl
from workload.cache import DAY, TTL_REPLAY, request_log
from workload.files import INDEX_SNIPPETS, SNIPPETS, STORED, _with_md5, stored_rows
from workload.registry import code_files, query, views


def _stream(spark, sf, name):
    batch = spark.read.parquet(f"{sf}/{name}.parquet")
    # A pattern: the source takes a folder or a pattern, not the path of one file.
    return read_stream(spark, f"{sf}/{name}.parque[t]", batch.schema)


def _run(stream, name, mode="append"):
    """Write a stream to a scratch table until its input is used up."""
    spark = stream.sparkSession
    out = scratch_dir(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch_dir(spark, f"{name}-state"))
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("ttl_cache_stream", TTL_REPLAY)
def ttl_cache_stream(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ttl.STATE_STORE)
    requests = request_log(_stream(spark, sf, "events"))
    marked = _run(ttl.ttl_stream(requests, ttl=DAY, id="event_id"), "ttl-stream")
    return marked.select(F.col("id").alias("event_id"), "hit")


@query("incremental_index", INDEX_SNIPPETS)
def incremental_index(spark, sf):
    table = scratch_dir(spark, "snippets")
    running = indexing.index_stream(
        code_files(_stream(spark, sf, "documents")), table, scratch_dir(spark, "snippets-state"), size=16, overlap=4
    )
    running.awaitTermination()
    return _with_md5(spark.read.parquet(table), "id", "repo_id", "file_path", "language", "embedding_id")


UPSERTED = """(SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN string_split(text, chr(10))[1]
  WHEN doc_id % 5 = 0 THEN text || ' changed' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)"""


@query("stream_upsert", f"WITH {SNIPPETS.replace('FROM documents', 'FROM ' + UPSERTED)},{STORED}")
def stream_upsert(spark, sf):
    """Files arrive in two batches: all of them, and then some shortened, changed, gone, as they were, or in an older version."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", indexing.STATE_STORE)
    files, folder = views(spark, sf).code_files, scratch_dir(spark, "arriving")
    n, text, none = F.col("doc_id"), F.col("content"), F.lit(None).cast("string")
    again = F.when(n % 7 == 0, none).when(n % 3 == 0, F.split(text, "\n", 2)[0]).when(n % 5 == 0, F.concat(text, F.lit(" changed"))).otherwise(text)
    second = files.filter("doc_id % 7 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 11 = 0").withColumn("content", again)
    old = files.filter("doc_id % 13 = 0").withColumns({"content": F.lit("an older text"), "version": F.lit(0)})
    arriving = ["repo_id", "file_path", "version", "content"]
    files.withColumn("version", F.lit(1)).select(*arriving).coalesce(1).write.parquet(folder)
    second.withColumn("version", F.lit(2)).unionByName(old).select(*arriving).coalesce(1).write.mode("append").parquet(folder)
    stream = read_stream(spark, folder, spark.read.parquet(folder).schema, 1)
    store = Store(spark, scratch_dir(spark, "store"))
    indexing.upsert_stream(
        stream, store, scratch_dir(spark, "store-state"), provider=hash_provider(dim=64), dim=64, size=16, overlap=4
    ).awaitTermination()
    return stored_rows(store)


@query("index_progress", "SELECT source AS repo_id, count(*) AS files_seen FROM documents GROUP BY source")
def index_progress(spark, sf):
    seen = indexing.progress(code_files(_stream(spark, sf, "documents")))
    return _run(seen, "progress", mode="complete")


@query("audit_daily_stream", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def audit_daily_stream(spark, sf):
    counted = audit.audit_daily(_stream(spark, sf, "events"), action="event_type")
    rows = _run(counted, "audit", mode="complete")
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("audit_late_entries", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def audit_late_entries(spark, sf):
    """The log comes in three batches, the second of them long before the first: closed days, open ones and late entries add up."""
    events, folder = views(spark, sf).events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), scratch_dir(spark, "log")
    day = F.dayofmonth("ts")
    for part in ((day >= 10) & (day < 20), day < 10, day >= 20):
        events.filter(part).coalesce(1).write.mode("append").parquet(folder)
    store = Store(spark, scratch_dir(spark, "store"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    audit.audit_stream(stream, store, scratch_dir(spark, "audit-state"), action="event_type").awaitTermination()
    return audit.audit_counts(store, "event_type").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")

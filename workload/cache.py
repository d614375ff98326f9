"""Queries over the result cache and service logs."""

from pyspark.sql import functions as F

from snipquarry.functions import keys
from snipquarry.operators import cache, evaluation
from snipquarry.plans.scratch import scratch_dir, written
from snipquarry.sources.store import Store
from snipquarry.streaming.audit import audit_daily
from workload.registry import CACHE_LOG, query, views

HOUR, DAY = 3600, 86400


@query("cache_keys", """
SELECT doc_id, md5('retrieve:' || CASE WHEN doc_id % 3 = 0 THEN 'all' WHEN doc_id % 3 = 1 THEN 'all' ELSE source END
                   || ':' || text) AS search_md5,
       'suggestion:' || doc_id || ':' || lang AS suggestion_key
FROM documents""")
def cache_keys(spark, sf):
    repo = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, "").otherwise(F.col("source"))
    return views(spark, sf).documents.select(
        "doc_id",
        F.md5(keys.search_key(F.col("text"), repo)).alias("search_md5"),
        keys.suggestion_key(F.col("doc_id"), F.col("lang")).alias("suggestion_key"),
    )


def _current(v, ttl=None):
    log = cache.entries(v.cache_log, ["event_id", "value", "written_at"], ttl=ttl)
    return cache.current(log)


def _current_sql(ttl):
    return f"""{CACHE_LOG}, entries AS (
  SELECT key, written_us, written_us + {ttl} * 1000000::BIGINT AS expires_us,
         '{{"event_id":' || event_id || ',"value":' || value || ',"written_at":"'
           || strftime(written_at, '%Y-%m-%d %H:%M:%S.%f') || '"}}' AS value
  FROM cache_log),
cache AS (
  SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY key ORDER BY written_us DESC, value DESC) = 1)"""


@query("cache_current", f"""
WITH {_current_sql(HOUR)}
SELECT key, value, written_us, expires_us FROM cache""")
def cache_current(spark, sf):
    return _current(views(spark, sf), ttl=0).select(
        "key", "value", F.unix_micros("written_at").alias("written_us"),
        F.unix_micros("expires_at").alias("expires_us"),
    )


@query("cache_lookup", f"""
WITH {_current_sql(20 * DAY)}, r AS (
  SELECT event_id, key, written_us + 864000000000 AS request_us FROM cache_log)
SELECT r.event_id, r.key, (c.value::JSON ->> 'event_id')::BIGINT AS cached_event
FROM r LEFT JOIN cache c ON c.key = r.key AND c.written_us <= request_us AND request_us < c.expires_us""")
def cache_lookup(spark, sf):
    v = views(spark, sf)
    asked = v.cache_log.select(
        "event_id", "key", (F.col("written_at") + F.expr("INTERVAL 10 DAYS")).alias("request_ts")
    )
    found = cache.lookup(asked, _current(v, 20 * DAY), spread=["event_id"])
    value = cache.from_value(F.col("value"), "event_id long, value double, written_at timestamp")
    return found.select("event_id", "key", value["event_id"].alias("cached_event"))


def _stored(v, ttl=None):
    """A store of the cache, written in four parts that are not in the order of their times, and merged."""
    store = Store(v.spark, scratch_dir(v.spark, "cache"))
    log = cache.entries(v.cache_log, ["event_id", "value", "written_at"], ttl=ttl)
    for part in (2, 0, 3, 1):
        cache.write_stored(store, log.filter(F.floor(F.unix_timestamp("written_at") / (5 * DAY)) % 4 == part))
    store.compact("cache", fanout=3)
    return store


@query("cache_current_stored", f"""
WITH {_current_sql(HOUR)}
SELECT key, value, written_us, expires_us FROM cache""")
def cache_current_stored(spark, sf):
    """The cache as a table of a store: no reader goes through the log."""
    return _stored(views(spark, sf), ttl=0).read("cache").select(
        "key", "value", F.unix_micros("written_at").alias("written_us"), F.unix_micros("expires_at").alias("expires_us"),
    )


@query("cache_clear_stored", f"""
WITH {_current_sql(HOUR)}
SELECT key, written_us FROM cache
WHERE key NOT IN (SELECT user_id || ':' || event_type FROM events WHERE event_type = 'error')
  AND NOT regexp_full_match(key, '1.*:[vc][^x].*.')""")
def cache_clear_stored(spark, sf):
    """Listed keys are deleted, and then those of a pattern."""
    v, store = views(spark, sf), _stored(views(spark, sf))
    removed = v.events.filter("event_type = 'error'").select(F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type")).alias("key"))
    cache.delete_stored(store, removed)
    cache.clear_stored(store, "1*:[vc][!x]*?")
    return store.read("cache").select("key", F.unix_micros("written_at").alias("written_us"))


@query("cache_delete", f"""
WITH {_current_sql(HOUR)}
SELECT key, written_us FROM cache WHERE key NOT IN (
  SELECT user_id || ':' || event_type FROM events WHERE event_type = 'error')""")
def cache_delete(spark, sf):
    v = views(spark, sf)
    removed = v.events.filter("event_type = 'error'").select(
        F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type")).alias("key")
    )
    return cache.delete(_current(v), removed).select("key", F.unix_micros("written_at").alias("written_us"))


@query("cache_clear_pattern", f"""
WITH {_current_sql(HOUR)}
SELECT key, written_us FROM cache WHERE NOT regexp_full_match(key, '1.*:[vc][^x].*.')""")
def cache_clear_pattern(spark, sf):
    kept = cache.clear_pattern(_current(views(spark, sf)), "1*:[vc][!x]*?")
    return kept.select("key", F.unix_micros("written_at").alias("written_us"))


TTL_REPLAY = """
WITH RECURSIVE e AS (
  SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn
  FROM events),
r AS (
  SELECT user_id, event_type, rn, event_id, t AS a, FALSE AS hit FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_type, e.rn, e.event_id,
         CASE WHEN e.t < r.a + 86400000000 THEN r.a ELSE e.t END, e.t < r.a + 86400000000
  FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.rn = r.rn + 1)
SELECT event_id, hit FROM r"""


def request_log(events):
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type")).alias("key"),
    )


@query("ttl_cache_replay", TTL_REPLAY)
def ttl_cache_replay(spark, sf):
    replayed = cache.ttl_replay(request_log(views(spark, sf).events), ttl=DAY, id="event_id")
    return replayed.select(F.col("id").alias("event_id"), "hit")


@query("ttl_cache_replay_large_keys", """
WITH RECURSIVE e AS (
  SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
r AS (
  SELECT event_type, rn, event_id, t AS a, FALSE AS hit FROM e WHERE rn = 1
  UNION ALL
  SELECT e.event_type, e.rn, e.event_id,
         CASE WHEN e.t < r.a + 86400000000 THEN r.a ELSE e.t END, e.t < r.a + 86400000000
  FROM r JOIN e ON e.event_type = r.event_type AND e.rn = r.rn + 1)
SELECT event_id, hit FROM r""")
def ttl_cache_replay_large_keys(spark, sf):
    """Few keys with many requests each, replayed in steps of the time to live."""
    log = request_log(views(spark, sf).events).withColumn("key", F.substring_index("key", ":", -1))
    replayed = cache.ttl_replay(log, ttl=DAY, id="event_id", large_key=100)
    return replayed.select(F.col("id").alias("event_id"), "hit")


@query("latency_histogram", """
SELECT event_type, bucket::BIGINT AS bucket, count(*) AS n FROM (
  SELECT event_type, CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 21 ELSE floor(value / 5) + 1 END AS bucket
  FROM events WHERE value IS NOT NULL)
GROUP BY ALL""")
def latency_histogram(spark, sf):
    buckets = evaluation.histogram(views(spark, sf).events, "value", 0, 100, 20, by=["event_type"])
    return buckets.select("event_type", F.col("bucket").cast("long"), "n")


@query("batch_size_histogram", """
SELECT bucket::BIGINT AS bucket, count(*) AS n FROM (
  SELECT CASE WHEN n < 1 THEN 0 WHEN n >= 33 THEN 9 ELSE (n - 1) // 4 + 1 END AS bucket
  FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id))
GROUP BY bucket""")
def batch_size_histogram(spark, sf):
    from snipquarry.operators.inference import batch_totals

    totals = batch_totals(views(spark, sf).conversations, group=["conv_id"])
    buckets = evaluation.histogram(totals, "batch_size", 1, 33, 8)
    return buckets.select(F.col("bucket").cast("long"), "n")


@query("quantile_sketches", """
SELECT event_type, rank::DOUBLE AS rank, count(*) AS n, true AS near
FROM events, (SELECT unnest([0.01, 0.25, 0.5, 0.9, 0.99]) AS rank) WHERE value IS NOT NULL GROUP BY ALL""")
def quantile_sketches(spark, sf):
    """Quantiles from a stored sketch for each day and type; each is at its rank, give or take 3 %, among all values."""
    events = views(spark, sf).events.withColumn("day", F.to_date("ts"))
    sketches = written(evaluation.quantile_sketches(events, "value", ["event_type", "day"]), "sketches")
    found = evaluation.merged_quantiles(sketches, [0.01, 0.25, 0.5, 0.9, 0.99], ["event_type"])
    value, at = F.col("events.value"), F.col("found.value")
    joined = events.filter("value IS NOT NULL").alias("events").join(F.broadcast(found.alias("found")), "event_type")
    ranks = joined.groupBy("event_type", "rank", F.col("found.n").alias("n")).agg(
        F.avg((value < at).cast("int")).alias("below"), F.avg((value <= at).cast("int")).alias("to"))
    return ranks.select("event_type", "rank", "n", ((F.col("below") - 0.03 <= F.col("rank")) & (F.col("to") + 0.03 >= F.col("rank"))).alias("near"))


@query("audit_daily", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def audit_per_day(spark, sf):
    counted = audit_daily(views(spark, sf).events, action="event_type")
    return counted.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")

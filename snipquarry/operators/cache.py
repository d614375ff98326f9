"""Result cache as a table of (key, value, written_at, expires_at)."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from snipquarry import settings
from snipquarry.functions import keys
from snipquarry.plans.scratch import scratch_dir, written
from snipquarry.plans.skew import first_per_key, salted_join
from snipquarry.sources.store import Store

JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def to_value(columns: list[str]) -> Column:
    """Columns as a JSON object; times become text."""
    return F.to_json(F.struct(*columns), JSON_OPTIONS)


def from_value(value: Column, schema) -> Column:
    return F.from_json(value, schema, JSON_OPTIONS)


def entries(rows: DataFrame, columns: list[str], written_at="written_at", ttl=None) -> DataFrame:
    """Cache rows for (key, columns).  `ttl` in seconds; None and 0 mean the default."""
    seconds = ttl or settings.SEARCH_TTL_SECONDS
    at = F.col(written_at).cast("timestamp")
    return rows.select(
        "key",
        to_value(columns).alias("value"),
        at.alias("written_at"),
        (at + F.make_dt_interval(secs=F.lit(seconds))).alias("expires_at"),
    )


def current(log: DataFrame) -> DataFrame:
    """The last write of every key."""
    return first_per_key(log, ["key"], ["written_at", "value"], last=True)


def lookup(requests: DataFrame, cache: DataFrame, spread: list[str], ts="request_ts") -> DataFrame:
    """Requests (key, `ts`) with the live `value` of their key, NULL if there is none.

    `spread` names the columns that tell the requests of one key apart, such as their id.
    `cache` has one row per key.  An entry is live from its writing until just before it expires.
    """
    live = (F.col("written_at") <= F.col(ts)) & (F.col(ts) < F.col("expires_at"))
    return salted_join(requests, cache, ["key"], spread, "left", condition=live)


# --- as a table of a store: one row a key, so that no reader goes through the log of all writes


def write_stored(store: Store, rows: DataFrame, table="cache") -> None:
    """Write entries; of each key the last write stays, whether it is among them or stored before.

    Files are sorted by key and carry Bloom filters of it.  `Store.compact` merges the folders of many
    writes by size; what they replaced goes then.
    """
    with store.change() as change:
        if table in change.tables:
            before = store.read(table, change.version - 1).join(rows.select("key").distinct(), "key", "left_semi")
            rows = rows.unionByName(before.select(*rows.columns))
        rows = written(current(rows), "entries")
        change.replace(table, rows, rows.select("key"), order=["key"], find_by=["key"])


def delete_stored(store: Store, removed: DataFrame, table="cache") -> None:
    """Remove the listed keys (key); only they are written."""
    with store.change() as change:
        change.remove(table, removed.select("key"))


def matching(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows whose key matches a pattern; of sorted files only those are read that hold its literal beginning."""
    literal = re.match(r"(?:[^*?\[\\]|\\.)*", pattern, re.S).group()
    literal = re.sub(r"\\(.)", r"\1", literal, flags=re.S)
    if literal:
        rows = rows.filter(F.col("key").startswith(literal))
    return rows.filter(keys.matches(F.col("key"), pattern))


def clear_stored(store: Store, pattern: str, table="cache") -> None:
    """Remove the entries whose key matches a pattern; only their keys are written."""
    if table in store.tables():
        delete_stored(store, written(matching(store.read(table), pattern).select("key"), "cleared"), table)


def delete(cache: DataFrame, removed: DataFrame) -> DataFrame:
    """Entries whose key is not listed in `removed` (key)."""
    return cache.join(removed.select("key").distinct(), "key", "left_anti")


def clear_pattern(cache: DataFrame, pattern: str) -> DataFrame:
    """Entries whose key does not match a pattern with `*`, `?` and `[...]`."""
    return cache.filter(~keys.matches(F.col("key"), pattern))


# --- replay of a request log -----------------------------------------------------------

LARGE_KEY = 1_000_000
LARGE_SHARE = 1e-4


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def misses_of(times: np.ndarray, ttl: int, anchor=None) -> tuple[np.ndarray, int]:
    """Positions of the misses in sorted times, and the time of the last one.

    The first request is a miss; the next miss is the first request `ttl` or more later.
    """
    found = []
    at = 0 if anchor is None else int(np.searchsorted(times, anchor + ttl))
    while at < len(times):
        found.append(at)
        anchor = int(times[at])
        at = int(np.searchsorted(times, anchor + ttl))
    return np.array(found, int), anchor


def _replay_sorted(ttl):
    """Mark hits in batches sorted by key and time, carrying the last miss across batches."""

    def run(batches):
        key, anchor = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            codes = batch.column("key").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            times = batch.column("t").to_numpy()
            hit = np.ones(len(times), bool)
            starts = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
            for start, end in zip(starts, [*starts[1:], len(times)]):
                this = batch.column("key")[int(start)].as_py()
                if this != key:
                    key, anchor = this, None
                missed, anchor = misses_of(times[start:end], ttl, anchor)
                hit[start + missed] = False
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(hit)], names=["id", "hit"]
            )

    return run


def ttl_replay(
    requests: DataFrame, ttl=settings.SEARCH_TTL_SECONDS, key="key", ts="ts", id="id",
    large_key=LARGE_KEY, large_share=LARGE_SHARE,
) -> DataFrame:
    """Which requests (id) of a log would have been answered by a cache with `ttl` seconds.

    Only misses write, so a request is a hit if it is younger than `ttl` since its key's last
    miss.  Requests of the same time are taken in the order of their ids.

    Most keys are read once in sorted order, without collecting a key.  Keys with more than
    `large_key` requests and more than `large_share` of all are replayed by `_replay_large`,
    which spreads each of them over all tasks.
    """
    step = int(ttl or settings.SEARCH_TTL_SECONDS) * 1_000_000
    log = requests.select(F.col(key).alias("key"), _micros(ts).alias("t"), F.col(id).alias("id"))
    result = T.StructType([log.schema["id"], T.StructField("hit", T.BooleanType())])
    n = F.count(F.lit(1))
    least = F.greatest(F.lit(large_key), log.agg(n).scalar() * large_share)
    counts = log.groupBy("key").agg(n.alias("n")).filter(F.col("n") > least)
    # Never more than 1 / large_share keys.
    large = [r.key for r in counts.filter("key IS NOT NULL").select("key").toLocalIterator()]
    is_large = F.coalesce(F.col("key").isin(large), F.lit(False))
    small = (log.filter(~is_large) if large else log).repartition("key").sortWithinPartitions("key", "t", "id")
    replayed = small.mapInArrow(_replay_sorted(step), result)
    return replayed.unionByName(_replay_large(log.filter(is_large), step)) if large else replayed


def _next_misses(step, rows_kept):
    """Misses of one key after a known miss, from the first rows of each window of length `step`.

    Windows are counted from the known miss, whose own offset is therefore 0.  The next miss is
    in the following window at the same offset or later, or else it is the first request after
    that window.  Stops at a window whose kept rows do not reach the offset.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("w", "ascending"), ("o", "ascending"), ("id", "ascending")])
        window, offset = group.column("w").to_numpy(), group.column("o").to_numpy()
        numbers, starts = np.unique(window, return_index=True)
        ends = [*starts[1:], len(window)]
        last, at, found = 0, 0, []
        for number, start, end in zip(numbers, starts, ends):
            wanted = at if number == last + 1 else 0
            i = start + int(np.searchsorted(offset[start:end], wanted))
            if i < end:
                last, at = number, offset[i]
                found.append(i)
            elif end - start == rows_kept:
                break
        return group.select(["key", "t", "id"]).take(pa.array(found, pa.int64()))

    return run


def _replay_large(log: DataFrame, step: int, windows=4096, rows_kept=256) -> DataFrame:
    """Replay few keys with very many requests each.

    A round finds each key's misses in the next `windows` times `step` after its last known
    miss, from the first `rows_kept` requests by offset of every window.  Each task cuts its
    rows to those before the shuffle, so no task sees more of a key than windows * rows_kept.
    """
    spark = log.sparkSession
    rows_path, misses_path = scratch_dir(spark, "ttl-rows"), scratch_dir(spark, "ttl-misses")
    # By time and not by key: a round then reads only its own part of the table.
    log.repartitionByRange("t").sortWithinPartitions("t").write.parquet(rows_path)
    rows = spark.read.schema(log.schema).parquet(rows_path)
    known = T.StructType([log.schema["key"], T.StructField("anchor", T.LongType())])

    def save(misses):
        """Append misses and return each key's last one."""
        path = f"{misses_path}/part={save.count}"
        save.count += 1
        misses.write.parquet(path)
        last = spark.read.schema(log.schema).parquet(path).groupBy("key").agg(F.max("t").alias("t"))
        return {r.key: r.t for r in last.collect()}

    save.count = 0
    first = F.min(F.struct("t", "id")).alias("m")
    anchors = save(rows.groupBy("key").agg(first).select("key", "m.t", "m.id"))
    while anchors:
        # One row per large key.
        state = F.broadcast(spark.createDataFrame(list(anchors.items()), known))
        later = rows.filter(F.col("t") >= min(anchors.values()) + step).join(state, "key")
        near = later.filter(F.col("t") < max(anchors.values()) + (windows + 1) * step)
        since = F.col("t") - F.col("anchor")
        placed = near.select("key", "t", "id", F.expr(f"(t - anchor) DIV {step}").alias("w"), (since % step).alias("o"))
        order = Window.partitionBy("key", "w").orderBy("o", "id")
        kept = placed.filter(F.col("w").between(1, windows)).withColumn("_n", F.row_number().over(order))
        kept = kept.filter(F.col("_n") <= rows_kept).drop("_n")
        found = save(kept.groupBy("key").applyInArrow(_next_misses(step, rows_kept), log.schema))
        rest = [k for k in anchors if k not in found]
        if rest:
            # Nothing in reach: their next miss is their next request, if there is one.
            beyond = later.filter(F.col("key").isin(rest) & (since >= step))
            found |= save(beyond.groupBy("key").agg(first).select("key", "m.t", "m.id"))
        anchors = found
    misses = spark.read.schema(log.schema).parquet(*[f"{misses_path}/part={i}" for i in range(save.count)])
    marked = misses.select("id", F.lit(False).alias("hit"))
    return rows.join(marked, "id", "left").select("id", F.coalesce("hit", F.lit(True)).alias("hit"))


def search_entries(responses: DataFrame, written_at: str, ttl=settings.SEARCH_TTL_SECONDS, include_k=False) -> DataFrame:
    """Cache rows for search responses (query, repo_id, k, results, count).

    By default the key does not contain `k`, so an answer for few results serves a later
    request for many; `include_k` tells them apart.
    """
    k = F.col("k") if include_k else None
    keyed = responses.withColumn("key", keys.search_key(F.col("query"), F.col("repo_id"), k))
    return entries(keyed, ["query", "results", "count"], written_at, ttl)

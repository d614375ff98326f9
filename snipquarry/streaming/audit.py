"""Counts of the audit log per day; the same on a table and on a stream."""

from pyspark.sql import DataFrame, functions as F

from snipquarry.plans.scratch import written
from snipquarry.sources.store import Store


def audit_daily(log: DataFrame, ts="ts", action="action", late=None) -> DataFrame:
    """Number of log entries per day and action; every entry counts, however late it comes.

    A stream keeps one count a day and action, for update or complete output.  Append output needs
    a bound `late`, after which a day is closed: later entries are then dropped.
    """
    timed = log.withColumn(ts, F.col(ts).cast("timestamp"))
    if log.isStreaming and late:
        timed = timed.withWatermark(ts, late)
    counted = timed.groupBy(F.window(ts, "1 day"), F.col(action)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("day"), F.col(action), "n")


OPEN, CLOSED, LATE = "audit_open", "audit_closed", "audit_late"


def audit_stream(log: DataFrame, store: Store, checkpoint: str, ts="ts", action="action", open_days=1, name="audit", available_now=True):
    """Count a log into a store: days that are closed, days that are open, and what came late.

    A day is closed once an entry comes that is more than `open_days` days after it.  Closed counts are written
    once and never changed; entries of a closed day go to a table of their own, which readers add in
    (`audit_counts`), so every entry counts.  A micro-batch is one commit, and one that is
    repeated counts once.  Only counts are kept, no entry.  Returns the running query.
    """

    def write(batch, batch_id):
        counts = written(audit_daily(batch, ts, action).filter("day IS NOT NULL"), "audit_counts")
        with store.change(name, batch_id) as change:
            if change.repeated:
                return
            base = change.version - 1
            held = [t for t in (OPEN, CLOSED) if t in change.tables]
            closed = store.read(CLOSED, base).agg(F.max("day")).first()[0] if CLOSED in held else None
            # Days up to the last closed one are closed, also those that had no entry.
            late = counts.filter(F.col("day") <= F.lit(closed)) if closed is not None else counts.limit(0)
            rest = counts.filter(F.col("day") > F.lit(closed)) if closed is not None else counts
            if OPEN in held:
                rest = rest.unionByName(store.read(OPEN, base))
            rest = written(rest.groupBy("day", action).agg(F.sum("n").alias("n")), "audit_open")
            newest = rest.agg(F.max("day")).first()[0]
            done = F.col("day") < F.lit(newest) - F.make_dt_interval(days=F.lit(open_days)) if newest is not None else F.lit(False)
            change.append(LATE, late)
            change.append(CLOSED, rest.filter(done))
            if OPEN in held:
                change.remove(OPEN, store.read(OPEN, base).select("day").distinct())
            change.append(OPEN, rest.filter(~done))

    writer = log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def audit_counts(store: Store, action="action") -> DataFrame:
    """Number of log entries per day and action, of all that came."""
    parts = [store.read(t) for t in (OPEN, CLOSED, LATE)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("day", action).agg(F.sum("n").alias("n"))

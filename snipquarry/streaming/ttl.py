"""Cache hits of a running request stream."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from snipquarry import settings
from snipquarry.operators.cache import misses_of

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Groups of keys.  Fixed value: what a checkpoint holds is kept by group.
GROUPS = 1024


class _LastMiss(StatefulProcessor):
    """Keeps the event time of each key's last miss; a call has the rows of a group of keys."""

    def __init__(self, ttl):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.anchor = handle.getMapState("anchor", T.StructType().add("key", T.StringType()), T.StructType().add("t", T.LongType()))

    def handleInputRows(self, key, rows, timerValues):
        parts = [[part[c].to_numpy() for c in ("key", "t", "id", "no_id")] for part in rows]
        keys, times, ids, no_id = (np.concatenate(column) for column in zip(*parts))
        codes, names = pd.factorize(keys, use_na_sentinel=False)
        order = np.lexsort((ids, no_id, times, codes))
        codes, times, ids, no_id = codes[order], times[order], ids[order], no_id[order]
        hit = np.ones(len(ids), bool)
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(codes)]):
            name = names[codes[start]]
            name = (None if pd.isna(name) else name,)
            before = self.anchor.getValue(name)
            before = before and before[0]
            missed, last = misses_of(times[start:end], self.ttl, before)
            if last != before:
                self.anchor.updateValue(name, (last,))
            hit[start + missed] = False
        yield pd.DataFrame({"id": pd.arrays.IntegerArray(ids, no_id) if ids.dtype.kind == "i" else ids, "hit": hit})

    def close(self) -> None:
        pass


def ttl_stream(requests: DataFrame, ttl=settings.SEARCH_TTL_SECONDS, key="key", ts="ts", id="id") -> DataFrame:
    """`ttl_replay` on a stream.

    Equal to it when requests arrive in the order of their times.  The requests of a key in
    one micro-batch meet in one task: bound the micro-batches, as `read_stream` does.  Python is called once for
    each group of keys and micro-batch, not for each key, and reads and writes the state of the keys that came.
    Keys are told apart by their text.  Needs `STATE_STORE` as spark.sql.streaming.stateStore.providerClass.
    """
    log = requests.select(
        F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(id).alias("id")
    )
    result = T.StructType([log.schema["id"], T.StructField("hit", T.BooleanType())])
    whole = isinstance(log.schema["id"].dataType, T.IntegralType)
    # Missing whole numbers would make pandas turn the others of a group into floats.
    some = F.coalesce("id", F.lit(0).cast(log.schema["id"].dataType)) if whole else F.col("id")
    log = log.withColumns({"no_id": F.col("id").isNull(), "id": some, "group": F.pmod(F.xxhash64("key"), F.lit(GROUPS))})
    micros = int(ttl or settings.SEARCH_TTL_SECONDS) * 1_000_000
    return log.groupBy("group").transformWithStateInPandas(
        statefulProcessor=_LastMiss(micros), outputStructType=result, outputMode="Append",
        timeMode="None",
    )

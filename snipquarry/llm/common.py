"""What the operators of this folder share: batches of texts, words and their hashes."""

import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

U64 = np.uint64
WHITE = bytes(range(9, 14)) + b" "


def per_batch(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Apply a function from record batch to columns (a dict, or None for nothing) to each batch."""
    arrow = None

    def run(batches):
        forget()
        for batch in sliced(batches):
            made = function(batch)
            if made is not None:
                yield pa.RecordBatch.from_pydict(made, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def sliced(batches, rows=1000):
    """The batches in smaller ones, so that Python holds few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def utf8(column) -> list[bytes]:
    """Whole texts as UTF-8; no text is an empty one."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def strings(column) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def worker_state(name: str, make: Callable):
    """What a Python worker keeps from task to task of one stage, e.g. a loaded vocabulary.

    Workers outlive stages: at the first use in another stage, or by `forget`, what earlier ones kept is let go,
    so that a worker holds no more than its present stage needs.
    """
    states = forget()
    if name not in states:
        states[name] = make()
    return states[name]


def forget() -> dict:
    """Let go what a worker has kept from other stages, also in tasks that keep nothing; what this one has kept."""
    kept = sys.modules.setdefault("_snipquarry_worker_state", types.ModuleType("_snipquarry_worker_state"))
    task = TaskContext.get()
    stage = task.stageId() if task else None
    states = vars(kept).setdefault("states", {})
    if vars(kept).get("stage", stage) != stage:
        states.clear()
    kept.stage = stage
    return states


class WordHashes(dict):
    """64-bit hashes of words (bytes); forgets all once it holds `most`, to bound memory."""

    def __init__(self, most=400_000):
        self.most = most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive hashes."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.empty(0, U64)
    made = np.zeros(k, U64)
    for i in range(n):
        made = made * U64(0x9E3779B97F4A7C15) + hashes[i:i + k]
    return mixed(made)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def lists(parts: list[np.ndarray], kind=np.int64) -> pa.Array:
    """A list column from one array per row."""
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(kind)))

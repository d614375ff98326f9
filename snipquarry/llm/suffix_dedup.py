"""Removal of long repeated byte strings by bucket-pointer refinement over sampled suffixes."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from snipquarry.llm.common import U64, mixed, per_batch, signed, utf8, worker_state
from snipquarry.plans.keys import lookup, marked_likely
from snipquarry.plans.scratch import written

LENGTH = 400
# Length of the initial q-grams, and bytes that are hashed in one go.
Q = 64
CHUNK = 1 << 20
# Offsets that are refined together, from coarse to single ones.
BLOCKS = (64, 8, 1)

_BASE = 0x9E3779B97F4A7C15
_PLACE = U64(CHUNK - 1)


def _powers(base):
    steps = np.full(CHUNK + 1, base, U64)
    steps[0] = 1
    return np.cumprod(steps)


class _Rolling:
    """Hashes of all q-grams of a byte array."""

    def __init__(self):
        self.up = _powers(_BASE)
        self.down = _powers(pow(_BASE, -1, 1 << 64))
        self.byte = mixed(np.arange(1, 257, dtype=U64))

    def of(self, data: np.ndarray, q: int) -> np.ndarray:
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(self.byte[data] * self.up[:len(data)], out=sums[1:])
        n = len(data) - q + 1
        return mixed((sums[q:] - sums[:n]) * self.down[:n])


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each run of `width` keys."""
    n = len(keys) - width + 1
    rows = -(-len(keys) // width)
    grid = np.full(rows * width, np.iinfo(U64).max, U64)
    grid[:len(keys)] = keys
    grid = grid.reshape(rows, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def _segments(texts: list[bytes], length: int):
    """Groups of (row, start, bytes) of at most CHUNK bytes; each window lies in exactly one segment."""
    group, total = [], 0
    for row, text in enumerate(texts):
        for start in range(0, max(0, len(text) - length + 1), CHUNK - length + 1):
            part = text[start:start + CHUNK]
            if total + len(part) > CHUNK:
                yield group
                group, total = [], 0
            group.append((row, start, part))
            total += len(part)
    if group:
        yield group


def _digests(views) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, views), U64)


def sampled(texts: list[bytes], length: int, q: int, rolling: _Rolling):
    """Sampled suffixes: (row, at, l1, l2, bucket, whole) as arrays.

    Of all q-grams of a window of `length` bytes the one with the least hash (of equals the first)
    is the window's suffix, so equal windows choose equal suffixes at equal offsets.  A suffix at
    byte `at` is chosen by the windows that begin l1 to l2 bytes before it; `whole` is a digest
    of all bytes of these windows.
    """
    out = []
    for group in _segments(texts, length):
        whole = b"".join(part for _, _, part in group)
        data = np.frombuffer(whole, np.uint8)
        hashes = rolling.of(data, q)
        keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=U64)
        chosen = (_window_min(keys, length - q + 1) & _PLACE).astype(np.int64)
        valid, owner, shift, at = np.zeros(len(chosen), bool), [], [], 0
        for row, start, part in group:
            valid[at:at + len(part) - length + 1] = True
            owner.append((at, row, start - at))
            at += len(part)
        begins = np.flatnonzero(valid)
        suffix = chosen[begins]
        new = np.flatnonzero(np.concatenate([[True], suffix[1:] != suffix[:-1]]))
        first, last = begins[new], begins[np.concatenate([new[1:], [len(begins)]]) - 1]
        suffix = suffix[new]
        view = memoryview(whole)
        digest = _digests(view[a:b + length] for a, b in zip(first.tolist(), last.tolist()))
        bounds, rows, moves = (np.array(c) for c in zip(*owner))
        own = np.searchsorted(bounds, suffix, side="right") - 1
        out.append((rows[own], suffix + moves[own], suffix - last, suffix - first, hashes[suffix], digest))
    if not out:
        return None
    return [np.concatenate(c) for c in zip(*out)]


# A row for each item: a suffix and its windows l1 to l2.  Items of a bucket with the same `cls` have
# the same bytes in all their windows; those with the same `core` have the same bytes in what all
# windows of their block of offsets share.  Both are bucket identifiers of the next refinement; with
# the bucket they make 128 bits.
CLASS = ["bucket", "core", "cls"]
ITEM = "key1 bigint, key2 bigint, at int, bucket bigint, core bigint, cls bigint, l1 int, l2 int, open boolean"


def _keyed(documents: DataFrame) -> DataFrame:
    """Rows with a 128-bit key of id and text: rows with one key have the same result."""
    return documents.select(
        "doc_id", "text", F.xxhash64("doc_id").alias("key1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("key2")
    )


def _identifier(digest: np.ndarray, *places: np.ndarray) -> np.ndarray:
    """A digest together with the offsets that it stands for."""
    for place in places:
        digest = mixed(digest * U64(_BASE) + place.astype(U64))
    return digest


def _first_items(keyed: DataFrame, length: int, q: int) -> DataFrame:
    def run(batch):
        found = sampled(utf8(batch.column("text")), length, q, worker_state("rolling", _Rolling))
        if found is None:
            return None
        rows, at, l1, l2, bucket, whole = found
        n, rows = len(rows), pa.array(rows)
        return {
            "key1": batch.column("key1").take(rows), "key2": batch.column("key2").take(rows), "at": at.astype(np.int32),
            "bucket": signed(bucket), "core": np.zeros(n, np.int64), "cls": signed(_identifier(whole, l1, l2)),
            "l1": l1.astype(np.int32), "l2": l2.astype(np.int32), "open": np.ones(n, bool),
        }

    return per_batch(keyed.select("key1", "key2", "text"), run, ITEM)


class _Cut:
    """Collects items cut into blocks of `size` offsets, with their identifiers."""

    def __init__(self, size, length):
        self.size, self.length = size, length
        self.rows, self.blocks, self.firsts, self.lasts, self.parts, self.cores = [], [], [], [], [], []

    def add(self, row, l1, l2, held, start):
        """An item of row `row`; `held` has its bytes, with the suffix at `start`."""
        size, length = self.size, self.length
        for block in range(l1 // size, l2 // size + 1):
            low, high = block * size, block * size + size - 1
            a, b = max(l1, low), min(l2, high)
            self.rows.append(row)
            self.blocks.append(block)
            self.firsts.append(a)
            self.lasts.append(b)
            self.parts.append(held[start - b:start + length - a])
            self.cores.append(held[start - low:start + length - high])

    def columns(self):
        block, first, last = (np.array(c, np.int32) for c in (self.blocks, self.firsts, self.lasts))
        return {
            "core": signed(_identifier(_digests(self.cores), block)),
            "cls": signed(_identifier(_digests(self.parts), first, last)),
            "l1": pa.array(first), "l2": pa.array(last),
        }


def _from_texts(texts: DataFrame, size: int, length: int, keep: bool) -> DataFrame:
    """Items of (key1, key2, text, held) cut into blocks, with their bytes if these are to be kept."""

    def run(batch):
        cut, owner, held = _Cut(size, length), [], []
        for row, (text, items) in enumerate(zip(utf8(batch.column("text")), batch.column("held").to_pylist())):
            for x in items:
                cut.add(len(held), x["l1"], x["l2"], text, x["at"])
                owner.append(row)
                held.append(x)
        at = np.array(cut.rows, int)
        own = pa.array(np.array(owner, int)[at])
        columns = {c: batch.column(c).take(own) for c in ("key1", "key2")}
        columns |= {c: [held[i][c] for i in cut.rows] for c in ("at", "bucket", "open")}
        return columns | cut.columns() | ({"bytes": cut.parts} if keep else {})

    return per_batch(texts, run, ITEM + (", bytes binary" if keep else ""))


def _from_bytes(items: DataFrame, size: int, length: int) -> DataFrame:
    """Items that carry their bytes, cut into smaller blocks."""

    def run(batch):
        cut = _Cut(size, length)
        columns = (batch.column(c).to_pylist() for c in ("l1", "l2", "bytes"))
        for row, (l1, l2, held) in enumerate(zip(*columns)):
            cut.add(row, l1, l2, held, l2)
        own = pa.array(cut.rows, pa.int64())
        return {c: batch.column(c).take(own) for c in ("key1", "key2", "at", "bucket", "open")} | cut.columns()

    return per_batch(items, run, ITEM)


def _step(items: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans that are repeated for sure, and the items that the next, finer blocks must decide.

    An item whose class has another member is repeated in all its windows.  An item that is alone
    with its core is repeated in none.  In the other cores each class goes on with one member;
    what is decided already goes on for comparison only.
    """
    items = items.withColumn("uid", F.xxhash64("key1", "key2", "at", "l1"))
    classes = written(items.groupBy(*CLASS).agg(
        F.count(F.lit(1)).alias("n"), F.min("uid").alias("first"), F.max("open").alias("wanted")
    ), "classes")
    single = F.col("wanted") & (F.col("n") == 1)
    cores = classes.groupBy("bucket", "core").agg(F.count(F.lit(1)).alias("kinds"), F.max(single).alias("undecided"))
    cores = written(cores.filter("kinds > 1 AND undecided").drop("undecided"), "cores")
    told = lookup(classes, cores, ["bucket", "core"], "kinds").filter("n > 1 OR kinds IS NOT NULL")
    told = written(told.select(*CLASS, "n", F.when(F.col("kinds").isNotNull(), F.col("first")).alias("goes")), "told")
    known = marked_likely(items, told, CLASS, "_likely").filter("_likely").drop("_likely")
    decided = written(lookup(known, told, CLASS, "n").filter("n IS NOT NULL"), "decided")
    spans = decided.filter("open AND n > 1").select(
        "key1", "key2", (F.col("at") - F.col("l2")).cast("long").alias("from"), (F.col("at") + length - F.col("l1")).cast("long").alias("to")
    )
    left = decided.filter("uid = goes").withColumn("open", F.col("open") & (F.col("n") == 1))
    return spans, left.drop("uid", "n", "goes")


def _with_texts(keyed: DataFrame, left: DataFrame) -> DataFrame:
    """(key1, key2, text, held): texts that have undecided items, one for each key, with the items."""
    held = left.groupBy("key1", "key2").agg(F.collect_list(F.struct("at", "bucket", "l1", "l2", "open")).alias("held"))
    held = written(held, "undecided")
    texts = marked_likely(keyed.select("key1", "key2", "text"), held, ["key1", "key2"], "_likely").filter("_likely").drop("_likely")
    # Rows with one key have one text.
    return texts.join(held.hint("merge"), ["key1", "key2"]).dropDuplicates(["key1", "key2"])


def repeated_spans(documents: DataFrame, length=LENGTH, q=Q) -> tuple[DataFrame, DataFrame]:
    """Documents with their row keys, and spans (key1, key2, from, to) whose every byte is repeated."""
    keyed = _keyed(documents)
    first = written(_first_items(keyed, length, q), "suffixes")
    shared = written(first.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    likely = marked_likely(first, shared, ["bucket"], "_likely").filter("_likely").drop("_likely")
    spans, left = _step(likely, length)
    # Texts are read again for the coarse blocks, and once more for what these leave open.
    coarse, fine, single = BLOCKS
    items = written(_from_texts(_with_texts(keyed, left), coarse, length, keep=False), "coarse")
    more, left = _step(items, length)
    spans = spans.unionByName(more)
    items = written(_from_texts(_with_texts(keyed, left), fine, length, keep=True), "fine")
    more, left = _step(items, length)
    spans = spans.unionByName(more)
    items = written(_from_bytes(left, single, length), "single")
    more, _ = _step(items, length)
    return keyed, spans.unionByName(more)


def remove_repeats(documents: DataFrame, length=LENGTH, q=Q) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): documents (doc_id, text) without repeated strings.

    A byte goes if a string of `length` bytes over it also starts anywhere else in the table, in
    the same text or another; matches stay within texts, overlaps count, and all is judged on the
    input.  `spans` are the maximal removed runs (from, to), `kept` the remaining bytes.  A
    missing or empty text has no bytes.  Each row is a text of its own, so repeated rows are
    repeats of each other; the id may be anything.  Empty tables give no rows; other columns are
    not used.

    Suffixes are sampled: about two of `length` - `q` offsets, and whatever is repeated holds a
    sampled one.  Their q-gram buckets are refined by the bytes at later (and earlier) offsets, from
    blocks of offsets to single ones, and only what is undecided goes on.  Single buckets and
    whole copies are decided without reading a text again.
    """
    keyed, spans = repeated_spans(documents, length, q)
    per_row = spans.distinct().groupBy("key1", "key2").agg(F.collect_list(F.array("from", "to")).alias("spans"))
    per_row = written(per_row, "row_spans")
    marked = marked_likely(keyed, per_row, ["key1", "key2"], "_likely")
    touched = marked.filter("_likely").drop("_likely").join(per_row.hint("merge"), ["key1", "key2"], "left")
    others = marked.filter("NOT _likely").drop("_likely").withColumn("spans", F.lit(None).cast("array<array<bigint>>"))

    def cut(batch):
        kept, every, counts = [], [], []
        for text, spans in zip(utf8(batch.column("text")), batch.column("spans").to_pylist()):
            counts.append(len(text))
            merged = []
            for a, b in sorted(spans or []):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            ends = [0, *(x for s in merged for x in s), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])))
            every.append(merged)
        return {"doc_id": batch.column("doc_id"), "n_bytes": counts, "spans": every, "kept": kept}

    kind = dict(documents.dtypes)["doc_id"]
    columns = ["doc_id", "text", "spans"]
    return per_batch(
        touched.select(*columns).unionByName(others.select(*columns)), cut,
        f"doc_id {kind}, n_bytes bigint, spans array<array<bigint>>, kept binary",
    )

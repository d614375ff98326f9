"""Removal of benchmark passages from training texts."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from snipquarry.llm.common import WordHashes, ngrams, per_batch, utf8, worker_state

WINDOW = 10
# Most benchmark items of one copied block; a larger benchmark is scanned for block by block.
BLOCK_ITEMS = 50_000
BLOCK_BYTES = 64 * 1024 * 1024

# Words are runs of digits, letters a to z and all that is not ASCII, after lower-casing A-Z.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(items: pa.Table, window=WINDOW):
    """{length: (sorted window hashes, {hash: [(words, item row)]})} of benchmark items (item_id, text)."""
    hashes, found = WordHashes(), {}
    for row, text in enumerate(utf8(items.column("text"))):
        w = words(text)
        n = min(window, len(w))
        if n:
            for i, h in enumerate(ngrams(hashes.of(w), n).tolist()):
                entry = (tuple(w[i:i + n]), row)
                at = found.setdefault(n, {}).setdefault(h, [])
                if entry not in at:
                    at.append(entry)
    return {n: (np.array(sorted(by), np.uint64), by) for n, by in found.items()}


def hits(w: list[bytes], hashes: np.ndarray, known) -> tuple[list[tuple[int, int]], set[int]]:
    """Word ranges that are windows of an item, and the rows of these items.

    A hash that is in the set is only a possible hit: the words themselves are compared.
    """
    ranges, items = [], set()
    for n, (sorted_hashes, by) in known.items():
        grams = ngrams(hashes, n)
        at = np.searchsorted(sorted_hashes, grams)
        at[at == len(sorted_hashes)] = 0
        for i in np.flatnonzero(sorted_hashes[at] == grams).tolist():
            own = tuple(w[i:i + n])
            rows = [row for other, row in by[int(grams[i])] if other == own]
            if rows:
                ranges.append((i, i + n))
                items.update(rows)
    return ranges, items


def _merged(ranges):
    out = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(benchmark: DataFrame, most_items: int, most_bytes: int) -> list[DataFrame]:
    """The benchmark in blocks that are small enough to be copied to all tasks."""
    size = benchmark.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n = max(1, -(-size.n // most_items), -(-(size.b or 0) // most_bytes))
    if n == 1:
        return [benchmark]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [benchmark.filter(part == i) for i in range(n)]


def scan(
    documents: DataFrame, benchmark: DataFrame, window=WINDOW, block_items=BLOCK_ITEMS, block_bytes=BLOCK_BYTES
) -> DataFrame:
    """(doc_id, text, n_words, ranges, items, unnamed) for every row of documents (doc_id, text).

    `ranges` are maximal runs of hit words as (from, to), `items` the ids of the items of
    benchmark (item_id, text) with an occurring window, as sorted strings.  A window is `window`
    consecutive words, or a shorter item as a whole.  A missing text has no words, an item
    without words occurs nowhere.  Words of an item without an id are hit like others; it is not
    among `items`, and `unnamed` says whether one occurs.  Repeated rows each give a row; other
    columns are not used.

    The hash set of a block of the benchmark is copied to the tasks and every text is scanned once
    for each block, so a benchmark of any size is covered; documents are never shuffled.
    """
    spark = documents.sparkSession
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text string, n_words bigint, ranges array<array<bigint>>, items array<string>, unnamed boolean"
    rows = documents.select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<array<bigint>>").alias("ranges"), F.array().cast("array<string>").alias("items"),
        F.lit(False).alias("unnamed"),
    )
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    for block in _blocks(items, block_items, block_bytes):
        table = block.toArrow()
        names = [None if x is None else str(x) for x in table.column("item_id").to_pylist()]
        copied = spark.sparkContext.broadcast((windows(table, window), names))

        def run(batch, copied=copied):
            known, names = copied.value
            hashes = worker_state("word_hashes", WordHashes)
            counts, ranges, items, unnamed = [], [], [], []
            for text, before, had, some in zip(
                utf8(batch.column("text")), *(batch.column(c).to_pylist() for c in ("ranges", "items", "unnamed"))
            ):
                w = words(text)
                found, rows = hits(w, hashes.of(w), known)
                counts.append(len(w))
                ranges.append(_merged([*before, *found]) if found else before)
                own = {names[r] for r in rows}
                items.append(sorted({*had, *own} - {None}) if rows else had)
                unnamed.append(some or None in own)
            return {
                "doc_id": batch.column("doc_id"), "text": batch.column("text"),
                "n_words": counts, "ranges": ranges, "items": items, "unnamed": unnamed,
            }

        rows = per_batch(rows, run, schema)
    return rows


def without_ranges(text: str | None, ranges) -> str | None:
    """The text without the words of the ranges and what stands between them."""
    if not ranges or text is None:
        return text
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    kept, at = [], 0
    for a, b in ranges:
        kept.append(raw[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def cut(found: DataFrame, most_hit=0.5) -> DataFrame:
    """(doc_id, text) of scanned rows without their hit spans; rows of which more than `most_hit` of the
    words are hit are left out, since little remains of them."""

    def run(batch):
        texts = [without_ranges(t, r) for t, r in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist())]
        return {"doc_id": batch.column("doc_id"), "text": texts}

    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    kept = found.filter(hit <= F.col("n_words") * most_hit)
    return per_batch(kept.select("doc_id", "text", "ranges"), run, f"doc_id {dict(found.dtypes)['doc_id']}, text string")


def decontaminate(documents: DataFrame, benchmark: DataFrame, most_hit=0.5, **options) -> DataFrame:
    """Documents (doc_id, text) without benchmark passages: mostly hit texts go, others lose the hit
    spans, and clean rows stay as they are."""
    return cut(scan(documents, benchmark, **options), most_hit)

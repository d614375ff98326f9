"""Line dedup over levelled sorted runs of line hashes."""

from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from snipquarry.llm.common import WHITE, per_batch, utf8
from snipquarry.plans.keys import cut_points, lookup, marked_likely
from snipquarry.plans.scratch import written

LEAST_CHARS = 40
LEAST_DOCS = 5
BATCHES = 4
# A level with this many runs is merged into one run of the next.
FANOUT = 3
KEY = ["h1", "h2"]


def line_key(line: bytes, least: int) -> bytes | None:
    """The stripped line with A-Z in lower case, if it has at least `least` code points."""
    key = line.strip(WHITE).lower()
    if len(key) >= 4 * least or len(key) >= least and len(key.decode()) >= least:
        return key
    return None


def _digest(key: bytes) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(key)
    return whole >> 64, whole & 0xFFFFFFFFFFFFFFFF


def digests(documents: DataFrame, least: int, order: str | None = None) -> DataFrame:
    """(doc_id, h1, h2): the distinct long line keys of each row of documents (doc_id, text), and its `order`."""
    also = [order] if order else []

    def run(batch):
        counts, keys = [], []
        for text in utf8(batch.column("text")):
            own = {k for line in text.split(b"\n") if (k := line_key(line, least)) is not None}
            counts.append(len(own))
            keys.extend(map(_digest, own))
        rows = np.repeat(np.arange(len(counts)), counts)
        both = np.array(keys, np.uint64).reshape(-1, 2).view(np.int64)
        return {**{c: batch.column(c).take(rows) for c in ("doc_id", *also)}, "h1": both[:, 0], "h2": both[:, 1]}

    kinds = dict(documents.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *also))
    return per_batch(documents.select("doc_id", *also, "text"), run, f"{schema}, h1 bigint, h2 bigint")


@dataclass
class Runs:
    """Levelled runs of line keys, each sorted by key: rows (h1, h2, n, keeper).

    `n` counts documents.  `keeper` is set in one row of a key over all runs: that of the batch
    that had it first.  Batches must come from the last documents down, so the keeper is the
    last document that holds the key.
    """

    spark: SparkSession
    fanout: int = FANOUT
    levels: list[list[DataFrame]] = field(default_factory=list)

    def _store(self, run: DataFrame, level: int):
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(written(run.sortWithinPartitions(*KEY), f"run{level}"))
        if len(self.levels[level]) >= self.fanout:
            merged = _merged(self.levels[level])
            self.levels[level] = []
            self._store(merged, level + 1)

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame):
        """Add the keys of a batch (h1, h2, n, keeper).  Its merge anti-join with the runs finds those
        that are new; the others only add to the count."""
        known = self.all()
        if known:
            firsts = _union([run.filter("keeper IS NOT NULL").select(*KEY, F.lit(True).alias("known")) for run in known])
            keeper = F.when(F.col("known").isNull(), F.col("keeper"))
            batch = batch.join(firsts.hint("merge"), KEY, "left").select(*KEY, "n", keeper.alias("keeper"))
        self._store(batch, 0)

    def frequent(self, least_docs: int) -> DataFrame:
        """(h1, h2, n, keeper) of the keys that at least `least_docs` documents hold."""
        return _merged(self.all()).filter(F.col("n") >= least_docs)


def _union(parts):
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _merged(runs: list[DataFrame]) -> DataFrame:
    return _union(runs).groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))


def frequent_lines(keys: DataFrame, least_docs=LEAST_DOCS, batches=BATCHES, fanout=FANOUT, order: str | None = None) -> DataFrame:
    """Frequent keys of stored digests, which go through the runs in batches of falling doc_id, or of
    falling `order`, where missing ones come last."""
    by, keeper = order or "doc_id", F.struct(order, "doc_id") if order else F.col("doc_id")
    cuts = cut_points(keys, by, batches)[::-1]
    runs, above = Runs(keys.sparkSession, fanout), None
    for cut in [*cuts, None]:
        part = keys.filter("doc_id IS NOT NULL")
        if above is not None:
            part = part.filter((F.col(by) < above) | F.col(by).isNull())
        if cut is not None:
            part = part.filter(F.col(by) >= cut)
        runs.add(part.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max(keeper).alias("keeper")))
        above = cut
    return runs.frequent(least_docs)


def dedup_lines(
    documents: DataFrame, least_chars=LEAST_CHARS, least_docs=LEAST_DOCS, batches=BATCHES, fanout=FANOUT, order: str | None = None
) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): documents (doc_id, text) without their repeated lines.

    A line's key is the line stripped of ASCII white space with A-Z in lower case.  Keys of at least
    `least_chars` code points that at least `least_docs` documents hold lose their lines, except
    in the document of the largest doc_id (a whole number).  Other lines stay, joined by \\n.  A
    missing or empty text is one empty line.  Each row is a document: rows that share an id count
    each, and keep or lose lines alike.  Rows without an id are not counted and lose nothing.
    Empty tables give no rows; other columns are not used.  `order` names a column of whole numbers
    by which the keeper is chosen instead, the largest doc_id of equal ones; missing ones are smallest.

    Texts are read to hash their lines, and again to cut them; only those that may lose a line
    are shuffled.  A line that very many documents hold is looked up in a copied table.
    """
    keys = written(digests(documents, least_chars, order), "line_digests")
    frequent = frequent_lines(keys, least_docs, batches, fanout, order)
    if order:
        frequent = frequent.withColumn("keeper", F.col("keeper.doc_id"))
    frequent, keys = written(frequent, "frequent_lines"), keys.select("doc_id", *KEY)
    # Most lines are not frequent, and go before the join.
    likely = marked_likely(keys.filter("doc_id IS NOT NULL"), frequent, KEY, "_likely").filter("_likely").drop("_likely")
    held = lookup(likely, frequent, KEY, "n").filter("keeper <> doc_id")
    drops = held.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("dropped"))
    drops = written(drops, "dropped_lines")
    marked = marked_likely(documents.select("doc_id", "text"), drops, ["doc_id"], "_likely")
    touched = marked.filter("_likely").drop("_likely").join(drops.hint("merge"), "doc_id", "left")
    others = marked.filter("NOT _likely").drop("_likely").withColumn("dropped", F.lit(None).cast(drops.schema["dropped"].dataType))

    def run(batch):
        texts, lines, gone = [], [], []
        for text, dropped in zip(utf8(batch.column("text")), batch.column("dropped").to_pylist()):
            n, n_gone = text.count(b"\n") + 1, 0
            if dropped:
                hit = {(d["h1"] & 0xFFFFFFFFFFFFFFFF, d["h2"] & 0xFFFFFFFFFFFFFFFF) for d in dropped}
                kept = [x for x in text.split(b"\n") if (k := line_key(x, least_chars)) is None or _digest(k) not in hit]
                n_gone, text = n - len(kept), b"\n".join(kept)
            texts.append(text.decode())
            lines.append(n)
            gone.append(n_gone)
        return {"doc_id": batch.column("doc_id"), "text": texts, "n_lines": lines, "n_dropped": gone}

    kind = dict(documents.dtypes)["doc_id"]
    return per_batch(touched.unionByName(others), run, f"doc_id {kind}, text string, n_lines bigint, n_dropped bigint")

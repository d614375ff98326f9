"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme values."""

import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from snipquarry.llm.common import forget, per_batch, sliced, utf8, worker_state
from snipquarry.llm.decontaminate import words
from snipquarry.plans.scratch import written

# Labelled rows that the model is fitted on, at most.  Counts of the prior cover all documents.
SAMPLE = 50_000
# A token counts as itself and by its first 4 and 5 characters; each kind has its hash buckets.
KINDS = ((0, 1 << 17), (4, 1 << 16), (5, 1 << 16))
BUCKETS = sum(n for _, n in KINDS)
# Weight of the prior against the labelled documents, and by how many standard deviations log-odds
# must differ from zero to count: many tokens are tried, so chance must be rare.
PRIOR_SHARE = 0.1
DEVIATIONS = 3.0
# And by how much at least, so that the language or the subject of toxic texts is no evidence.
LEAST_ODDS = 1.5
DRIFT = 0.1
BINS = 400
# Words whose buckets, and whose scores, a worker keeps.
KNOWN_BUCKETS, KNOWN_SCORES = 150_000, 200_000
E_VALUE = 0.05


def buckets_of(word: bytes) -> list[int]:
    text, start, out = word.decode().lower(), 0, []
    for width, size in KINDS:
        if not width or len(text) > width:
            part = text[:width] if width else text
            out.append(start + xxhash.xxh3_64_intdigest(f"{width}:{part}") % size)
        start += size
    return out


class _Buckets(dict):
    def __missing__(self, word):
        if len(self) >= KNOWN_BUCKETS:
            self.clear()
        self[word] = found = buckets_of(word)
        return found


class _Scores(dict):
    """Score of each token under a model."""

    def __init__(self, evidence, drift):
        self.evidence, self.drift = evidence, drift

    def __missing__(self, word):
        if len(self) >= KNOWN_SCORES:
            self.clear()
        own = self.evidence[buckets_of(word)]
        self[word] = score = float(max(own.max(), 0.0) + min(own.min(), 0.0) - self.drift)
        return score


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (from, to, score) in one pass.

    Only places of positive score can begin or end one, so the pass goes over these.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[list] = []  # from, to, sum before, sum after, the last earlier one with a smaller sum before
    for i in np.flatnonzero(scores > 0).tolist():
        a, b, before, after = i, i + 1, sums[i], sums[i + 1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= before:
                j = held[j][4]
            if j < 0 or held[j][3] >= after:
                held.append([a, b, before, after, j])
                break
            a, before = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, float(after - before)) for a, b, before, after, _ in held]


@dataclass
class Model:
    evidence: np.ndarray
    drift: float = DRIFT
    rate: float = 1.0  # of the extreme-value distribution of a text's best segment
    scale: float = 1.0
    weights: tuple = (0.0, 0.0, 0.0)
    constant: float | None = None  # where labels are missing or all alike

    def plain(self) -> tuple:
        """The model as plain values, which any worker can load."""
        return tuple(vars(self).values())


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _sample(labels: DataFrame, most: int) -> DataFrame:
    """Labelled rows to learn from: (doc_id, toxic), an even choice by hash of at most `most`."""
    one = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _counts(labelled: DataFrame) -> DataFrame:
    """(bucket, all_n, toxic_n, clean_n): how many of all documents (text, toxic) hold a token of the
    bucket; toxic is NULL where unknown.  Bucket -1 counts the documents themselves.

    A bucket counts once a document: repetitions in one text are no further evidence.
    """

    def run(batches):
        known, sums, documents = worker_state("toxicity_buckets", _Buckets), np.zeros((3, BUCKETS), np.int64), [0, 0, 0]
        for batch in sliced(batches):
            for text, toxic in zip(utf8(batch.column("text")), batch.column("toxic").to_pylist()):
                # Words may share a bucket, e.g. by their first characters: it counts once.
                held = list(set(chain.from_iterable(map(known.__getitem__, set(words(text))))))
                for kind in (0,) if toxic is None else (0, 1 if toxic else 2):
                    sums[kind, held] += 1
                    documents[kind] += 1
        used = np.flatnonzero(sums.any(axis=0))
        names = ("all_n", "toxic_n", "clean_n")
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int64())} | {c: sums[i, used] for i, c in enumerate(names)})
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([-1], pa.int64())} | {c: pa.array([n], pa.int64()) for c, n in zip(names, documents)})

    made = labelled.select("text", "toxic").mapInArrow(run, "bucket bigint, all_n bigint, toxic_n bigint, clean_n bigint")
    return made.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("all_n", "toxic_n", "clean_n")])


def _evidence(counts: pa.Table) -> np.ndarray:
    """Log-odds of each bucket with a Dirichlet prior from the whole corpus, less a standard deviation,
    where they are sure."""
    n = np.zeros((3, BUCKETS + 1))
    at = counts.column("bucket").to_numpy()
    for i, c in enumerate(("all_n", "toxic_n", "clean_n")):
        n[i, at] = counts.column(c).to_numpy()
    documents, held = n[:, -1], n[:, :-1]
    strength = PRIOR_SHARE * (documents[1] + documents[2])
    share = held[0] / max(documents[0], 1)
    prior = np.maximum(strength * share, 1e-6)
    odds = [np.log((held[i] + prior) / np.maximum(documents[i] - held[i] + strength - prior, 0.5)) for i in (1, 2)]
    gap = odds[0] - odds[1]
    spread = np.sqrt(1 / (held[1] + prior) + 1 / (held[2] + prior))
    sure = (np.abs(gap) >= DEVIATIONS * spread) & (np.abs(gap) - spread >= LEAST_ODDS)
    return np.where(sure, gap - np.sign(gap) * spread, 0)


def _rate(values: np.ndarray, share: np.ndarray) -> float:
    """The positive rate at which the mean of exp(rate * score) over tokens is 1."""
    if not (values[share > 0] > 0).any():
        return 50.0
    mean = lambda r: float((share * np.exp(np.minimum(r * values, 700))).sum())
    low, high = 0.0, 1e-3
    while mean(high) < 1 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return max((low + high) / 2, 1e-3)


def _inputs(best, total, n, rate, scale):
    """What the last step sees: how far the best segment exceeds chance, and all segments together."""
    n = np.maximum(n, 1)
    excess = np.clip(rate * best - np.log(scale * n), -20, 40)
    return np.stack([np.ones_like(excess), excess / 10, np.log1p(rate * total) - np.log1p(n) / 2], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, penalty=1e-2) -> tuple:
    """Newton steps for a logistic regression with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _measured(rows: DataFrame, model: Model) -> DataFrame:
    """(toxic, n, best, total) of each labelled row, and (bin, many): scores of clean tokens by bin."""
    copied = rows.sparkSession.sparkContext.broadcast(model.plain())
    schema = "toxic int, n bigint, best double, total double, bin int, many bigint"

    def run(batch):
        model = Model(*copied.value)
        low, high = _range(model)
        scores = _Scores(model.evidence, model.drift)
        n, best, total, bins = [], [], [], np.zeros(BINS, np.int64)
        labels = batch.column("toxic").to_pylist()
        for text, toxic in zip(utf8(batch.column("text")), labels):
            w = words(text)
            s = np.fromiter(map(scores.__getitem__, w), float, len(w))
            found = [x for _, _, x in segments(s)]
            n.append(len(w))
            best.append(max(found, default=0.0))
            total.append(sum(found))
            if not toxic:
                bins += np.histogram(s, BINS, (low, high))[0]
        used, rows = np.flatnonzero(bins), batch.num_rows
        rest = [None] * rows
        nothing = [None] * len(used)
        return {
            "toxic": labels + nothing, "n": n + nothing, "best": best + nothing, "total": total + nothing,
            "bin": rest + used.tolist(), "many": rest + bins[used].tolist(),
        }

    return per_batch(rows.select("text", "toxic"), run, schema)


def _range(model: Model):
    most = float(np.abs(model.evidence).max()) + 1
    return -2 * most, 2 * most


def fit(documents: DataFrame, labels: DataFrame, sample=SAMPLE) -> Model:
    """Learn from documents (doc_id, text) with labels (doc_id, toxic).

    A document with both labels counts as toxic; rows without an id or label teach nothing.  At
    most `sample` labelled rows are used, chosen evenly by a hash of their id; of rows that share
    an id, one is, chosen by a hash of its text.  The prior's counts are those of all documents.  Without labels, or with one kind only, every score is that kind's.
    """
    chosen = written(_sample(labels, sample), "toxic_sample")
    shares = chosen.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    if not shares.n or shares.toxic in (0, shares.n):
        return Model(np.zeros(BUCKETS), constant=1.0 if shares.n and shares.toxic else 0.0)
    texts = documents.select("doc_id", "text")
    # At most `sample` rows are copied, and so many are left: repeated ids go before the shuffle.
    one = F.min(F.struct(F.xxhash64("text"), "text"))["text"]
    labelled = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), one.alias("text"))
    labelled = written(labelled, "toxic_labelled")
    every = _counts(texts.withColumn("toxic", F.lit(None).cast("int"))).select("bucket", "all_n", *[F.lit(0).cast("long").alias(c) for c in ("toxic_n", "clean_n")])
    own = _counts(labelled).withColumn("all_n", F.lit(0).cast("long"))
    counts = every.unionByName(own).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("all_n", "toxic_n", "clean_n")]).toArrow()
    model = Model(_evidence(counts))
    measured = written(_measured(labelled, model), "toxic_measured")
    bins = measured.filter("bin IS NOT NULL").groupBy("bin").agg(F.sum("many").alias("many")).toPandas()
    table = measured.filter("bin IS NULL").select("toxic", "n", "best", "total").toPandas()
    if table.empty or table.toxic.nunique() < 2:
        return Model(np.zeros(BUCKETS), constant=float(table.toxic.mean() > 0.5) if len(table) else 0.0)
    low, high = _range(model)
    values = low + (bins.bin.to_numpy() + 0.5) * (high - low) / BINS
    share = bins.many.to_numpy() / max(bins.many.sum(), 1)
    model.rate = _rate(values, share)
    clean = table[(table.toxic == 0) & (table.n > 0)]
    if len(clean):
        model.scale = math.exp(float((model.rate * clean.best - np.log(clean.n)).mean()) - 0.5772156649)
    x = _inputs(table.best.to_numpy(), table.total.to_numpy(), table.n.to_numpy().astype(float), model.rate, model.scale)
    model.weights = _logistic(x, table.toxic.to_numpy().astype(float))
    return model


def _judged(model: Model, scores: _Scores, text: bytes):
    """(score, significant passages) of one text."""
    if model.constant is not None:
        return model.constant, []
    w = words(text)
    s = np.fromiter(map(scores.__getitem__, w), float, len(w))
    found = segments(s)
    best, total = max((x for _, _, x in found), default=0.0), sum(x for _, _, x in found)
    z = float(_inputs(np.array([best]), np.array([total]), np.array([float(len(w))]), model.rate, model.scale)[0] @ np.array(model.weights))
    passages = []
    for a, b, x in found:
        chance = model.scale * len(w) * math.exp(-min(model.rate * x, 700))
        if chance <= E_VALUE:
            passages.append({"from_word": a, "to_word": b, "score": x, "e_value": chance})
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), passages


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages) for every row of documents (doc_id, text).

    `score` is 0 to 1, higher where the label 1 is likelier; `passages` are all maximal scoring
    segments of the text's words that chance would make less than E_VALUE times in a clean text
    of its length.  A missing or empty text has no passage and the score of a text without
    evidence.  Repeated rows each give a row; other columns are not used.
    """
    copied = documents.sparkSession.sparkContext.broadcast(model.plain())

    def run(batches):
        forget()
        model = Model(*copied.value)
        scores = _Scores(model.evidence, model.drift)
        for batch in sliced(batches):
            found = [_judged(model, scores, t) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], passage)
            ], names=["doc_id", "score", "passages"])

    passage = pa.list_(pa.struct([("from_word", pa.int64()), ("to_word", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, score double, passages array<struct<from_word: bigint, to_word: bigint, score: double, e_value: double>>"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def is_toxic(text: Column, model: Model, documents: DataFrame) -> Column:
    """Whether a text is rejected, as a column; keeps all other columns of the rows as they are."""
    copied = documents.sparkSession.sparkContext.broadcast(model.plain())

    def judge(batches):
        forget()
        model = Model(*copied.value)
        scores = _Scores(model.evidence, model.drift)
        for texts in batches:
            parts = (texts.slice(start, 1000) for start in range(0, len(texts), 1000))
            yield pa.array([_judged(model, scores, t)[0] >= 0.5 for part in parts for t in utf8(part)], pa.bool_())

    from collections.abc import Iterator

    judge.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(judge, "boolean")(text)

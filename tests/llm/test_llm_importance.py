"""Importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from snipquarry.llm import importance


def brute(rows, target, runs, seed, least, percent, buckets=10_000):
    def features(text):
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
        made = [" ".join(w[i:i + n]) for n in range(runs[0], runs[1] + 1) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(f.encode()) % buckets for f in made]

    docs = [(d, *features(t)) for d, t in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for text in target for b in features(text)[1])
    sums = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * sums[0] / ((s[b] + 1) * sums[1]))) for b in range(buckets)]
    out = []
    for d, n, f in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    pool = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(pool[:len(pool) * percent // 100]):
        r[4] = i + 1
    return Counter(map(tuple, out))


ODD = [(None, "a B c d e f " * 9), (1, None), (2, ""), (3, "..."), (4, "é ü É " * 20_000), (4, "é ü É " * 20_000), (4, "x " * 30), (-5, "A1 a1 \x00b")]


@pytest.mark.parametrize("runs, least, percent", [((1, 1), 20, 10), ((1, 3), 5, 50), ((2, 2), 0, 100)])
def test_as_brute_force(spark, runs, least, percent):
    rng = np.random.default_rng(0)
    rows = ODD + [(10 + i, " ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(0, 90)) % 500)) for i in range(120)]
    rows += [(500 + i, "one and the same text " * 8) for i in range(60)]  # a third are copies
    target = [" ".join(f"w{x}" for x in rng.integers(300, 500, 40)) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame([(*r, 7, "clash") for r in rows], "doc_id bigint, text string, rank int, weight string").repartition(5)
    got = importance.resample(
        docs, spark.createDataFrame([(t,) for t in target], "text string"), runs, least_words=least, percent=percent
    )
    assert Counter(map(tuple, got.collect())) == brute(rows, target, runs, 2024, least, percent)


def test_empty_tables(spark):
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string")
    assert importance.resample(docs.limit(0), docs.select("text")).count() == 0
    got = importance.resample(docs, docs.select("text").limit(0), percent=100)
    assert Counter(map(tuple, got.collect())) == brute(ODD, [], (1, 1), 2024, 20, 100)


def test_planes_hold_any_size():
    rng = np.random.default_rng(1)
    counts = np.concatenate([rng.integers(0, 1 << 20, (3, 130)), np.zeros((1, 130), np.int64)])
    gain = rng.integers(-70_000, 70_000, 130)
    split = [importance.planes(np.maximum(s * gain, 0)[None])[:, 0] for s in (1, -1)]
    assert importance.weigh(counts, *split).tolist() == (counts @ gain).tolist()

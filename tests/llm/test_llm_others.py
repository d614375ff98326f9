"""URL filter, toxicity, revisits and exact top-k on odd rows and against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from snipquarry.llm import topk, toxicity, url_filter, warc


# --- urls


def test_url_rules(spark):
    urls = [
        "http://WWW.Example.com/en/x", "https://a.example.com/en/y?q=/en/", "http://example.com/de/", "http://net/es/1", "http://x.net/fr",
        "http://x.net/fr/", "http://notexample.com/en/", "ftp://example.com", None, "nothing", "", "http://example.com:80/en/", "http://bad.org/p/#f", "https://www.bad.org/p",
    ]
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)] + [(0, urls[0], "r", "v"), (None, urls[0], "r", "v")], "page_id bigint, url string, rule string, verdict string")
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    listed = spark.createDataFrame([("http://bad.org/p/",), (None,), ("x",), ("http://bad.org/p",)], "url string")
    rows = url_filter.judge(pages, rules, listed, most_blocks=4).collect()
    got = {r.page_id: (r.rule, r.verdict) for r in rows}
    assert len(rows) == len(urls) + 2
    assert got[0] == ("www.example.com/en/", "allow") and got[1] == ("example.com/en/", "block") and got[2] == ("com/", "allow")
    assert got[3] == ("net/es/", "block") and got[4] == (None, "allow") and got[5] == ("net/fr/", "block") and got[6] == ("com/", "allow")
    assert got[7] == got[8] == got[9] == got[10] == (None, "allow") and got[11] == (None, "allow")
    assert got[12] == got[13] == (None, "block")
    assert url_filter.judge(pages.limit(0), rules, listed).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0), listed.limit(0)).collect()} == {"allow"}


def test_bloom_filter_loses_nothing(spark):
    listed = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    rows = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "id")
    passed = url_filter.possible_hits(rows, listed)
    assert passed.filter("id < 3000").count() == 3000
    assert passed.count() < 3000 + 27_000 * 0.02


# --- toxicity


def brute_segments(scores):
    """The best segment, then the same left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    left, right = brute_segments(scores[:a]), brute_segments(scores[b:])
    return left + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in right]


def test_segments():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 20, 25):
        for _ in range(15):
            scores = rng.normal(-0.2, 1, n).round(3)
            got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(scores)]
            assert got == [(a, b, round(float(s), 6)) for a, b, s in brute_segments(scores.tolist())]


def test_scores(spark):
    rng = np.random.default_rng(1)
    bad = ["grumbly", "snarkish", "vileword"]
    rows = []
    for i in range(400):
        words = [f"w{rng.integers(300)}" for _ in range(rng.integers(3, 80))]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(int(rng.integers(len(words))), bad[rng.integers(3)])
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (None, "grumbly vileword")], "doc_id bigint, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 300)] + [(None, 1), (9, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).collect()
    got = {r.doc_id: r.score for r in found}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(400))
    assert got[500] == got[501] < 0.5 <= got[None]
    assert all(len(r.passages) > 0 for r in found if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4 == 0)
    kept = docs.filter(~toxicity.is_toxic(F.col("text"), model, docs))
    assert kept.columns == docs.columns and kept.count() == 302
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}
    only = toxicity.fit(docs, labels.filter("toxic = 1"))
    assert {r.score for r in toxicity.score(docs, only).collect()} == {1.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_repeated_ids_are_learned_from_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join([f"w{rng.integers(60)}" for _ in range(20)] + ["vileword"] * 2 * (i % 4 == 0))) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id bigint, toxic int")
    schema, sizes, logistic = "doc_id bigint, text string", [], toxicity._logistic
    monkeypatch.setattr(toxicity, "_logistic", lambda x, y: sizes.append(len(y)) or logistic(x, y))
    # Exact copies, and other texts of the same id.
    many = [*rows, *[rows[3]] * 300, *[(5, f"{rows[5][1]} vileword{i}") for i in range(300)]]
    docs = spark.createDataFrame(many, schema).repartition(3)
    model = toxicity.fit(docs, labels, sample=100)
    assert sizes == [100]
    again = toxicity.fit(docs.repartition(2), labels, sample=100)
    assert np.array_equal(model.evidence, again.evidence) and np.allclose(model.weights, again.weights)


def test_rate_solves_its_equation():
    values, share = np.array([-1.0, 0.5, 2.0]), np.array([0.9, 0.07, 0.03])
    assert math.isclose(float((share * np.exp(toxicity._rate(values, share) * values)).sum()), 1, rel_tol=1e-6)


# --- revisits


def test_revisits(spark):
    def record(id_, kind, url, at, **headers):
        return id_, kind, url, at, {k.replace("_", "-"): v for k, v in headers.items()} if headers else None, "extra"

    rows = [
        record("r1", "response", "http://www.a.org/x/", 10, ETag='"1"', Content_Type="t", Age="1"), record("r2", "response", "https://a.org/x?q", 20, ETag='"2"', Last_Modified="d"),
        record("v0", "revisit", "http://a.org/x", 10, ETag='"1"'), record("v1", "revisit", "http://a.org/x", 15, ETag='W/"1"', Content_Type="other", Age="2"),
        record("v2", "revisit", "http://a.org/x", 25, ETag='"1"'), record("v3", "revisit", "http://a.org/x", 25, Last_Modified="d "),
        record("v4", "revisit", "http://a.org/x", 99), record("v5", "revisit", None, 99), record("v6", "revisit", "http://a.org/x", None), record("v7", "revisit", "http://b.org/", 5),
        record("v1", "revisit", "http://a.org/x", 15, ETag='W/"1"', Content_Type="other", Age="2"), record("q", "request", "http://a.org/x", 24), record("r3", "response", None, 1), record("r2b", "response", "http://a.org/x", 20, ETag='"2"', Server="s"),
    ]
    df = spark.createDataFrame(rows, "record_id string, kind string, url string, at bigint, headers map<string,string>, slice string")
    for slices in (1, 4):
        found = warc.resolve(df, slices).collect()
        got = {r.record_id: (r.refers_to, r.status, dict(r.headers)) for r in found}
        assert len(found) == 9
        assert got["v0"][:2] == (None, "missing") and got["v1"] == ("r1", "matched", {"etag": 'W/"1"', "content-type": "t", "age": "2"})
        assert got["v2"][:2] == (None, "changed") and got["v2"][2] == {"etag": '"1"'}
        assert got["v3"][:2] == ("r2b", "unchecked") and got["v4"] == ("r2b", "unchecked", {"etag": '"2"', "server": "s"})
        assert {got[v][1] for v in ("v5", "v6", "v7")} == {"missing"}
    assert warc.resolve(df.limit(0)).count() == 0


def test_revisits_of_one_hot_url(spark):
    rng = np.random.default_rng(3)
    rows = [(f"r{i}", "response" if rng.random() < 0.1 else "revisit", "http://hot.org/" if i % 3 else f"http://u{i % 7}.org/", int(rng.integers(0, 500)), {"etag": "e"}) for i in range(900)]
    df = spark.createDataFrame(rows, "record_id string, kind string, url string, at bigint, headers map<string,string>")
    got = {r.record_id: r.refers_to for r in warc.resolve(df, 8).collect()}
    for id_, kind, url, at, _ in rows:
        if kind == "revisit":
            earlier = [(a, i) for i, k, u, a, _ in rows if k == "response" and u == url and a < at]
            assert got[id_] == (max(earlier)[1] if earlier else None)


# --- top-k


@pytest.mark.parametrize("bins", [4, 64])
def test_topk(spark, bins):
    rng = np.random.default_rng(bins)
    rows = [(i, rng.normal(0, 1, 8).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.25] * 8) for i in range(200)]
    rows += [(2000, None), (2001, [0.5] * 7 + [None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, [1.0] * 3), (2005, []), (None, [1.0] * 8), (2006, [-1.0] * 3)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<float>, rank int").repartition(5)
    asked = [0, 50, 1000, 2004, 2005, 2000]
    got = {}
    for r in topk.topk(df.filter(F.col("vec_id").isin(asked)), df, k=5, bins=bins, block_bytes=200).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    for q in asked:
        if q not in whole:
            assert q not in got
            continue
        scores = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert topk.topk(df.limit(0), df).count() == 0


def test_large_components_use_whole_numbers(spark):
    rows = [(0, [2.0 ** 23, 1.0]), (1, [2.0 ** 23, 3.0]), (2, [2.0 ** 23, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.topk(df.filter("vec_id = 0"), df, k=2).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 2 ** 62 + 3 * 2 ** 16), (2, 2, 2 ** 62 + 2 * 2 ** 16)]


def test_a_bucket_counts_once_a_document(spark):
    # Words of one beginning share a bucket.
    rows = [("toxicity toxic toxicant toxicology toxins", 1), ("plain text", 0), ("toxicology", None)]
    counts = {r.bucket: r for r in toxicity._counts(spark.createDataFrame(rows, "text string, toxic int")).collect()}
    shared = [b for b in toxicity.buckets_of(b"toxicology") if b in toxicity.buckets_of(b"toxicant")]
    assert shared and all((counts[b].all_n, counts[b].toxic_n, counts[b].clean_n) == (2, 1, 0) for b in shared)
    assert (counts[-1].all_n, counts[-1].toxic_n, counts[-1].clean_n) == (3, 1, 1)


def _area(scores, labels):
    values, place = np.unique(scores, return_inverse=True)
    n = np.bincount(place)
    rank = (np.cumsum(n) - (n - 1) / 2)[place]
    many = labels.sum()
    return (rank[labels == 1].sum() - many * (many + 1) / 2) / (many * (len(labels) - many))


def test_held_out_quality(spark):
    """On held-out rows of a given table: at least as good as the largest log-odds of a word."""
    from collections import Counter

    from snipquarry.llm.decontaminate import words
    from snipquarry.llm.queries import QUERIES

    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    texts = {r.doc_id: set(words((r.text or "").encode())) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r.doc_id in labels}
    found = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, folder).collect()}
    held = [d for d in texts if found[d].held_out]
    seen = [Counter(), Counter()]
    for d in texts:
        if not found[d].held_out:
            seen[labels[d]].update(texts[d])
    odds = {w: math.log((n + 0.5) / (seen[0][w] + 0.5)) for w, n in seen[1].items()}
    y = np.array([labels[d] for d in held])
    plain = _area(np.array([max((odds.get(w, 0) for w in texts[d]), default=0) for d in held]), y)
    own = _area(np.array([found[d].score for d in held]), y)
    assert own >= plain > 0.9
    sure = {w for w, n in seen[1].items() if n >= 50 and not seen[0][w]}
    with_sure = [d for d in held if texts[d] & sure]
    assert len(with_sure) > 40 and sum(found[d].predicted for d in with_sure) >= 0.95 * len(with_sure)
    called = np.array([found[d].predicted for d in held])
    assert called[y == 1].mean() > 0.85 and called[y == 0].mean() < 0.015

"""Phrase collocations against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from snipquarry.llm import phrases


def brute(rows, lengths, threshold, share, most):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for size in range(1, lengths[1] + 1):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i:i + size])] += 1
    found = {k: a for k, a in f.items() if a >= threshold and lengths[0] <= len(k[1])}
    out = {}
    for (lang, w), a in found.items():
        covers = [b for (other, v), b in found.items() if other == lang and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= share * a for b in covers):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
        for lang, many in out.items() for i, (s, a, p, l, r) in enumerate(sorted(many)[:most])
    }


def table(spark, rows, parts):
    return spark.createDataFrame([(1, *r, 5, "clash") for r in rows], "doc_id int, lang string, text string, n int, word string").repartition(parts)


def texts(seed, many):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(many):
        w = [f"w{x}" for x in rng.zipf(1.4, rng.integers(0, 120)) % 60]
        for at in range(0, len(w), 7):
            w[at] += ",.;\n\t"[rng.integers(5)]
        rows.append((["en", "de", None, "und"][rng.integers(4)] if i % 3 else "en", " ".join(w)))
    return rows


ODD = [("en", None), (None, ""), ("fr", ".,;"), ("fr", "Ab\tAB  ab. " * 20), ("en", "long\x0bpiece " * 30_000), ("é", "\x00 ü\x85Ü " * 15), ("fr", "a b c " * 9_000)]


@pytest.mark.parametrize("lengths, threshold, share, shards", [((2, 3), 10, 50, 4), ((2, 4), 4, 90, 2), ((3, 3), 3, 50, 3), ((2, 2), 5, 50, 1)])
def test_as_brute_force(spark, lengths, threshold, share, shards, monkeypatch):
    # Small rows, so that the shards hold many of them.
    monkeypatch.setattr(phrases, "CHUNK_TOKENS", 200)
    monkeypatch.setattr(phrases, "ROUND_TOKENS", 1000)
    rows = texts(0, 150) + ODD + [("en", "a passage of words that many texts share. the end")] * 70
    got = phrases.collocations(table(spark, rows, 5), lengths, threshold, share, 40, shards)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == brute(rows, lengths, threshold, share, 40)


def test_full_filters_only_cost_work(spark, monkeypatch):
    # All bits of the filters get set: more phrases are counted, and each still once a shard.
    monkeypatch.setattr(phrases, "CHUNK_TOKENS", 100)
    monkeypatch.setattr(phrases.Filter, "has", lambda self, h: np.ones(len(h), bool))
    rows = texts(1, 80)
    got = phrases.collocations(table(spark, rows, 3), most=30)
    assert {tuple(r) for r in got.collect()} == brute(rows, (2, 3), 10, 50, 30)


def test_another_seed_where_words_share_a_hash(spark, monkeypatch):
    rows, good = texts(2, 30), phrases._stored

    def stored(documents, shards, seed):
        made = good(documents, shards, seed)
        if seed == 0:
            bad = made.filter("h IS NOT NULL").limit(1).selectExpr("shard", "tokens", "h", "lang", "'other' AS word", "n")
            made = made.unionByName(bad)
        return made

    monkeypatch.setattr(phrases, "_stored", stored)
    got = phrases.collocations(table(spark, rows, 2), most=30)
    assert {tuple(r) for r in got.collect()} == brute(rows, (2, 3), 10, 50, 30)


def test_workers_forget_words(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD_WORDS", 20)
    monkeypatch.setattr(phrases, "CHUNK_TOKENS", 500)
    rows = texts(3, 60)
    got = phrases.collocations(table(spark, rows, 2), most=30)
    assert {tuple(r) for r in got.collect()} == brute(rows, (2, 3), 10, 50, 30)


def test_empty(spark):
    assert phrases.collocations(table(spark, ODD, 1).limit(0)).count() == 0
    assert phrases.collocations(table(spark, [("en", None), ("de", "...")], 1)).count() == 0

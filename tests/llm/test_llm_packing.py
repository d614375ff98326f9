import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from snipquarry.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "  \n ", "It's THEY'LL don't 'd 12 3a4", "Ererß, Straße! ÀÉÎ éà ñ ¿qué? Æ µ ª", "á ë  x y\x1cz",
    "<|endoftext|> <|startoftext|>x <|endoftext|", "İstanbul ΣΑΣ ς 中文字 🙂🙂", "words " * 5000, "x" * 9000, "|a|b| 'tis re've",
]


def test_tokens_are_those_of_the_tokenizer(spark):
    whole = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {}
    for r in packing.tokenised(docs, PATH, size=512).collect():
        got[r.doc_id, r.piece] = (r.start, r.length, np.frombuffer(r.ids, "<u4").tolist())
    for i, text in enumerate(TEXTS):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 512)):
            part = ids[start:start + 512]
            assert got.pop((i, piece)) == (start, len(part), part)
    assert not got


def _check(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packs_near_the_bound(spark):
    rng = np.random.default_rng(1)
    lengths = np.concatenate([rng.integers(1, 101, 900), np.full(400, 37)]).tolist()
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id bigint, length bigint")
    rows = packing.pack(pieces, size=100, shard=128).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == [(i, n) for i, n in enumerate(lengths)]
    whole = np.empty(len(lengths), np.int32)
    packing.best_fit(lengths, np.argsort(-np.array(lengths), kind="stable"), whole, [], 100)
    assert _check(rows, 100) <= 1.01 * (whole.max() + 1)


def test_what_cannot_be_joined_and_repeated_rows(spark):
    pieces = spark.createDataFrame([(1, 60)] * 300, "doc_id bigint, length bigint")
    assert _check(packing.pack(pieces, size=100, shard=64).collect(), 100) == 300
    assert packing.pack(pieces.limit(0), size=100).count() == 0


def test_lengths_out_of_range_fail(spark):
    with pytest.raises(Exception, match="1 to size"):
        packing.pack(spark.createDataFrame([(1, 101)], "doc_id bigint, length bigint"), size=100).collect()


def test_children_hold_every_item_once():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 60, 200)
    members = packing.evolve(lengths, [], [1, 2, 3], 100, 4, 0)
    mother, father = packing._start(lengths, rng, False, 100), members[0]
    for _ in range(20):
        child = packing.cross(lengths, mother, father, rng, 100)
        assert np.bincount(child, weights=lengths).max() <= 100
        assert len(child) == 200 and child.min() == 0
        mother = child
    best = packing.evolve(lengths, members, [1, 2, 4], 100, 4, 10)[0]
    assert packing._worth(lengths, best) <= packing._worth(lengths, members[0])
    assert zlib.crc32(best.tobytes()) == zlib.crc32(packing.evolve(lengths, members, [1, 2, 4], 100, 4, 10)[0].tobytes())

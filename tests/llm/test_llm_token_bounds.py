"""Ids do not depend on how many words a worker keeps."""

import public_tokenizers

from snipquarry.llm import packing


def test_few_known_words(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["One, two! three four five.", "don't stop: one two 3 four", None, "", "Ünïcode words und 漢字 one"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, got = packing.tokenised(docs, path).collect(), packing.tokenised(docs, path, most_words=2, most_pieces=2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 15

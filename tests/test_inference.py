"""Embedding, generation and suggestions."""

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from snipquarry.functions import text
from snipquarry.operators import inference, vectors


def test_batched_model_keeps_order(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(["first", "second", "third"] * 30)], "i int, text string")

    def load():
        return lambda values: np.stack([np.full(16, len(str(v)) / 10) for v in values]).astype(np.float32)

    model = inference.batched_model(load, T.ArrayType(T.FloatType()))
    rows = inference.embed(df, model).collect()
    assert all(len(r.embedding) == 16 and abs(r.embedding[0] - len(r.text) / 10) < 1e-6 for r in rows)


def test_hash_provider(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,), (" \x1c ",)], "text string")
    got = [r.embedding for r in inference.embed(df, inference.hash_provider(dim=16)).collect()]
    by_sum = sorted(-1 if e is None else sum(e) for e in got)
    assert by_sum == [-1, 0, 0, 3] and {len(e) for e in got if e is not None} == {16}


def test_token_limit_of_the_embedding(spark):
    df = spark.createDataFrame([("a " * 600,)], "text string")
    assert sum(inference.embed(df, inference.hash_provider(dim=4)).first().embedding) == 600
    assert sum(inference.embed(df, inference.hash_provider(dim=4, max_tokens=512)).first().embedding) == 512


def test_instructions_and_prompts(spark):
    df = spark.createDataFrame([("t", "i"), ("t", ""), ("t", None)], "t string, i string")
    got = [r[0] for r in df.select(text.instruct(F.col("t"), F.col("i"))).collect()]
    assert got == ["Instruct: i\nQuery: t", "t", "t"]
    prompt = df.limit(1).select(text.fix_prompt(F.lit("x {y}"), F.lit("lint"), F.lit("d"))).first()[0]
    assert prompt == (
        "You are a code review expert. Fix the following lint issue:\n\nIssue: d\n\nCode:\n```\nx {y}\n```\n\n"
        "Provide ONLY the fixed code without explanations."
    )


def test_answer_from_the_prompt(spark):
    df = spark.createDataFrame([("a\n```\n x \n\ty\n```\nb",), (" plain ",), ("``` open",)], "prompt string")
    rows = inference.generate(df).collect()
    assert [r.generated_text for r in rows] == ["x \n\ty", "plain", "``` open"]
    assert [r.tokens_used for r in rows] == [2, 1, 2]


def test_unknown_task(spark):
    df = spark.createDataFrame([(1, 0, "x")], "request_id int, position int, text string")
    with pytest.raises(ValueError):
        inference.batch_infer(df, "other")


def test_suggestions(spark):
    snippets = spark.createDataFrame([("s1", "code"), ("s2", "security")], "id string, content string")
    asked = spark.createDataFrame(
        [("s1", "Security", "d1"), ("s1", "Security", "d1"), ("s1", "invalid_type", "d"), ("nonexistent-id", "lint", "d"), ("s2", "lint", "d2")],
        "snippet_id string, issue_type string, issue_description string",
    )
    rows = inference.suggest(asked, snippets).orderBy("snippet_id").collect()
    assert [(r.snippet_id, r.issue_type, r.model_confidence) for r in rows] == [("s1", "Security", 0.8), ("s2", "lint", 0.8)]
    assert [r.suggested_fix for r in rows] == ["code", "security"]
    assert [r.snippet_id for r in inference.unknown_snippets(asked, snippets).collect()] == ["nonexistent-id"]
    assert [r.issue_type for r in inference.split_issues(asked)[1].collect()] == ["invalid_type"]


def test_pooling_without_any_mask(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [3.0, 6.0], 1), (1, [100.0, 100.0], 0), (2, [5.0, 5.0], 0)]
    df = spark.createDataFrame(rows, "id int, vec array<float>, mask int")
    assert {r.id: r.embedding for r in vectors.mean_pool(df).collect()} == {1: [2.0, 4.0], 2: [0.0, 0.0]}


def test_limits_in_bytes(spark):
    rows = [("a", "é" * 3, [1.0, 2.0]), ("b", "é" * 2, [1.0]), (None, "x", [0.0, 0.0]), ("c", None, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, file_path string, embedding array<float>")
    checked = vectors.validate(df, dim=2, limits={"id": 5, "file_path": 5})
    assert [r.reasons for r in checked.collect()] == [["file_path"], ["embedding"], ["id"], ["file_path"]]
    accepted, rejected = vectors.split_valid(checked)
    assert accepted.count() == 0 and rejected.count() == 4

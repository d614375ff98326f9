"""Embedding and text generation over DataFrames, with pluggable models.

An embedding provider maps a text column to a vector column, a generation provider maps a
prompt column to a text column.  `batched_model` makes either from a plain Python function
that is loaded once per worker and called with batches.
"""

from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F, types as T

from snipquarry import settings
from snipquarry.functions import keys, text
from snipquarry.functions.keys import suggestion_key
from snipquarry.plans.numbering import number_in_group
from snipquarry.plans.scratch import written
from snipquarry.plans.skew import first_per_key, salted_join
from snipquarry.plans.size import spread

Provider = Callable[[Column], Column]


# Bytes of texts that are cut into tokens at once, and tokens whose place a worker keeps.
TOKEN_BYTES = 2 * 1024 * 1024
KNOWN_TOKENS = 250_000


def _slices(texts, most_bytes):
    """The texts in pieces of about `most_bytes`, at least one text each."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        until = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield start, texts.slice(start, until - start)
        start = until


def _token_counts(dim, max_tokens=None, memory=KNOWN_TOKENS, slice_cells=4_000_000, slice_bytes=TOKEN_BYTES):
    """Function from an Arrow array of texts to token counts by hashed token, one row per text.

    A few texts at a time are cut into tokens, whatever the size of the array."""
    from hashlib import md5

    places = {}

    def place(token):
        if token not in places:
            if len(places) >= memory:
                places.clear()
            # Empty tokens stand before and after white space at the ends of a text.
            places[token] = int(md5(token.encode()).hexdigest()[:7], 16) % dim if token else -1
        return places[token]

    def count(texts):
        out = np.empty((len(texts), dim), np.float32)
        for start, part in _slices(texts, slice_bytes):
            fill(part, out[start:start + len(part)])
        return out

    def fill(texts, out):
        words = pc.utf8_split_whitespace(texts)
        lengths = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False)
        encoded = words.flatten().dictionary_encode()
        known = np.array([place(t) for t in encoded.dictionary.to_pylist()], np.int64)
        column = known[encoded.indices.to_numpy()] if len(known) else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(texts)), lengths)
        row, column = row[column >= 0], column[column >= 0]
        if max_tokens is not None:
            first = np.arange(len(row)) - np.searchsorted(row, row, side="left") < max_tokens
            row, column = row[first], column[first]
        step = max(1, slice_cells // dim)
        for start in range(0, len(texts), step):
            part = out[start:start + step]
            low, high = np.searchsorted(row, [start, start + len(part)])
            cells = (row[low:high] - start) * dim + column[low:high]
            part[:] = np.bincount(cells, minlength=part.size).reshape(part.shape)

    return count


def hash_provider(dim=settings.EMBEDDING_DIM, max_tokens=None) -> Provider:
    """Stand-in embedding without a model: token counts by the token's hash.

    Needs no shuffle: each row is embedded where it is.  Empty texts give zeros, NULL gives NULL.
    """
    counts = None

    def embed(values: pa.Array) -> pa.Array:
        nonlocal counts
        counts = counts or _token_counts(dim, max_tokens)
        present = values.is_valid().to_numpy(zero_copy_only=False)
        rows = counts(values.drop_null())
        ends = np.concatenate([[0], np.cumsum(present * dim)]).astype(np.int32)
        offsets = pa.array(ends, mask=np.append(~present, False))
        return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))

    return lambda column: F.arrow_udf(embed, T.ArrayType(T.FloatType()))(column)


def batched_model(load: Callable, result: T.DataType, batch_size=16) -> Provider:
    """Provider from `load() -> predict(numpy array of texts) -> array of results`."""
    model = predict_batch_udf(load, return_type=result, batch_size=batch_size)
    return lambda column: model(column)


def hash_model(dim=settings.EMBEDDING_DIM):
    """`load` function of the hashing stand-in, for `batched_model`."""

    def load():
        count = _token_counts(dim)
        return lambda values: count(pa.array([str(v) for v in values], pa.string()))

    return load


def split_texts(rows: DataFrame, text_col="text"):
    """(usable, rejected) rows: a NULL or empty text cannot be embedded."""
    empty = F.coalesce(F.col(text_col), F.lit("")) == ""
    return rows.filter(~empty), rows.filter(empty).withColumn("reason", F.lit("Either 'text' or 'texts' required"))


def embed(rows: DataFrame, provider: Provider, text_col="text", instruction: Column | None = None) -> DataFrame:
    """Add the `embedding` of each row's text, wrapped in its instruction if there is one."""
    value = F.col(text_col) if instruction is None else text.instruct(F.col(text_col), instruction)
    return spread(rows).withColumn("embedding", provider(value))


def fenced_provider(prompt: Column) -> Column:
    """Stand-in generator without a model: the code that the prompt holds between fences, or all of it."""
    inside = F.regexp_extract(prompt, r"(?s)```\n(.*)\n```", 1)
    return F.when(inside != "", inside).otherwise(prompt)


def generate(rows: DataFrame, provider: Provider = fenced_provider, prompt_col="prompt") -> DataFrame:
    """Add `generated_text`, without white space around it, and its `tokens_used`."""
    answered = rows.withColumn("generated_text", text.strip(provider(F.col(prompt_col))))
    return answered.withColumn("tokens_used", text.token_count(F.col("generated_text")))


def batch_infer(
    requests: DataFrame, task: str, embedder: Provider | None = None,
    generator: Provider = fenced_provider, group=("request_id",), order=("position",), slot=None,
) -> DataFrame:
    """Results of batch requests: one row per text with its zero-based `id` in the request.

    `slot` cuts large requests for numbering, see `number_in_group`.
    """
    if task not in ("embeddings", "completions"):
        raise ValueError(f"task must be embeddings or completions, not {task!r}")
    slot = F.floor(F.col(order[0]) / 4096) if slot is None else slot
    numbered = number_in_group(requests, list(group), list(order), slot, "id")
    if task == "embeddings":
        result = (embedder or hash_provider())(F.col("text")).alias("embedding")
    else:
        result = text.strip(generator(F.col("text"))).alias("text")
    return numbered.select(*group, "id", result)


def batch_totals(requests: DataFrame, group=("request_id",), text_col="text") -> DataFrame:
    """Number of texts and of white-space tokens of each request."""
    return requests.groupBy(*group).agg(
        F.count(F.lit(1)).alias("batch_size"),
        F.sum(text.token_count(F.col(text_col))).alias("tokens_used"),
    )


def split_issues(requests: DataFrame):
    """(valid, rejected) suggestion requests by issue type, in any case."""
    ok = text.valid_issue_type(F.col("issue_type"))
    reason = "Invalid issue_type. Must be one of: " + ", ".join(settings.ISSUE_TYPES)
    return requests.filter(ok), requests.filter(~ok).withColumn("reason", F.lit(reason))


def fix_prompts(requests: DataFrame, snippets: DataFrame) -> DataFrame:
    """Distinct requests for known snippets, with the `prompt` for a fix."""
    source = snippets.select(F.col("id").alias("snippet_id"), "content")
    known = salted_join(requests.distinct(), source, ["snippet_id"], requests.columns)
    prompt = text.fix_prompt(F.col("content"), F.col("issue_type"), F.col("issue_description"))
    return known.withColumn("prompt", prompt).drop("content")


def unknown_snippets(requests: DataFrame, snippets: DataFrame) -> DataFrame:
    """Distinct requests whose snippet does not exist."""
    ids = snippets.select(F.col("id").alias("snippet_id"))
    return salted_join(requests.distinct(), ids, ["snippet_id"], requests.columns, "left_anti")


def suggest(
    requests: DataFrame, snippets: DataFrame, provider: Provider = fenced_provider,
    confidence=settings.CONFIDENCE, as_of=None,
) -> DataFrame:
    """Suggestion records for valid requests about known snippets; a repeated request has one record."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    key = [F.col(c) for c in ("snippet_id", "issue_type", "issue_description")]
    valid, _ = split_issues(requests.select(*key))
    answered = generate(fix_prompts(valid, snippets), provider)
    return answered.select(
        keys.stable_id(*key).alias("id"),
        *key,
        F.col("generated_text").alias("suggested_fix"),
        F.lit(float(confidence)).alias("model_confidence"),
        now.alias("created_at"),
    )


def suggest_once(requests: DataFrame, snippets: DataFrame, cache: DataFrame, **options) -> DataFrame:
    """Records only for requests that no live cache entry answers, one per cache key.

    Requests with the same snippet and issue type share their answer, whatever their
    description: the first (by `requested_at`) is generated.
    """
    from snipquarry.operators.cache import lookup

    keyed = requests.withColumn("key", suggestion_key(F.col("snippet_id"), F.col("issue_type")))
    missed = lookup(keyed, cache, ts="requested_at", spread=["issue_description"]).filter("value IS NULL")
    first = first_per_key(missed.select(*keyed.columns), ["key"], ["requested_at", "issue_description"])
    return suggest(written(first.drop("key"), "requests"), snippets, **options)


# Wording of our own: there is no fixed template for answers from retrieved context.
CONTEXT_PROMPT = "Answer from the sources below.\n\n{context}\n\nQuestion: {question}"


def context_prompts(queries: DataFrame, results: DataFrame, confidence=settings.CONFIDENCE) -> DataFrame:
    """Prompt with the retrieved snippets of each query (query_id, question), and its sources.

    Sources are path and line range, in rank order.  A query has at most the maximum k results.
    """
    source = F.concat(
        F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"),
        F.col("end_line").cast("string"),
    )
    ranked = F.array_sort(F.collect_list(F.struct("rank", source.alias("source"), "content")))
    grouped = results.groupBy("query_id").agg(ranked.alias("_hits"))
    block = F.transform("_hits", lambda h: F.concat(F.lit("["), h.source, F.lit("]\n"), h.content))
    filled = text.fill(CONTEXT_PROMPT, context=F.array_join(block, "\n\n"), question=F.col("question"))
    return queries.join(grouped, "query_id").select(
        "query_id",
        filled.alias("prompt"),
        F.transform("_hits", lambda h: h.source).alias("sources"),
        F.lit(float(confidence)).alias("confidence"),
    )

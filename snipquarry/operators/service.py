"""Answer search requests the way a cached search service does."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from snipquarry import schemas, settings
from snipquarry.functions import keys, scores
from snipquarry.operators import cache as entries_cache, inference
from snipquarry.operators.search import RESULT_FIELDS, responses, scoped_topk, with_snippets
from snipquarry.plans.keys import marked_likely
from snipquarry.plans.scratch import noted, remove_scratch, written, written_once
from snipquarry.plans.skew import first_per_key, hot_keys, salted_join
from snipquarry.sources.store import Store

# Bytes of texts that a task sorts when it writes rows with their texts.
PIECE_BYTES = 128 * 1024 * 1024


def results_type(snippets: DataFrame) -> T.ArrayType:
    """Type of the result list of a response."""
    row = T.StructType().add("rank", T.IntegerType()).add(snippets.schema["id"])
    for name in RESULT_FIELDS:
        if name in snippets.columns:
            row = row.add(snippets.schema[name])
    return T.ArrayType(row.add("score", T.DoubleType()))


def _answered_by(marked: DataFrame, ttl, id: str, columns: list[str]) -> DataFrame:
    """(id, columns, hit, _first) of stored rows (id, key, requested_at, hit): the id of the miss that
    answers a row, which is the last of its key until then.

    Misses of a key are at least `ttl` apart, so of slices of time that long each has one at most, and
    that of a hit is in its own slice or in the one before.  So a hit looks up one row of (key,
    slice), and no key's requests have to be together.
    """
    at, step = F.unix_micros(F.col("requested_at").cast("timestamp")), int(ttl or settings.SEARCH_TTL_SECONDS) * 1_000_000
    slice_ = ((at - F.pmod(at, F.lit(step))) / step).cast("long")
    # Requests without a key have one in common; no other is empty.
    marked = marked.withColumns({"key": F.coalesce("key", F.lit("")), "_slice": slice_})
    own = marked.filter("NOT hit").select("key", "_slice", F.struct(at.alias("at"), F.col(id).alias("id")).alias("_miss"))
    each = own.withColumn("_later", F.explode(F.array(F.lit(0), F.lit(1))))
    known = each.groupBy("key", (F.col("_slice") + F.col("_later")).alias("_slice")).agg(
        F.max(F.when(F.col("_later") == 0, F.col("_miss"))).alias("_own"), F.max(F.when(F.col("_later") == 1, F.col("_miss"))).alias("_before"),
    )
    found = salted_join(written(marked, "sliced"), written(known, "misses_by_slice"), ["key", "_slice"], [id], "left")
    first = F.when(~F.col("hit"), F.col(id)).when(F.col("_own.at") <= at, F.col("_own.id")).otherwise(F.col("_before.id"))
    return written(found.select(id, *columns, "hit", first.alias("_first")), "answered_by")


def retrieve(
    requests: DataFrame, cache: DataFrame, vectors: DataFrame, snippets: DataFrame, provider,
    ttl=settings.SEARCH_TTL_SECONDS, include_k=False, **options,
) -> tuple[DataFrame, DataFrame]:
    """(responses, new cache entries) for requests (query_id, query, k, repo_id, requested_at).

    A live cache entry answers a request.  Of the others, the first of each key is searched, and
    then the first that comes `ttl` seconds or more after the last searched one; those in between
    get its answer, as if it had come from the cache.  Without `include_k` the key leaves out `k`,
    and so a searched request decides how many results those after it get.
    """
    key = keys.search_key(F.col("query"), F.col("repo_id"), F.col("k") if include_k else None)
    answer = T.StructType().add("results", results_type(snippets)).add("count", T.LongType())
    asked = requests.withColumn("key", key)
    looked_up = entries_cache.lookup(asked, cache, ts="requested_at", spread=["query_id"])
    looked_up = written(looked_up.select(*asked.columns, "value"), "lookups")

    missed = looked_up.filter("value IS NULL").drop("value")
    replayed = entries_cache.ttl_replay(missed, ttl, ts="requested_at", id="query_id").withColumnRenamed("id", "query_id")
    marked = written(missed.join(replayed, "query_id"), "misses")
    # What is asked again after its time to live is searched once: the answers are the same.
    same = keys.stable_id(F.col("query"), F.col("repo_id"), scores.clamp_k(F.col("k")))
    first = written(marked.filter("NOT hit").drop("hit").withColumn("_same", same), "searched")
    one = first.groupBy("_same").agg(F.min("query_id").alias("query_id"))
    asks = written(first.join(one, ["_same", "query_id"], "left_semi"), "asks")
    queries = asks.drop("_same").withColumn("embedding", provider(F.col("query")))
    vectors = vectors if "repo_id" in vectors.columns else vectors.withColumn("repo_id", F.lit(None).cast("string"))
    found = with_snippets(scoped_topk(queries, vectors, **options), snippets)
    answers = written(responses(asks.select("_same", "query_id").distinct(), found).select("_same", "results", F.col("count").cast("long")), "responses")
    searched = salted_join(first, answers, ["_same"], ["query_id"]).drop("_same")

    entries = entries_cache.search_entries(
        searched.withColumn("written_at", F.col("requested_at")), "written_at", ttl, include_k
    )
    hits = looked_up.filter("value IS NOT NULL").select(
        "query_id", "query", entries_cache.from_value(F.col("value"), answer).alias("_a"), F.lit(True).alias("cached")
    ).select("query_id", "query", "_a.results", "_a.count", "cached")
    asked_of = _answered_by(marked, ttl, "query_id", ["query"])
    by_first = first.select(F.col("query_id").alias("_first"), "_same")
    answered = written(salted_join(asked_of, by_first, ["_first"], ["query_id"]).drop("_first"), "answered")
    fresh = salted_join(answered, answers, ["_same"], ["query_id"]).select(
        "query_id", "query", "results", "count", F.col("hit").alias("cached")
    )
    return hits.unionByName(fresh), entries


def _text_id(text) -> Column:
    """Id of a text by what it holds; a missing text has the empty id."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def _suggested(requests: DataFrame, snippets: DataFrame, cache: DataFrame, provider: inference.Provider, ttl) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answered, generated, texts) for suggestion requests, see `suggest`.

    `answered` (request_id, text_id, cached) and `generated` (what was asked, generated_text, text_id, bytes) name their
    texts by id, and `texts` (text_id, suggested_fix) has each once: texts are sent and stored by text and not by request.
    """
    key = keys.suggestion_key(F.col("snippet_id"), F.col("issue_type"))
    valid, _ = inference.split_issues(requests)
    ids = snippets.select(F.col("id").alias("snippet_id"))
    asked = salted_join(written(valid, "valid"), ids, ["snippet_id"], ["request_id"], "left_semi").withColumn("key", key)
    # Only ids of values go through the lookup.
    held = cache.select("key", F.sha2("value", 256).alias("value"), "written_at", "expires_at")
    looked_up = entries_cache.lookup(written(asked, "asked"), held, ts="requested_at", spread=["request_id"])
    looked_up = written(looked_up.select(*asked.columns, "value"), "lookups")
    found = looked_up.filter("value IS NOT NULL")
    hits = found.select("request_id", F.concat(F.lit("cache:"), "value").alias("text_id"), F.lit(True).alias("cached"))
    ids = written(found.select(F.col("value").alias("_value")).distinct(), "hit_values")
    values = marked_likely(cache.select(F.sha2("value", 256).alias("_value"), "value"), ids, ["_value"], "_hit")
    value = entries_cache.from_value(F.col("value"), "suggested_fix string, model_confidence double")
    hit_texts = first_per_key(values.filter("_hit").drop("_hit"), ["_value"], ["value"]).select(
        F.concat(F.lit("cache:"), "_value").alias("text_id"), value["suggested_fix"].alias("suggested_fix")
    )

    missed = looked_up.filter("value IS NULL").drop("value")
    replayed = entries_cache.ttl_replay(missed, ttl, ts="requested_at", id="request_id").withColumnRenamed("id", "request_id")
    marked = written(missed.join(replayed, "request_id"), "misses")
    sources = snippets.select("id", "content")
    if dict(marked.dtypes)["snippet_id"] == dict(sources.dtypes)["id"]:
        # Of the snippets those are sent that a prompt needs.
        ids = written(marked.filter("NOT hit").select(F.col("snippet_id").alias("id")).distinct(), "asked_snippets")
        sources = marked_likely(sources, ids, ["id"], "_asked").filter("_asked").drop("_asked")
    prompts = inference.fix_prompts(marked.filter("NOT hit"), sources)
    generated = inference.generate(prompts, provider).drop("prompt", "tokens_used")
    size = F.coalesce(F.octet_length("generated_text"), F.lit(0)).cast("long")
    generated = written_once(generated.withColumns({"text_id": _text_id(F.col("generated_text")), "bytes": size}), "generated")
    # One row of each text.
    one = written(generated.groupBy("text_id").agg(F.min("request_id").alias("request_id")), "text_rows")
    some = marked_likely(generated.select("text_id", "request_id", F.col("generated_text").alias("suggested_fix")), one, ["text_id", "request_id"], "_one")
    texts = first_per_key(some.filter("_one"), ["text_id"], ["request_id"]).select("text_id", "suggested_fix")
    texts = written(texts.unionByName(hit_texts), "texts")

    asked_of = _answered_by(marked, ttl, "request_id", [])
    by_first = generated.select(F.col("request_id").alias("_first"), "text_id")
    fresh = salted_join(asked_of, by_first, ["_first"], ["request_id"]).select("request_id", "text_id", F.col("hit").alias("cached"))
    return written(hits.unionByName(fresh), "answered"), generated, texts


def suggest(
    requests: DataFrame, snippets: DataFrame, cache: DataFrame, provider: inference.Provider = inference.fenced_provider,
    ttl=settings.SUGGESTION_TTL_SECONDS, confidence=settings.CONFIDENCE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, new records, new cache entries) for suggestion requests
    (request_id, snippet_id, issue_type, issue_description, requested_at).

    Requests with an unknown type or snippet get no answer.  A live cache entry answers a
    request; of the others of a key (snippet and type) the first is generated, and then the first
    that comes `ttl` seconds or more after the last generated one.
    """
    answered, generated, texts = _suggested(requests, snippets, cache, provider, ttl)
    generated = generated.withColumnRenamed("generated_text", "suggested_fix")
    return _answers(answered, texts), _records(generated, confidence).drop("text_id", "bytes"), _entries(generated, confidence, ttl)


def _answers(answered: DataFrame, texts: DataFrame) -> DataFrame:
    return salted_join(answered, texts, ["text_id"], ["request_id"]).select("request_id", "suggested_fix", "cached")


def _records(generated: DataFrame, confidence) -> DataFrame:
    """Records of generated suggestions, with their texts or without."""
    id = keys.stable_id(F.col("snippet_id"), F.col("issue_type"), F.col("issue_description")).alias("id")
    own = [c for c in ("snippet_id", "issue_type", "issue_description", "suggested_fix", "text_id", "bytes") if c in generated.columns]
    return generated.select(id, *own, F.lit(float(confidence)).alias("model_confidence"), F.col("requested_at").alias("created_at"))


def _entries(generated: DataFrame, confidence, ttl) -> DataFrame:
    new = generated.select("key", "suggested_fix", F.lit(float(confidence)).alias("model_confidence"), F.col("requested_at").alias("written_at"))
    return entries_cache.entries(new, ["suggested_fix", "model_confidence"], "written_at", ttl)


def _with_texts(rows: DataFrame, texts: DataFrame, spread: list[str]) -> DataFrame:
    """Stored rows (text_id, bytes) with their texts, in as many partitions as keep the texts of one small enough to be sorted.

    Rows with one text are together, unless they are very many, so that a file can hold the text once.
    """
    spark = rows.sparkSession
    pieces = -(-(rows.agg(F.sum("bytes")).first()[0] or 0) // PIECE_BYTES)
    # Few texts are spread over the cores by Spark itself.
    parts = [pieces] if pieces > spark.sparkContext.defaultParallelism else []
    hot = F.broadcast(hot_keys(rows, ["text_id"]))
    salt = F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int")
    salted = rows.join(hot, "text_id", "left").withColumn("_salt", salt).drop("_parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    repeated = texts.join(hot, "text_id", "left").withColumn("_salt", every).drop("_parts")
    joined = salted.repartition(*parts, "text_id", "_salt").join(repeated.repartition(*parts, "text_id", "_salt").hint("merge"), ["text_id", "_salt"])
    return joined.drop("text_id", "_salt", "bytes")


def _last_entries(generated: DataFrame, texts: DataFrame, confidence, ttl) -> tuple[DataFrame, DataFrame]:
    """The last cache entry of each key, and the keys: texts are compared only where a key has several at its last time."""
    at = F.col("requested_at").cast("timestamp")
    last = F.max(F.struct(at.alias("at"), "text_id", "bytes")).alias("_last")
    other = F.min(F.struct((-F.unix_micros(at)).alias("at"), "text_id")).alias("_other")
    ends = generated.groupBy("key").agg(last, other).select(
        "key", F.col("_last.at").alias("requested_at"), "_last.text_id", "_last.bytes", (F.col("_last.text_id") != F.col("_other.text_id")).alias("_several"),
    )
    ends = written(ends, "last_entries")
    found = _entries(_with_texts(ends.filter("NOT _several").drop("_several"), texts, ["key"]), confidence, ttl)
    several = ends.filter("_several").select("key", F.col("requested_at").alias("_at"))
    if several.isEmpty():
        return found, ends.select("key")
    same = (F.col("key") == F.col("_key")) & (at == F.col("_at"))
    rows = generated.select("key", "requested_at", "text_id").join(several.withColumnRenamed("key", "_key"), same, "left_semi").distinct()
    rows = written(rows, "several_entries")
    chosen = entries_cache.current(_entries(salted_join(rows, texts, ["text_id"], ["key"]), confidence, ttl))
    return found.unionByName(chosen), ends.select("key")


def suggest_stored(
    store: Store, requests: DataFrame, snippets: DataFrame, provider: inference.Provider = inference.fenced_provider,
    ttl=settings.SUGGESTION_TTL_SECONDS, confidence=settings.CONFIDENCE,
) -> DataFrame:
    """Answers to suggestion requests from the entries in the table cache of a store, see `suggest`.

    New records go to the table suggestion_requests and new entries to the cache, in one commit; a
    record that is there already is replaced.  A file holds a text once, however many of its rows have it.
    """
    scratch = []
    with noted(scratch), store.change() as change:
        held = "cache" in change.tables
        cache = store.read("cache", change.version - 1) if held else requests.sparkSession.createDataFrame([], schemas.CACHE)
        answered, generated, texts = _suggested(requests, snippets, cache, provider, ttl)
        made = generated.drop("generated_text")
        records = _records(made, confidence)
        # Only records that come more than once are compared.
        twice = written(records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "repeated_records")
        marked = marked_likely(records, twice, ["id"], "_twice")
        some = first_per_key(marked.filter("_twice").drop("_twice"), ["id"], ["created_at"], last=True)
        chosen = written(marked.filter("NOT _twice").drop("_twice").unionByName(some), "chosen_records")
        records = schemas.conform(_with_texts(chosen, texts, ["id"]), schemas.SUGGESTION_REQUESTS)
        change.replace("suggestion_requests", records, chosen.select("id"), order=["id"], find_by=["id"], once=True)
        last, ends = _last_entries(made, texts, confidence, ttl)
        change.replace("cache", last, ends, order=["key"], find_by=["key"], once=True)
    # Answers are read from two of the tables.
    kept = [path for path in scratch if path.rsplit("/", 1)[1].rsplit("-", 1)[0] in ("answered", "texts")]
    remove_scratch(requests.sparkSession, [path for path in scratch if path not in kept])
    return _answers(answered, texts)

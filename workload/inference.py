"""Queries for texts, embeddings and suggestions."""

from pyspark.sql import functions as F, types as T

from snipquarry.functions import text
from snipquarry.operators import evaluation, inference
from workload.registry import SUGGESTION_REQUESTS, query, views

TOKENS = "regexp_extract_all({0}, '[^\\s\\x1c-\\x1f]+')"


def sql_text(value):
    """A text as an SQL literal."""
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in value.split("\n"))


@query("token_usage", f"""
SELECT conv_id, count(*) AS batch_size, sum(len({TOKENS.format('text')}))::BIGINT AS tokens_used
FROM conversations GROUP BY conv_id""")
def token_usage(spark, sf):
    return inference.batch_totals(views(spark, sf).conversations, group=["conv_id"])


@query("token_counts", f"SELECT doc_id, len({TOKENS.format('text')}) AS n FROM documents")
def token_counts(spark, sf):
    return views(spark, sf).documents.select("doc_id", text.token_count(F.col("text")).cast("long").alias("n"))


@query("truncate_tokens", f"""
SELECT doc_id, md5(array_to_string({TOKENS.format('text')}[1:512], ' ')) AS text_md5 FROM documents""")
def truncate_tokens(spark, sf):
    return views(spark, sf).documents.select("doc_id", F.md5(text.truncate_tokens(F.col("text"))).alias("text_md5"))


@query("strip_text", r"""
SELECT doc_id, md5(regexp_replace(text, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')) AS text_md5 FROM documents""")
def strip_text(spark, sf):
    padded = F.concat(F.lit(" \t\n\x1c"), "text", F.lit("\x1f \r\n"))
    return views(spark, sf).documents.select("doc_id", F.md5(text.strip(padded)).alias("text_md5"))


@query("instruct_text", """
SELECT conv_id, turn, md5(CASE WHEN role = 'user' THEN 'Instruct: ' || 'Find code for ' || conv_id
                               || chr(10) || 'Query: ' || text ELSE text END) AS text_md5
FROM conversations""")
def instruct_text(spark, sf):
    instruction = F.when(F.col("role") == "user", F.concat(F.lit("Find code for "), F.col("conv_id").cast("string")))
    wrapped = text.instruct(F.col("text"), F.coalesce(instruction, F.lit("")))
    return views(spark, sf).conversations.select("conv_id", "turn", F.md5(wrapped).alias("text_md5"))


def hashed_sql(table, ids):
    return f"""
WITH t AS (SELECT {ids}, unnest({TOKENS.format('text')}) AS token FROM {table}),
n AS (SELECT {ids}, ('0x' || md5(token)[1:7])::BIGINT % 64 AS place, count(*) AS n FROM t GROUP BY ALL),
m AS (SELECT {ids}, map_from_entries(list((place, n))) AS m FROM n GROUP BY {ids})
SELECT {ids}, array_to_string(list_transform(range(64), lambda i: coalesce(element_at(m, i)[1], 0)), ',') AS embedding
FROM {table} LEFT JOIN m USING ({ids})"""


def _as_text(vector):
    return F.array_join(F.transform(vector, lambda x: x.cast("long").cast("string")), ",")


@query("hash_embedding", hashed_sql("documents", "doc_id"))
def hash_embedding(spark, sf):
    rows = inference.embed(views(spark, sf).documents.select("doc_id", "text"), inference.hash_provider(dim=64))
    return rows.select("doc_id", _as_text("embedding").alias("embedding"))


@query("batch_embed", hashed_sql("conversations", "conv_id, turn"))
def batch_embed(spark, sf):
    model = inference.batched_model(inference.hash_model(dim=64), T.ArrayType(T.FloatType()))
    rows = inference.embed(views(spark, sf).conversations.select("conv_id", "turn", "text"), model)
    return rows.select("conv_id", "turn", _as_text("embedding").alias("embedding"))


@query("batch_infer_embeddings", hashed_sql("conversations", "conv_id, turn").replace(
    "SELECT conv_id, turn, array_to_string",
    "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS id, array_to_string"))
def batch_infer_embeddings(spark, sf):
    asked = views(spark, sf).conversations
    provider = inference.hash_provider(dim=64)
    done = inference.batch_infer(asked, "embeddings", embedder=provider, group=["conv_id"], order=["turn"])
    return done.select("conv_id", "id", _as_text("embedding").alias("embedding"))


def fenced_sql(prompt):
    inside = f"regexp_extract({prompt}, '(?s)```\\n(.*)\\n```', 1)"
    answer = f"CASE WHEN {inside} <> '' THEN {inside} ELSE {prompt} END"
    return f"regexp_replace({answer}, '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g')"


@query("batch_infer_completions", f"""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS id, {fenced_sql('text')} AS text
FROM conversations""")
def batch_infer_completions(spark, sf):
    asked = views(spark, sf).conversations
    return inference.batch_infer(asked, "completions", group=["conv_id"], order=["turn"])


@query("rejected_texts", """
SELECT conv_id, turn, 'Either ''text'' or ''texts'' required' AS reason FROM conversations WHERE role <> 'user'""")
def rejected_texts(spark, sf):
    asked = views(spark, sf).conversations.withColumn("text", F.when(F.col("role") == "user", F.col("text")))
    return inference.split_texts(asked)[1].select("conv_id", "turn", "reason")


@query("validate_issue_type", f"""
WITH {SUGGESTION_REQUESTS}
SELECT snippet_id, issue_type,
       CASE WHEN lower(issue_type) NOT IN ('security', 'lint', 'performance', 'style', 'refactor')
            THEN 'Invalid issue_type. Must be one of: security, lint, performance, style, refactor' END AS reason
FROM suggestion_requests""")
def validate_issue_type(spark, sf):
    valid, rejected = inference.split_issues(views(spark, sf).suggestion_requests)
    both = valid.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)
    return both.select("snippet_id", "issue_type", "reason")


PROMPTS = f"""{SUGGESTION_REQUESTS}, prompts AS (
  SELECT r.*, 'You are a code review expert. Fix the following ' || issue_type || ' issue:' || chr(10) || chr(10)
         || 'Issue: ' || issue_description || chr(10) || chr(10) || 'Code:' || chr(10) || '```' || chr(10)
         || text || chr(10) || '```' || chr(10) || chr(10)
         || 'Provide ONLY the fixed code without explanations.' AS prompt
  FROM suggestion_requests r JOIN documents ON doc_id = snippet_id)"""


@query("suggest_prompts", f"""
WITH {PROMPTS}
SELECT snippet_id, issue_type, md5(prompt) AS prompt_md5 FROM prompts""")
def suggest_prompts(spark, sf):
    v = views(spark, sf)
    prompts = inference.fix_prompts(v.suggestion_requests, v.snippets)
    return prompts.select("snippet_id", "issue_type", F.md5("prompt").alias("prompt_md5"))


@query("unknown_snippets", f"""
WITH {SUGGESTION_REQUESTS}
SELECT snippet_id, issue_description FROM suggestion_requests WHERE snippet_id NOT IN (SELECT doc_id FROM documents)""")
def unknown_snippets(spark, sf):
    v = views(spark, sf)
    return inference.unknown_snippets(v.suggestion_requests, v.snippets).select("snippet_id", "issue_description")


@query("generate_mock", f"""
WITH {PROMPTS}, g AS (SELECT snippet_id, issue_type, {fenced_sql('prompt')} AS generated_text FROM prompts)
SELECT *, len({TOKENS.format('generated_text')}) AS tokens_used FROM g""")
def generate_mock(spark, sf):
    v = views(spark, sf)
    done = inference.generate(inference.fix_prompts(v.suggestion_requests, v.snippets))
    return done.select("snippet_id", "issue_type", "generated_text", F.col("tokens_used").cast("long"))


SUGGESTIONS = f"""{PROMPTS}, suggestions AS (
  SELECT md5('=' || snippet_id || chr(1) || '=' || issue_type || chr(1) || '=' || issue_description) AS id,
         snippet_id, issue_type, issue_description, {fenced_sql('prompt')} AS suggested_fix,
         0.8::DOUBLE AS model_confidence
  FROM prompts WHERE lower(issue_type) IN ('security', 'lint', 'performance', 'style', 'refactor'))"""


@query("suggest_fixes", f"WITH {SUGGESTIONS}\nSELECT * FROM suggestions")
def suggest_fixes(spark, sf):
    v = views(spark, sf)
    return inference.suggest(v.suggestion_requests, v.snippets).drop("created_at")


@query("suggest_uncached", f"""
WITH {SUGGESTIONS},
cached AS (SELECT DISTINCT doc_id AS snippet_id FROM labels WHERE toxic = 1)
SELECT * FROM suggestions WHERE snippet_id NOT IN (SELECT snippet_id FROM cached)
QUALIFY row_number() OVER (PARTITION BY snippet_id, issue_type ORDER BY issue_description) = 1""")
def suggest_uncached(spark, sf):
    """Suggestions for all types of issue of documents that the cache has no answer for."""
    from snipquarry.functions.keys import suggestion_key

    v = views(spark, sf)
    at = F.lit("2024-01-01").cast("timestamp")
    requests = v.suggestion_requests.withColumn("requested_at", at)
    kinds = F.array_distinct(F.array("issue_type", F.lit("unused")))
    doc = requests.select("snippet_id", F.explode(kinds).alias("issue_type"))
    toxic = v.labels.filter("toxic = 1").select(F.col("doc_id").alias("snippet_id"))
    cache = doc.join(toxic, "snippet_id", "left_semi").distinct().select(
        suggestion_key(F.col("snippet_id"), F.col("issue_type")).alias("key"),
        F.lit("{}").alias("value"),
        (at - F.expr("INTERVAL 1 HOUR")).alias("written_at"),
        (at + F.expr("INTERVAL 23 HOURS")).alias("expires_at"),
    )
    return inference.suggest_once(requests, v.snippets, cache).drop("created_at")


EVENT_ISSUES = {"view": "lint", "click": "style", "signup": "Security", "purchase": "refactor", "error": "typo"}
ASKED = f"""asked AS (
  SELECT event_id, user_id AS snippet_id, epoch_us(ts) AS t, 'event ' || event_id AS issue_description, text,
         CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_ISSUES.items())} END AS issue_type
  FROM events JOIN documents ON doc_id = user_id WHERE event_type <> 'error'),
e AS (SELECT *, row_number() OVER (PARTITION BY snippet_id, issue_type ORDER BY t, event_id) AS rn FROM asked),
r AS (
  SELECT snippet_id, issue_type, rn, event_id, t AS a, event_id AS by_event FROM e WHERE rn = 1
  UNION ALL
  SELECT e.snippet_id, e.issue_type, e.rn, e.event_id, CASE WHEN e.t < r.a + 86400000000 THEN r.a ELSE e.t END,
         CASE WHEN e.t < r.a + 86400000000 THEN r.by_event ELSE e.event_id END
  FROM r JOIN e ON e.snippet_id = r.snippet_id AND e.issue_type = r.issue_type AND e.rn = r.rn + 1),
answered AS (
  SELECT r.*, e.issue_description, {fenced_sql("'x```' || chr(10) || text || chr(10) || '```'")} AS suggested_fix
  FROM r JOIN e USING (event_id))"""


@query("suggest_service", f"""
WITH RECURSIVE {ASKED}
SELECT 'answer' AS kind, event_id::VARCHAR AS id, md5(suggested_fix) AS fix_md5, event_id <> by_event AS cached, a AS at_us
FROM answered
UNION ALL
SELECT 'record', md5('=' || snippet_id || chr(1) || '=' || issue_type || chr(1) || '=' || issue_description), md5(suggested_fix), false, a
FROM answered WHERE event_id = by_event
UNION ALL
SELECT 'entry', 'suggestion:' || snippet_id || ':' || issue_type, md5(max(suggested_fix)), true, max(a) + 86400000000
FROM answered GROUP BY snippet_id, issue_type""")
def suggest_service(spark, sf):
    """Events as requests for suggestions about their user's document, answered in two runs from one
    store: answers with the time of the request that they were made for, the records, and the cache entries with their end."""
    from snipquarry.operators import service
    from snipquarry.operators.cache import from_value
    from snipquarry.plans.scratch import scratch_dir
    from snipquarry.sources.store import Store

    v, store = views(spark, sf), Store(spark, scratch_dir(spark, "store"))
    kind = F.create_map(*[F.lit(x) for pair in EVENT_ISSUES.items() for x in pair])[F.col("event_type")]
    requests = v.events.select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("snippet_id"), kind.alias("issue_type"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("issue_description"), F.col("ts").cast("timestamp").alias("requested_at"),
    )
    half = F.lit("2024-01-16").cast("timestamp")
    runs = [service.suggest_stored(store, part, v.snippets) for part in (requests.filter(F.col("requested_at") < half), requests.filter(F.col("requested_at") >= half))]
    us = F.unix_micros
    given = runs[0].unionByName(runs[1]).select("request_id", F.md5("suggested_fix").alias("fix_md5"), "cached")
    # A request that was not answered from the cache is the one that the following are answered by.
    records = store.read("suggestion_requests").select("id", "snippet_id", "issue_type", "suggested_fix", "created_at")
    made = requests.select("request_id", F.col("snippet_id").cast("string").alias("snippet_id"), "issue_type", "requested_at")
    near = given.join(made, "request_id").join(records.select("snippet_id", "issue_type", "created_at"), ["snippet_id", "issue_type"])
    at = near.filter(F.col("created_at") <= F.col("requested_at")).groupBy("request_id", "fix_md5", "cached").agg(F.max("created_at").alias("at"))
    entry = from_value(F.col("value"), "suggested_fix string, model_confidence double")["suggested_fix"]
    parts = [
        at.select(F.lit("answer").alias("kind"), F.col("request_id").cast("string").alias("id"), "fix_md5", "cached", us("at").alias("at_us")),
        records.select(F.lit("record").alias("kind"), "id", F.md5("suggested_fix").alias("fix_md5"), F.lit(False).alias("cached"), us("created_at").alias("at_us")),
        store.read("cache").select(F.lit("entry").alias("kind"), F.col("key").alias("id"), F.md5(entry).alias("fix_md5"), F.lit(True).alias("cached"), us("expires_at").alias("at_us")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("acceptance_rate", f"""
WITH {SUGGESTION_REQUESTS.replace('FROM labels', ', quality FROM labels')}
SELECT issue_type, count(*) AS n, round(avg(quality::DOUBLE), 6) AS acceptance_rate
FROM suggestion_requests GROUP BY issue_type""")
def acceptance_rate(spark, sf):
    log = views(spark, sf).suggestion_requests.withColumn(
        "accepted", F.col("issue_description").startswith("quality 1")
    )
    rates = evaluation.acceptance_rate(log)
    return rates.select("issue_type", "n", F.round("acceptance_rate", 6).alias("acceptance_rate"))

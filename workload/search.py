"""Search queries.  Every vector of the table is a query against all of them."""

from pyspark.sql import functions as F

from snipquarry import schemas
from snipquarry.operators import cache, cells, evaluation, inference, search, service
from snipquarry.plans.scratch import written
from workload.registry import SNIPPET_VECTORS, query, views

DIST = """list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),
  lambda z: (z[1] - z[2]) * (z[1] - z[2])))"""
PAIRS = f"""pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS query_label, b.label AS label, {DIST} AS distance
  FROM embeddings a, embeddings b),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs),
hits AS (SELECT * FROM ranked WHERE rank <= 5)"""


def _plain_hits(hits):
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "id", (F.round("distance", 6) + 0.0).alias("distance")
    )


HITS = "SELECT query_id, rank, id, round(distance, 6) + 0.0 AS distance FROM hits"


def topk_results(v, **options):
    hits = search.exact_topk(v.search_queries, v.vectors, **options)
    return search.with_snippets(hits, v.snippets)


@query("retrieve_topk", f"""
WITH {PAIRS}
SELECT query_id, rank, id, source AS repo_path, lang AS language, md5(text) AS content_md5,
       round(1 / (1 + distance), 6) AS score
FROM hits JOIN documents ON doc_id = id""".replace("source AS repo_path", "'src/f' || id || '.py' AS file_path"))
def retrieve_topk(spark, sf):
    return topk_results(views(spark, sf)).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "id", "file_path", "language",
        F.md5("content").alias("content_md5"), F.round("score", 6).alias("score"),
    )


@query("retrieve_topk_blocks", f"WITH {PAIRS}\n{HITS}")
def retrieve_topk_blocks(spark, sf):
    """The way for many queries: both sides meet in blocks."""
    v = views(spark, sf)
    return _plain_hits(search.exact_topk(v.search_queries, v.vectors, copy_rows=0, block_vectors=200, block_asks=150))


@query("retrieve_responses", f"""
WITH {PAIRS}
SELECT a.vec_id AS query_id, count(d.doc_id) AS "count",
       coalesce(string_agg(d.doc_id::VARCHAR, ',' ORDER BY rank) FILTER (d.doc_id IS NOT NULL), '') AS ids
FROM embeddings a LEFT JOIN hits h ON h.query_id = a.vec_id LEFT JOIN documents d ON d.doc_id = h.id
GROUP BY a.vec_id""")
def retrieve_responses(spark, sf):
    v = views(spark, sf)
    answered = search.responses(v.search_queries.select("query_id"), topk_results(v))
    ids = F.array_join(F.transform("results", lambda r: r.id.cast("string")), ",")
    return answered.select("query_id", F.col("count").cast("long"), F.coalesce(ids, F.lit("")).alias("ids"))


@query("retrieve_per_query_k", f"""
WITH {PAIRS}
SELECT query_id, rank, id, round(distance, 6) + 0.0 AS distance FROM ranked
WHERE rank <= least(greatest(query_id % 120 - 5, 1), 100)""")
def retrieve_per_query_k(spark, sf):
    v = views(spark, sf)
    queries = v.search_queries.withColumn("k", (F.col("query_id") % 120 - 5).cast("int"))
    return _plain_hits(search.exact_topk(queries, v.vectors))


@query("retrieve_scoped", f"""
WITH {SNIPPET_VECTORS}, q AS (
  SELECT id AS query_id, embedding, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN '' ELSE repo_id END AS scope
  FROM snippet_vectors),
pairs AS (
  SELECT query_id, b.id, {DIST} AS distance FROM q a JOIN snippet_vectors b
  ON coalesce(a.scope, '') = '' OR a.scope = b.repo_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs
         QUALIFY rank <= 5)
{HITS}""")
def retrieve_scoped(spark, sf):
    v = views(spark, sf)
    scope = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, "").otherwise(F.col("repo_id"))
    vectors = v.snippet_vectors.select("id", "repo_id", "embedding")
    queries = vectors.select(F.col("id").alias("query_id"), "embedding", scope.alias("repo_id"))
    return _plain_hits(search.scoped_topk(queries, vectors))


CELLS = f"""c AS (
  SELECT cell, list(m ORDER BY pos) AS embedding FROM (
    SELECT label AS cell, pos, avg(x) AS m FROM (
      SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
    GROUP BY label, pos) GROUP BY cell),
near AS (
  SELECT a.vec_id, b.cell, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.cell) AS place
  FROM embeddings a, c b),
ivf AS (
  SELECT p.vec_id AS query_id, b.vec_id AS id, {DIST} AS distance
  FROM near p JOIN embeddings a ON a.vec_id = p.vec_id
  JOIN near o ON o.cell = p.cell AND o.place = 1 JOIN embeddings b ON b.vec_id = o.vec_id
  WHERE p.place <= 3),
approx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM ivf
           QUALIFY rank <= 5)"""


def label_cells(v):
    """An inverted file with the labels' mean vectors as its cells, stored."""
    centroids = written(v.label_centroids, "centroids")
    return centroids, written(search.assign_cells(v.vectors, centroids), "cells")


def ivf_hits(v, **options):
    centroids, assigned = label_cells(v)
    return search.ivf_topk(v.search_queries, assigned, centroids, nprobe=3, **options)


@query("ivf_topk", f"WITH {CELLS}\n{HITS.replace('FROM hits', 'FROM approx')}")
def ivf_topk(spark, sf):
    return _plain_hits(ivf_hits(views(spark, sf)))


@query("ivf_topk_blocks", f"WITH {CELLS}\n{HITS.replace('FROM hits', 'FROM approx')}")
def ivf_topk_blocks(spark, sf):
    return _plain_hits(ivf_hits(views(spark, sf), copy_rows=0, block_vectors=40, block_asks=60))


@query("ivf_exact", f"WITH {PAIRS}\n{HITS}")
def ivf_exact(spark, sf):
    v = views(spark, sf)
    centroids, assigned = label_cells(v)
    return _plain_hits(search.cell_exact_topk(v.search_queries, assigned, centroids))


@query("ivf_recall", f"""
WITH {PAIRS}, {CELLS}
SELECT count(*) AS n_hits, round(avg(CASE WHEN x.id IS NULL THEN 0 ELSE 1 END), 6) AS recall
FROM hits h LEFT JOIN approx x ON x.query_id = h.query_id AND x.id = h.id""")
def ivf_recall(spark, sf):
    v = views(spark, sf)
    found = evaluation.overlap(ivf_hits(v), search.exact_topk(v.search_queries, v.vectors))
    return found.select("n_hits", F.round("recall", 6).alias("recall"))


@query("ivf_trained_exact", f"WITH {PAIRS}\n{HITS}")
def ivf_trained_exact(spark, sf):
    """Exact search over trained cells has the same hits whatever the cells are."""
    v = views(spark, sf)
    centroids = written(search.train_centroids(v.vectors, cells=16), "centroids")
    assigned = written(search.assign_cells(v.vectors, centroids), "cells")
    return _plain_hits(search.cell_exact_topk(v.search_queries, assigned, centroids))


@query("ivf_scoped", f"""
WITH {SNIPPET_VECTORS}, {CELLS.replace("FROM near p JOIN embeddings a ON a.vec_id = p.vec_id", "FROM near p JOIN embeddings a ON a.vec_id = p.vec_id JOIN snippet_vectors sa ON sa.id = p.vec_id").replace("WHERE p.place <= 3", "JOIN snippet_vectors sb ON sb.id = b.vec_id WHERE p.place <= 3 AND (p.vec_id % 3 <> 2 OR sa.repo_id = sb.repo_id)")}
{HITS.replace('FROM hits', 'FROM approx')}""")
def ivf_scoped(spark, sf):
    """Every third query only sees its own repository's part of its cells."""
    v = views(spark, sf)
    centroids, assigned = label_cells(v)
    repos = v.snippet_vectors.select("id", "repo_id")
    scope = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, "").otherwise(F.col("repo_id"))
    queries = v.snippet_vectors.select(F.col("id").alias("query_id"), "embedding", scope.alias("repo_id"))
    return _plain_hits(search.ivf_topk(queries, assigned.join(repos, "id"), centroids, nprobe=3))


def with_gaps(v):
    """Vectors, every seventh of them missing."""
    return v.vectors.withColumn("embedding", F.when(F.col("id") % 7 != 0, F.col("embedding")))


@query("ivf_topk_missing", f"""
WITH {CELLS.replace("WHERE p.place <= 3", "WHERE p.place <= 3 AND p.vec_id % 7 <> 0 AND b.vec_id % 7 <> 0")}
{HITS.replace('FROM hits', 'FROM approx')}""")
def ivf_topk_missing(spark, sf):
    v = views(spark, sf)
    centroids = written(v.label_centroids, "centroids")
    assigned = written(search.assign_cells(with_gaps(v), centroids), "cells")
    queries = with_gaps(v).withColumnRenamed("id", "query_id")
    return _plain_hits(search.ivf_topk(queries, assigned, centroids, nprobe=3))


@query("assign_missing", f"""
WITH {CELLS}
SELECT vec_id AS id, CASE WHEN vec_id % 7 <> 0 THEN cell END::BIGINT AS cell FROM near WHERE place = 1""")
def assign_missing(spark, sf):
    v = views(spark, sf)
    assigned = search.assign_cells(with_gaps(v), written(v.label_centroids, "centroids"))
    return assigned.select("id", F.col("cell").cast("long"))


RECALLED = "SELECT count(*) * least((SELECT count(*) FROM embeddings), 5) AS n_hits, true AS enough FROM embeddings"


def _recalled(v, found):
    """How many exact hits there are, and whether nine tenths of them were found."""
    figures = evaluation.overlap(found, search.exact_topk(v.search_queries, v.vectors))
    return figures.select("n_hits", (F.col("recall") >= 0.9).alias("enough"))


@query("ivf_trained_recall", RECALLED)
def ivf_trained_recall(spark, sf):
    v = views(spark, sf)
    centroids = search.train_centroids(v.vectors, cells=16)
    assigned = written(search.assign_cells(v.vectors, centroids), "cells")
    return _recalled(v, search.ivf_topk(v.search_queries, assigned, centroids, nprobe=12))


def _tree(v):
    return cells.build(v.vectors, coarse=8, cell_rows=20)


@query("ivf_tree_recall", RECALLED)
def ivf_tree_recall(spark, sf):
    v = views(spark, sf)
    return _recalled(v, cells.tree_topk(v.search_queries, _tree(v), nprobe=64, coarse_probe=8))


@query("ivf_tree_exact", f"WITH {PAIRS}\n{HITS}")
def ivf_tree_exact(spark, sf):
    """Exact search over two levels of cells opens few of them and has the same hits."""
    v = views(spark, sf)
    return _plain_hits(cells.tree_exact_topk(v.search_queries, _tree(v), nprobe=8, coarse_probe=3))


@query("eval_mrr_recall", f"""
WITH {PAIRS}, sizes AS (SELECT label, count(*) - 1 AS total FROM embeddings GROUP BY label),
q AS (
  SELECT query_id, min(CASE WHEN label = query_label AND id <> query_id THEN rank END) AS first,
         count_if(label = query_label AND id <> query_id) AS found, any_value(query_label) AS label
  FROM hits GROUP BY query_id)
SELECT count(*) AS n_queries, round(avg(coalesce(1 / first, 0)), 6) AS mrr,
       round(avg(CASE WHEN total > 0 THEN found / total END), 6) AS recall
FROM q JOIN sizes USING (label)""")
def eval_mrr_recall(spark, sf):
    v = views(spark, sf)
    labels = v.embeddings.select(F.col("vec_id").alias("id"), "label")
    judged = evaluation.judge_by_label(search.exact_topk(v.search_queries, v.vectors), labels)
    figures = evaluation.mrr_recall(judged, evaluation.totals_by_label(labels))
    return figures.select("n_queries", F.round("mrr", 6).alias("mrr"), F.round("recall", 6).alias("recall"))


HASHED = """hashed AS (
  SELECT kind, id, text, list_transform(range(64), lambda i: coalesce(element_at(m, i)[1], 0)::DOUBLE) AS embedding FROM (
    SELECT kind, id, any_value(text) AS text, map_from_entries(list((place, n))) AS m FROM (
      SELECT kind, id, any_value(text) AS text, ('0x' || md5(token)[1:7])::BIGINT % 64 AS place, count(*) AS n FROM (
        SELECT kind, id, text, unnest(regexp_extract_all(text, '[^\\s\\x1c-\\x1f]+')) AS token FROM texts)
      GROUP BY kind, id, place)
    GROUP BY kind, id))"""
TEXT_SEARCH = f"""texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'q', conv_id * 100000 + turn, text FROM conversations WHERE role = 'user'),
{HASHED},
pairs AS (
  SELECT a.id AS query_id, b.id, a.text AS question, {DIST} AS distance FROM hashed a, hashed b
  WHERE a.kind = 'q' AND b.kind = 'd'),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs
         QUALIFY rank <= 5)"""


def text_results(v):
    """Documents nearest to every user turn, by hashed tokens."""
    provider = inference.hash_provider(dim=64)
    asked = v.conversations.filter("role = 'user'").select(
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("query_id"), F.col("text").alias("question")
    )
    docs = v.snippets
    vectors = inference.embed(docs.select("id", "content"), provider, "content").select("id", "embedding")
    queries = inference.embed(asked, provider, "question")
    return asked, search.with_snippets(search.exact_topk(queries, vectors), docs)


@query("retrieve_cached", f"""
WITH {TEXT_SEARCH},
asked AS (
  SELECT conv_id * 100000 + turn AS query_id, conv_id, text AS question, 'all' AS scope FROM conversations WHERE role = 'user'),
stored AS (SELECT DISTINCT question FROM asked WHERE query_id % 100000 = 0),
found AS (
  SELECT query_id, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids FROM hits GROUP BY query_id)
SELECT a.query_id, CASE WHEN s.question IS NOT NULL THEN 0 ELSE coalesce(n, 0) END AS "count",
       CASE WHEN s.question IS NOT NULL THEN '' ELSE coalesce(ids, '') END AS ids,
       s.question IS NOT NULL OR row_number() OVER (PARTITION BY a.question ORDER BY a.query_id) > 1 AS cached
FROM asked a LEFT JOIN found f USING (query_id) LEFT JOIN stored s ON s.question = a.question""")
def retrieve_cached(spark, sf):
    """User turns as search requests, where first turns have an empty answer in the cache."""
    v = views(spark, sf)
    at = F.lit("2024-01-01").cast("timestamp")
    asked = v.conversations.filter("role = 'user'").select(
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"),
        F.lit(5).alias("k"), F.lit(None).cast("string").alias("repo_id"), at.alias("requested_at"),
    )
    empty = F.lit(None).cast(service.results_type(v.snippets))
    first = asked.filter("query_id % 100000 = 0").select(
        F.col("query"), F.col("repo_id"), empty.alias("results"), F.lit(0).alias("count"), at.alias("written_at")
    ).distinct()
    stored = cache.search_entries(first, "written_at")
    provider = inference.hash_provider(dim=64)
    vectors = inference.embed(v.snippets.select("id", "content"), provider, "content").select("id", "embedding")
    answered, _ = service.retrieve(asked, stored, vectors, v.snippets, provider)
    ids = F.array_join(F.transform("results", lambda r: r.id.cast("string")), ",")
    return answered.select("query_id", F.col("count").cast("long"), F.coalesce(ids, F.lit("")).alias("ids"), "cached")


# A user asks the first turn of the conversation of the same number again and again, or the type of the event without one.
QUESTIONS = """questions AS (
  SELECT event_id, epoch_us(ts) AS t, coalesce(c.text, event_type) AS question
  FROM events LEFT JOIN conversations c ON c.conv_id = user_id AND c.turn = 0 AND c.role = 'user')"""


@query("retrieve_cached_events", f"""
WITH RECURSIVE {QUESTIONS},
texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'q', min(event_id), question FROM questions GROUP BY question),
{HASHED},
pairs AS (SELECT a.text AS question, b.id, {DIST} AS distance FROM hashed a, hashed b WHERE a.kind = 'q' AND b.kind = 'd'),
hits AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY distance, id) AS rank FROM pairs QUALIFY rank <= 5),
found AS (SELECT question, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids FROM hits GROUP BY question),
e AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY t, event_id) AS rn FROM questions),
r AS (
  SELECT question, rn, event_id, t AS a, false AS cached FROM e WHERE rn = 1
  UNION ALL
  SELECT e.question, e.rn, e.event_id, CASE WHEN e.t < r.a + 3600000000 THEN r.a ELSE e.t END, e.t < r.a + 3600000000
  FROM r JOIN e ON e.question = r.question AND e.rn = r.rn + 1)
SELECT event_id AS query_id, n AS "count", ids, cached FROM r JOIN found USING (question)""")
def retrieve_cached_events(spark, sf):
    """Events as search requests at their own times, so that answers end with their hour to live."""
    v = views(spark, sf)
    first = v.conversations.filter("turn = 0 AND role = 'user'").select(F.col("conv_id").alias("user_id"), F.col("text").alias("_text"))
    asked = v.events.join(first, "user_id", "left").select(
        F.col("event_id").alias("query_id"), F.coalesce("_text", "event_type").alias("query"), F.lit(5).alias("k"),
        F.lit(None).cast("string").alias("repo_id"), F.col("ts").cast("timestamp").alias("requested_at"),
    )
    provider = inference.hash_provider(dim=64)
    vectors = inference.embed(v.snippets.select("id", "content"), provider, "content").select("id", "embedding")
    answered, _ = service.retrieve(asked, spark.createDataFrame([], schemas.CACHE), vectors, v.snippets, provider)
    ids = F.array_join(F.transform("results", lambda r: r.id.cast("string")), ",")
    return answered.select("query_id", F.col("count").cast("long"), F.coalesce(ids, F.lit("")).alias("ids"), "cached")


@query("search_text", f"""
WITH {TEXT_SEARCH}
SELECT query_id, rank, id, round(1 / (1 + distance), 6) AS score FROM hits""")
def search_text(spark, sf):
    _, results = text_results(views(spark, sf))
    return results.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


@query("rag_context", f"""
WITH {TEXT_SEARCH}, s AS (
  SELECT h.query_id, h.question, h.rank, d.text,
         'src/f' || d.doc_id || '.py:1-' || len(string_split(d.text, chr(10))) AS source
  FROM hits h JOIN documents d ON d.doc_id = h.id)
SELECT query_id, string_agg(source, ';' ORDER BY rank) AS sources, 0.8::DOUBLE AS confidence,
       md5('Answer from the sources below.' || chr(10) || chr(10)
           || string_agg('[' || source || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)
           || chr(10) || chr(10) || 'Question: ' || any_value(question)) AS prompt_md5
FROM s GROUP BY query_id""")
def rag_context(spark, sf):
    asked, results = text_results(views(spark, sf))
    prompts = inference.context_prompts(asked, results)
    return prompts.select(
        "query_id", F.array_join("sources", ";").alias("sources"), "confidence", F.md5("prompt").alias("prompt_md5")
    )

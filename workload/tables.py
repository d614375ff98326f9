"""Queries over repository, snippet and vector tables."""

from pyspark.sql import functions as F

from snipquarry.functions import paths
from snipquarry.operators import repositories, vectors
from snipquarry.plans.scratch import scratch_dir
from snipquarry.sources import tables
from snipquarry.sources.store import Store
from workload.files import jobs_of, jobs_sql
from workload.registry import (
    PURGE_LIST, REPOSITORIES, SNIPPET_VECTORS, SOURCE_REPOSITORIES, SUGGESTION_REQUESTS,
    query, views,
)


@query("repo_name", """
SELECT page_id, replace(string_split(url, '/')[-1], '.git', '') AS name FROM pages""")
def repo_name(spark, sf):
    return views(spark, sf).pages.select("page_id", paths.repo_name(F.col("url")).alias("name"))


@query("validate_repo_url", """
SELECT page_id, url, CASE WHEN NOT (url LIKE 'https://%' OR url LIKE '%.git') THEN 'Invalid repository URL' END AS reason
FROM pages""")
def validate_repo_url(spark, sf):
    valid, rejected = repositories.split_requests(views(spark, sf).pages.select("page_id", "url"))
    return valid.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)


def _registered(v):
    return repositories.register(v.index_requests, as_of="2024-06-01 00:00:00")


@query("dedup_repositories", f"""
WITH {REPOSITORIES}
SELECT id, name, url, project, 'pending' AS status, created_us FROM repositories""")
def dedup_repositories(spark, sf):
    rows = _registered(views(spark, sf))
    return rows.select("id", "name", "url", "project", "status", F.unix_micros("created_at").alias("created_us"))


@query("list_repositories", f"""
WITH {REPOSITORIES}
SELECT id, name, url, project, 'pending' AS status, -1::BIGINT AS last_indexed_us, created_us,
       (SELECT count(*) FROM repositories) AS total
FROM repositories ORDER BY created_us, id LIMIT 20 OFFSET 20""")
def list_repositories(spark, sf):
    page = repositories.list_repositories(_registered(views(spark, sf)), skip=20, limit=20)
    return page.select(
        "id", "name", "url", "project", "status", F.coalesce(F.unix_micros("last_indexed"), F.lit(-1)).cast("long").alias("last_indexed_us"),
        F.unix_micros("created_at").alias("created_us"), "total",
    )


@query("list_repositories_deep", f"""
WITH {REPOSITORIES}
SELECT id, name, url, project, 'pending' AS status, -1::BIGINT AS last_indexed_us, created_us,
       (SELECT count(*) FROM repositories) AS total
FROM repositories ORDER BY created_us, id LIMIT 20 OFFSET (SELECT count(*) * 9 // 10 FROM repositories)""")
def list_repositories_deep(spark, sf):
    """A page nine tenths down, of which only its own range of the table is read and sorted."""
    pages = repositories.Pages(_registered(views(spark, sf)).select(*repositories.LISTING), parts=16)
    return pages.page(sum(pages.counts) * 9 // 10, 20).select(
        "id", "name", "url", "project", "status", F.coalesce(F.unix_micros("last_indexed"), F.lit(-1)).cast("long").alias("last_indexed_us"),
        F.unix_micros("created_at").alias("created_us"), "total",
    )


@query("unique_violations", """
SELECT md5(text) AS embedding_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def unique_violations(spark, sf):
    rows = views(spark, sf).documents.select(F.md5("text").alias("embedding_id"))
    return repositories.unique_violations(rows, "embedding_id")


@query("lookup_found", """
SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels
WHERE doc_id IN (SELECT vec_id * 2 FROM embeddings)""")
def lookup_found(spark, sf):
    v = views(spark, sf)
    asked = v.embeddings.select((F.col("vec_id") * 2).alias("doc_id"))
    found = repositories.lookup_found(v.labels, asked, "doc_id")
    return found.select("doc_id", F.col("quality").cast("long"), F.col("toxic").cast("long"))


@query("lookup_missing", """
SELECT DISTINCT vec_id * 2 AS doc_id FROM embeddings
WHERE vec_id * 2 NOT IN (SELECT doc_id FROM labels)""")
def lookup_missing(spark, sf):
    v = views(spark, sf)
    asked = v.embeddings.select((F.col("vec_id") * 2).alias("doc_id"))
    return repositories.lookup_missing(v.labels, asked, "doc_id")


@query("repo_detail", f"""
WITH {SOURCE_REPOSITORIES}
SELECT r.id, r.name, r.url, count(d.doc_id) AS snippet_count
FROM source_repositories r LEFT JOIN documents d ON d.source = r.id GROUP BY ALL""")
def repo_detail(spark, sf):
    v = views(spark, sf)
    return repositories.repo_detail(v.source_repositories, v.snippets.select("id", "repo_id")).select(
        "id", "name", "url", "snippet_count"
    )


@query("snippet_repository", f"""
WITH {SOURCE_REPOSITORIES}
SELECT d.doc_id AS id, d.source AS repo_id, r.name AS repo_name, r.url AS repo_url
FROM documents d JOIN source_repositories r ON r.id = d.source""")
def snippet_repository(spark, sf):
    v = views(spark, sf)
    return repositories.with_repository(v.snippets.select("id", "repo_id"), v.source_repositories)


@query("repository_status", jobs_sql("""
SELECT r.id, j.status, CASE WHEN j.status = 'completed' THEN completed_us END AS last_indexed_us
FROM source_repositories r JOIN jobs j ON j.repo_id = r.id"""))
def repository_status(spark, sf):
    v = views(spark, sf)
    pending = v.source_repositories.withColumns({
        "status": F.lit("pending"),
        "last_indexed": F.lit(None).cast("timestamp"),
        "updated_at": F.lit("2024-01-01").cast("timestamp"),
    })
    rows = repositories.with_status(pending, jobs_of(v))
    return rows.select("id", "status", F.unix_micros("last_indexed").alias("last_indexed_us"))


@query("purge_repo", f"""
WITH {PURGE_LIST}, {SNIPPET_VECTORS}
SELECT id, repo_id FROM snippet_vectors WHERE repo_id NOT IN (SELECT repo_id FROM purge_list)""")
def purge_repo(spark, sf):
    v = views(spark, sf)
    return repositories.purge(v.snippet_vectors.select("id", "repo_id"), v.purge_list)


@query("cascade_delete", f"""
WITH {SOURCE_REPOSITORIES}, {PURGE_LIST}, {SUGGESTION_REQUESTS},
  suggestions AS (SELECT DISTINCT issue_description AS id, snippet_id FROM suggestion_requests)
SELECT 'repositories' AS tbl, id FROM source_repositories WHERE id NOT IN (SELECT repo_id FROM purge_list)
UNION ALL SELECT 'snippets', doc_id::VARCHAR FROM documents WHERE source NOT IN (SELECT repo_id FROM purge_list)
UNION ALL SELECT 'jobs', 'job-' || id FROM source_repositories WHERE id NOT IN (SELECT repo_id FROM purge_list)
UNION ALL SELECT 'suggestions', id FROM suggestions
UNION ALL SELECT 'dangling', id FROM suggestions WHERE snippet_id IN
  (SELECT doc_id FROM documents WHERE source IN (SELECT repo_id FROM purge_list))""")
def cascade_delete(spark, sf):
    v = views(spark, sf)
    repos = v.source_repositories
    jobs = repos.select(F.concat(F.lit("job-"), "id").alias("id"), F.col("id").alias("repo_id"))
    suggestions = v.suggestion_requests.select(F.col("issue_description").alias("id"), "snippet_id").distinct()
    snippets = v.snippets.select("id", "repo_id")
    left = repositories.cascade_delete(v.purge_list, repos, snippets, jobs, suggestions)
    parts = [t.select(F.lit(name).alias("tbl"), F.col("id").cast("string").alias("id")) for name, t in left.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("cascade_delete_stored", f"""
WITH {SOURCE_REPOSITORIES}, {PURGE_LIST}, {SNIPPET_VECTORS}
SELECT 'repositories' AS tbl, id FROM source_repositories WHERE id NOT IN (SELECT repo_id FROM purge_list)
UNION ALL SELECT 'snippets', doc_id::VARCHAR FROM documents WHERE source NOT IN (SELECT repo_id FROM purge_list)
UNION ALL SELECT 'jobs', 'job-' || id FROM source_repositories WHERE id NOT IN (SELECT repo_id FROM purge_list)
UNION ALL SELECT 'vectors', id::VARCHAR FROM snippet_vectors WHERE repo_id NOT IN (SELECT repo_id FROM purge_list)""")
def cascade_delete_stored(spark, sf):
    """The same as one commit of a store, which writes the removed ids only."""
    v, store = views(spark, sf), Store(spark, scratch_dir(spark, "store"))
    repos = v.source_repositories
    held = {
        "repositories": repos.select("id"),
        "jobs": repos.select(F.concat(F.lit("job-"), "id").alias("id"), F.col("id").alias("repo_id")),
        "snippets": v.snippets.select(F.col("id").cast("string").alias("id"), "repo_id"),
        "vectors": v.snippet_vectors.select(F.col("id").cast("string").alias("id"), "repo_id"),
    }
    with store.change() as change:
        for name, rows in held.items():
            change.append(name, rows)
    repositories.delete_stored(store, v.purge_list)
    left = [store.read(name).select(F.lit(name).alias("tbl"), "id") for name in held]
    return left[0].unionByName(left[1]).unionByName(left[2]).unionByName(left[3])


@query("embedding_records", f"""
WITH {SNIPPET_VECTORS}
SELECT id, repo_id, file_path, language, coalesce(function_name, '') AS function_name,
       coalesce(class_name, '') AS class_name, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line,
       round(list_sum(embedding::DOUBLE[]), 6) AS embedding_sum
FROM snippet_vectors""")
def embedding_records(spark, sf):
    records = vectors.embedding_records(views(spark, sf).snippet_vectors)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    numbers = [F.col(c).cast("long").alias(c) for c in ("start_line", "end_line")]
    return records.select(
        "id", "repo_id", "file_path", "language", "function_name", "class_name", *numbers,
        F.round(total, 6).alias("embedding_sum"),
    )


@query("insert_embeddings", f"""
WITH {SNIPPET_VECTORS}
SELECT repo_id, count(*) AS n, (SELECT count(*) FROM snippet_vectors) AS inserted
FROM snippet_vectors GROUP BY repo_id""")
def insert_embeddings(spark, sf):
    """Append the records to a table by repository, and read it back with the count of the write."""
    path = scratch_dir(spark, "vectors")
    inserted = tables.append(vectors.embedding_records(views(spark, sf).snippet_vectors), path, ["repo_id"], rebalance=True)
    stored = tables.read_table(spark, path)
    return stored.groupBy("repo_id").agg(F.count("*").alias("n"), F.lit(inserted).cast("long").alias("inserted"))


@query("validate_embeddings", f"""
WITH {SNIPPET_VECTORS}
SELECT id, concat_ws(',', CASE WHEN id IS NULL OR length(id::VARCHAR) > 2 THEN 'id' END,
                     CASE WHEN strlen(repo_id) > 6 THEN 'repo_id' END,
                     CASE WHEN strlen(file_path) > 10 THEN 'file_path' END,
                     CASE WHEN strlen(coalesce(function_name, '')) > 3 THEN 'function_name' END,
                     CASE WHEN len(embedding) <> 64 THEN 'embedding' END) AS reasons
FROM snippet_vectors""")
def validate_embeddings(spark, sf):
    # Small limits, so that some of the vectors break each of them.
    limits = {"id": 2, "repo_id": 6, "file_path": 10, "function_name": 3}
    records = vectors.embedding_records(views(spark, sf).snippet_vectors)
    checked = vectors.validate(records, dim=64, limits=limits)
    return checked.select("id", F.array_join("reasons", ",").alias("reasons"))


@query("mean_pool", """
WITH t AS (SELECT label, vec_id % 2 AS mask, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos
           FROM embeddings)
SELECT label::BIGINT AS label, pos::BIGINT AS pos, round(sum(x * mask) / greatest(sum(mask), 1e-9), 6) + 0.0 AS mean
FROM t GROUP BY label, pos""")
def mean_pool(spark, sf):
    tokens = views(spark, sf).embeddings.select(
        "label", F.col("embedding").alias("vec"), (F.col("vec_id") % 2).alias("mask")
    )
    pooled = vectors.mean_pool(tokens, "label")
    long = pooled.select(F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("pos", "x"))
    return long.select("label", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + 0.0).alias("mean"))

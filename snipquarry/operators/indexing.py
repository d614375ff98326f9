"""From files to snippet, vector and job tables, for many repositories at once."""

from pyspark.sql import DataFrame, functions as F

from snipquarry import schemas, settings
from snipquarry.functions import keys
from snipquarry.operators.chunking import chunk_files
from snipquarry.operators.files import discover, with_relative_path
from snipquarry.operators.inference import embed
from snipquarry.operators.repositories import register, with_status
from snipquarry.operators.vectors import embedding_records, split_valid, validate
from snipquarry.plans.keys import marked_likely
from snipquarry.plans.scratch import written
from snipquarry.plans.skew import first_per_key, salted_join
from snipquarry.sources import tree
from snipquarry.sources.store import Store


def snippet_id():
    return keys.stable_id(
        F.col("repo_id"), F.col("file_path"), F.col("ordinal"), F.col("start_line"), F.col("end_line")
    )


def index_chunks(
    files: DataFrame, size=settings.CHUNK_LINES, overlap=settings.OVERLAP_LINES, prune_dirs=True
) -> DataFrame:
    """Chunks of all source files in (repo_id, file_path, content), with failed files as error rows."""
    return chunk_files(discover(files, prune_dirs), size, overlap)


def snippets(chunks: DataFrame, as_of=None) -> DataFrame:
    """Rows of the snippet table."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    rows = chunks.filter("error IS NULL").withColumn("id", snippet_id())
    rows = rows.withColumns({"embedding_id": F.col("id"), "created_at": now, "updated_at": now})
    return schemas.conform(rows, schemas.CODE_SNIPPETS)


def index_jobs(file_results: DataFrame, repositories: DataFrame, repo_errors: DataFrame | None = None) -> DataFrame:
    """One job per repository (id), from per-file results.

    `file_results` has (repo_id, file_path, n_chunks, error, started_at, completed_at).  A file
    with an error is counted but not processed and does not fail the job; only an error of the
    repository itself (repo_id, error_message) does.
    """
    ok = F.col("error").isNull()
    counts = file_results.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(ok).alias("processed_files"),
        F.sum(F.when(ok, F.col("n_chunks")).otherwise(0)).alias("total_snippets"),
        F.min("started_at").alias("started_at"),
        F.max("completed_at").alias("completed_at"),
    )
    jobs = repositories.select(F.col("id").alias("repo_id")).join(counts, "repo_id", "left")
    if repo_errors is None:
        jobs = jobs.withColumn("error_message", F.lit(None).cast("string"))
    else:
        jobs = jobs.join(repo_errors.select("repo_id", "error_message"), "repo_id", "left")
    zero = F.lit(0)
    return jobs.select(
        keys.stable_id(F.col("repo_id"), F.unix_micros("started_at")).alias("id"),
        "repo_id",
        F.when(F.col("error_message").isNotNull(), "failed").otherwise("completed").alias("status"),
        F.coalesce("total_files", zero).alias("total_files"),
        F.coalesce("processed_files", zero).alias("processed_files"),
        F.coalesce("total_snippets", zero).alias("total_snippets"),
        "error_message",
        "started_at",
        "completed_at",
    )


def file_results(chunks: DataFrame) -> DataFrame:
    """Per-file results of `index_chunks`: number of chunks, error, and times.

    The times are those the files came with (started_at, completed_at), or now.
    """
    def time(name, pick):
        return (pick(name) if name in chunks.columns else F.current_timestamp()).alias(name)

    return chunks.groupBy("repo_id", "file_path").agg(
        F.count_if(F.col("error").isNull()).alias("n_chunks"),
        F.max("error").alias("error"),
        time("started_at", F.min),
        time("completed_at", F.max),
    )


def first_per_path(files: DataFrame) -> DataFrame:
    """Files with one row for each path of a repository: of several, the one of the least content.

    Only paths that come more than once are shuffled.
    """
    counts = files.groupBy("repo_id", "file_path").agg(F.count(F.lit(1)).alias("n"))
    twice = written(counts.filter("n > 1").select("repo_id", "file_path"), "repeated_paths")
    marked = marked_likely(files, twice, ["repo_id", "file_path"], "_twice")
    some = first_per_key(marked.filter("_twice").drop("_twice"), ["repo_id", "file_path"], ["content"])
    return marked.filter("NOT _twice").drop("_twice").unionByName(some)


def index_repositories(
    requests: DataFrame, files: DataFrame, store: Store, repo_errors: DataFrame | None = None,
    size=settings.CHUNK_LINES, overlap=settings.OVERLAP_LINES, prune_dirs=True, as_of=None,
    provider=None, dim=settings.EMBEDDING_DIM,
) -> dict:
    """Index the files of all requested repositories into the tables repositories, jobs and snippets of a
    store, and with a `provider` their embeddings into vectors: all in one commit.

    `requests` has (url, project), `files` has (url, file_path, content); files of addresses
    that were not requested, or are not valid, are left out.  What the tables have of a repository
    is replaced, so changed, shortened and removed files leave nothing behind; a repository with an
    error keeps its snippets and vectors.  A repository keeps the time of its first request.  Embeddings that
    break a limit are not stored.  What is written follows what is indexed, not what the store holds.

    Returns this run's `repositories` and `jobs`, the number of `added` snippets (new, or with
    another text than before) and of `rejected` embeddings, and the `version` of the store.
    """
    repos = written(register(requests, as_of), "repositories")
    # The id follows from the address; the join only filters.
    found = files.withColumn("repo_id", keys.stable_id(F.col("url"))).drop("url")
    known = repos.select(F.col("id").alias("repo_id"))
    wanted = salted_join(found, known, ["repo_id"], ["file_path"], "left_semi")
    chunks = written(index_chunks(first_per_path(wanted), size, overlap, prune_dirs), "chunks")
    done = known if repo_errors is None else known.join(repo_errors.select("repo_id").distinct(), "repo_id", "left_anti")
    done = written(done, "indexed")
    rows = written(snippets(chunks, as_of).join(done, "repo_id", "left_semi").select(*schemas.CODE_SNIPPETS.names), "snippets")
    jobs = written(index_jobs(file_results(chunks), repos, repo_errors), "jobs")
    status, new, rejected = with_status(repos, jobs), rows, 0
    with store.change() as change:
        base = change.version - 1
        if "snippets" in change.tables:
            stored = store.read("snippets", base).join(done, "repo_id", "left_semi")
            key = ["id", F.md5("content").alias("_md5")]
            new = rows.select(*key).join(stored.select(*key), ["id", "_md5"], "left_anti")
        if "repositories" in change.tables:
            first = store.read("repositories", base).select("id", F.col("created_at").alias("_first"))
            status = status.join(first, "id", "left").withColumn("created_at", F.coalesce("_first", "created_at")).drop("_first")
        status = written(schemas.conform(status, schemas.REPOSITORIES), "statuses")
        added = new.count()
        change.replace("repositories", status, status.select("id"))
        change.replace("jobs", schemas.conform(jobs, schemas.INDEX_JOBS), jobs.select("id"))
        change.replace("snippets", rows, done, order=["id"], find_by=["id"])
        if provider is not None:
            accepted, broken = embedded(rows, provider, dim)
            change.replace("vectors", accepted, done, order=["id"], find_by=["id"])
            rejected = broken.count()
    return {"repositories": status, "jobs": jobs, "added": added, "rejected": rejected, "version": change.version}


def embedded(rows: DataFrame, provider, dim: int) -> tuple[DataFrame, DataFrame]:
    """Records of the vector table for snippets: those that hold all limits, and the others with their reasons."""
    checked = written(validate(embedding_records(embed(rows, provider, "content")), dim), "embeddings")
    accepted, broken = split_valid(checked)
    return accepted.select(*schemas.SNIPPET_VECTORS.names), broken


def index_checkouts(checkouts: DataFrame, requests: DataFrame, store: Store, partitions: int, prune_dirs=True, **options) -> dict:
    """From checkouts (url, root) to the tables, see `index_repositories`.

    A checkout that cannot be listed fails its own job and keeps what the tables have of it; a
    file that cannot be read is counted, and the others go on.
    """
    placed = checkouts.select(keys.stable_id(F.col("url")).alias("repo_id"), "root", "url")
    listed, errors = tree.list_checkouts(placed.select("repo_id", "root"), partitions, prune_dirs=prune_dirs)
    wanted = discover(with_relative_path(listed), prune_dirs)
    read = tree.read_contents(wanted, partitions).withColumn("content", tree.decode(F.col("content")))
    urls = placed.select("repo_id", "url")
    return index_repositories(
        requests, read.join(urls, "repo_id").drop("repo_id"), store, errors, prune_dirs=prune_dirs, **options
    )


def job_responses(jobs: DataFrame) -> DataFrame:
    """The six progress fields and the error, as a progress request returns them."""
    return jobs.select(
        F.col("id").alias("job_id"), "repo_id", "status", F.col("processed_files").alias("files_processed"),
        "total_files", F.col("total_snippets").alias("snippets_created"),
        F.col("error_message").alias("error"),
    )

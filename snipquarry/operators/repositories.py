"""Repository, snippet and job tables: registration, lookups, paging, removal."""

from pyspark.sql import DataFrame, functions as F

from snipquarry import settings
from snipquarry.functions import keys, paths
from snipquarry.plans.scratch import scratch_dir, written
from snipquarry.plans.skew import first_per_key, salted_join
from snipquarry.sources.store import Store


def split_requests(requests: DataFrame, url="url"):
    """(valid, rejected) index requests by the form of their address."""
    ok = paths.valid_repo_url(F.col(url))
    return requests.filter(ok), requests.filter(~ok).withColumn("reason", F.lit("Invalid repository URL"))


def first_by_url(requests: DataFrame, order=("created_at", "id")) -> DataFrame:
    """Keep the first request of every address."""
    return first_per_key(requests, ["url"], list(order))


def register(requests: DataFrame, as_of=None) -> DataFrame:
    """Repository rows for valid index requests (url, project): one per address.

    The id is derived from the address, so a second registration gives the same row.
    """
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    valid, _ = split_requests(requests)
    rows = valid.select(
        keys.stable_id(F.col("url")).alias("id"),
        paths.repo_name(F.col("url")).alias("name"),
        "url",
        "project",
        F.lit("pending").alias("status"),
        F.lit(None).cast("timestamp").alias("last_indexed"),
        (F.col("created_at") if "created_at" in requests.columns else now).alias("created_at"),
        now.alias("updated_at"),
    )
    return first_by_url(rows, ("created_at", "project"))


def with_status(repositories: DataFrame, jobs: DataFrame) -> DataFrame:
    """Repositories with the status of their latest job; completed ones get `last_indexed`."""
    last = first_per_key(
        jobs.select("repo_id", "started_at", F.col("id").alias("_job"), F.col("status").alias("_status"),
                    "completed_at"),
        ["repo_id"], ["started_at", "_job"], last=True,
    )
    done = F.when(F.col("_status") == "completed", F.col("completed_at"))
    joined = repositories.join(last.withColumnRenamed("repo_id", "id"), "id", "left")
    return joined.select(*[
        {
            "status": F.coalesce("_status", "status"),
            "last_indexed": F.coalesce(done, "last_indexed"),
            "updated_at": F.coalesce("completed_at", "updated_at"),
        }.get(c, F.col(c)).alias(c)
        for c in repositories.columns
    ])


def invalid_status(rows: DataFrame) -> DataFrame:
    """Repositories or jobs whose status is not one of the four known ones."""
    return rows.filter(~F.coalesce(F.col("status").isin(settings.JOB_STATUSES), F.lit(False)))


def unique_violations(df: DataFrame, key: str) -> DataFrame:
    """Values that occur more than once in a column that should be unique; NULLs may repeat."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("n > 1")


def lookup_found(table: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Rows of `table` with a requested key, once per row however often it was requested."""
    return table.join(requested.select(key).distinct(), key, "left_semi")


def lookup_missing(table: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Requested keys that `table` does not have."""
    return requested.select(key).distinct().join(table.select(key), key, "left_anti")


def page(df: DataFrame, skip=settings.PAGE_SKIP, limit=settings.PAGE_LIMIT, order=("created_at", "id")) -> DataFrame:
    """One page of a table, and with every row of it the table's `total`."""
    total = df.agg(F.count(F.lit(1)))
    return df.orderBy(*order).offset(skip).limit(limit).withColumn("total", total.scalar())


class Pages:
    """A table stored in ranges of an order, with how many rows each has: a page reads the ranges that it lies in.

    Rows are cut by the whole order, so that many of one time do not have to be in one range.
    """

    def __init__(self, df: DataFrame, order=("created_at", "id"), parts=64):
        spark, self.order, path = df.sparkSession, list(order), scratch_dir(df.sparkSession, "pages")
        ranged = df.repartitionByRange(parts, *self.order).withColumn("_part", F.spark_partition_id())
        ranged.write.partitionBy("_part").parquet(path)
        self.rows = spark.read.schema(ranged.schema).parquet(path)
        # One row a range.
        counts = {r["_part"]: r["n"] for r in self.rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.counts = [counts.get(i, 0) for i in range(max(counts, default=-1) + 1)]

    def page(self, skip=settings.PAGE_SKIP, limit=settings.PAGE_LIMIT) -> DataFrame:
        """Rows `skip` to `skip + limit` of the order, and with every row of them the table's `total`."""
        before, first, wanted = 0, None, []
        for part, n in enumerate(self.counts):
            if before < skip + limit and before + n > skip:
                first = before if first is None else first
                wanted.append(part)
            before += n
        rows = self.rows.filter(F.col("_part").isin(wanted)).drop("_part")
        return rows.orderBy(*self.order).offset(skip - (first or 0) if wanted else 0).limit(limit).withColumn("total", F.lit(before).cast("long"))


LISTING = ["id", "name", "url", "project", "status", "last_indexed", "created_at"]


def list_repositories(repositories: DataFrame, skip=settings.PAGE_SKIP, limit=settings.PAGE_LIMIT) -> DataFrame:
    return page(repositories.select(*LISTING), skip, limit)


def repo_detail(repositories: DataFrame, snippets: DataFrame) -> DataFrame:
    """Repositories with their number of snippets, zero if there are none."""
    counts = snippets.groupBy(F.col("repo_id").alias("id")).agg(F.count(F.lit(1)).alias("snippet_count"))
    joined = repositories.join(counts, "id", "left")
    return joined.withColumn("snippet_count", F.coalesce("snippet_count", F.lit(0)))


def with_repository(rows: DataFrame, repositories: DataFrame, fields=("name", "url"), spread=("id",)) -> DataFrame:
    """Snippets or jobs with fields of their repository (as `repo_<field>`)."""
    parent = repositories.select(
        F.col("id").alias("repo_id"), *[F.col(f).alias(f"repo_{f}") for f in fields]
    )
    return salted_join(rows, parent, ["repo_id"], list(spread))


def purge(rows: DataFrame, purged: DataFrame, spread=("id",)) -> DataFrame:
    """Rows of repositories that are not on the purge list (repo_id)."""
    return salted_join(rows, purged.select("repo_id").distinct(), ["repo_id"], list(spread), "left_anti")


def cascade_delete(deleted: DataFrame, repositories, snippets, jobs, suggestions) -> dict[str, DataFrame]:
    """Tables after the repositories in `deleted` (repo_id) are gone.

    Snippets and jobs go with their repository.  Suggestions stay; those whose snippet is
    gone are listed under `dangling`.
    """
    # Read once per table from here on.
    gone = written(deleted.select("repo_id").distinct(), "deleted")
    removed = salted_join(snippets, gone, ["repo_id"], ["id"], "left_semi").select(
        F.col("id").alias("snippet_id")
    )
    return {
        "repositories": repositories.join(gone.withColumnRenamed("repo_id", "id"), "id", "left_anti"),
        "snippets": purge(snippets, gone),
        "jobs": purge(jobs, gone),
        "suggestions": suggestions,
        "dangling": salted_join(suggestions, removed, ["snippet_id"], ["id"], "left_semi"),
    }


def delete_stored(store: Store, deleted: DataFrame) -> int:
    """Remove the repositories in `deleted` (repo_id) from a store, with their jobs, snippets and vectors.

    One commit that writes the ids for each table and no rows; suggestions stay.  Returns the
    new version.
    """
    gone = written(deleted.select("repo_id").distinct(), "deleted")
    with store.change() as change:
        change.remove("repositories", gone.withColumnRenamed("repo_id", "id"))
        for table in ("jobs", "snippets", "vectors"):
            change.remove(table, gone)
    return change.version

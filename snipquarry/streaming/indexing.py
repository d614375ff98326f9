"""Incremental indexing of arriving files, with progress per repository."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from snipquarry import schemas, settings
from snipquarry.operators.indexing import embedded, file_results, index_chunks, snippets
from snipquarry.plans.scratch import written
from snipquarry.sources.store import Store
from snipquarry.sources.tables import replace_partitions

# State of any size: kept on disk, with the latest in memory.  `transformWithState` needs it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def index_stream(
    files: DataFrame, table: str, checkpoint: str, results: str | None = None,
    size=settings.CHUNK_LINES, overlap=settings.OVERLAP_LINES, prune_dirs=True, available_now=True,
):
    """Append the snippets of arriving (repo_id, file_path, content) rows to `table`.

    With `results`, per-file results are kept there, also of files that could not be
    processed; `index_jobs` makes jobs of them.  A repeated micro-batch replaces its own
    partition, so it adds nothing twice.  Returns the running query.
    """

    def write(batch, batch_id):
        chunks = index_chunks(batch, size, overlap, prune_dirs)
        if results:
            chunks = written(chunks, "chunks")
            done = file_results(chunks).withColumn("batch_id", F.lit(batch_id))
            replace_partitions(done, results, ["batch_id"])
        replace_partitions(snippets(chunks).withColumn("batch_id", F.lit(batch_id)), table, ["batch_id"])

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def progress(files: DataFrame) -> DataFrame:
    """Files seen so far per repository; for complete or update output."""
    return files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files_seen"))


class LatestVersion(StatefulProcessor):
    """Per file: its latest version, and out of each micro-batch what changes it.

    Of a version the row of the largest content counts; a version that is not newer than what
    was seen, or has its very content, changes nothing.  Only a digest is kept.
    """

    def init(self, handle):
        self.latest = handle.getValueState("latest", "version bigint, digest string")

    def handleInputRows(self, key, rows, timers):
        import hashlib

        import pandas as pd

        best = None
        for part in rows:
            # One row at a time: a file may come any number of times in one micro-batch.
            for version, content in zip(part["version"].tolist(), part["content"].tolist()):
                content = content if isinstance(content, str) else None
                row = (int(version), content is not None, content or "")
                if best is None or row > best:
                    best = row
        seen = self.latest.get()
        version, there, content = best
        if seen is not None and version <= seen[0]:
            return
        digest = hashlib.md5(content.encode("utf-8", "surrogatepass")).hexdigest() if there else ""
        self.latest.update((version, digest))
        if (seen[1] if seen is not None else "") != digest:
            yield pd.DataFrame({"repo_id": [key[0]], "file_path": [key[1]], "content": [content if there else None]})

    def close(self):
        pass


def changed_files(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, content) of arriving files (repo_id, file_path, version, content) whenever the
    latest content of a file changes; a NULL content is a file that is gone.  Rows without a version,
    repository or path say nothing.  A file that comes again in an older or the same version, or
    unchanged in a newer one, gives no row.  State is a version and a digest for each file."""
    rows = files.filter("version IS NOT NULL AND repo_id IS NOT NULL AND file_path IS NOT NULL")
    rows = rows.select("repo_id", "file_path", F.col("version").cast("long").alias("version"), "content")
    return rows.groupBy("repo_id", "file_path").transformWithStateInPandas(
        LatestVersion(), "repo_id string, file_path string, content string", "append", "None"
    )


def upsert_stream(
    files: DataFrame, store: Store, checkpoint: str, name="files", provider=None, dim=settings.EMBEDDING_DIM,
    size=settings.CHUNK_LINES, overlap=settings.OVERLAP_LINES, prune_dirs=True, as_of=None, available_now=True, compact=True,
):
    """Keep the snippets (and with a `provider` the vectors) of arriving file versions in a store.

    See `changed_files` for the input.  A micro-batch is one commit: what the tables have of each changed file
    is replaced, and of each file that is gone removed.  The store remembers the last batch of `name`, so one that
    is repeated after a failure changes nothing twice.  Folders of many small batches are merged now and then
    (`compact`).  The session's state store must be STATE_STORE.  Returns the running query.
    """

    def write(batch, batch_id):
        # Also of a repeated batch, all must be read: the state is kept with it.
        batch = written(batch, "changed_files")
        with store.change(name, batch_id) as change:
            if change.repeated:
                return
            paths = batch.select("repo_id", "file_path")
            rows = snippets(index_chunks(batch.filter("content IS NOT NULL"), size, overlap, prune_dirs), as_of)
            rows = written(rows.select(*schemas.CODE_SNIPPETS.names), "snippets")
            change.replace("snippets", rows, paths, order=["id"], find_by=["id"])
            if provider is not None:
                change.replace("vectors", embedded(rows, provider, dim)[0], paths, order=["id"], find_by=["id"])
        if compact:
            for table in ("snippets", "vectors"):
                if table in store.tables():
                    store.compact(table)

    writer = changed_files(files).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

"""Source files below checkout folders.

Spark's own file sources leave out names that start with `_` or `.`, and with them every
`__init__.py`.  Folders are therefore listed and read by tasks through Arrow file systems,
which also take object-store and HDFS addresses.
"""

import itertools
import os

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from snipquarry import settings
from snipquarry.plans.scratch import written

_ENTRY = "repo_id string, root string, path string, size long, is_dir boolean, error string"


def _open(uri):
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def _children(uri):
    """(path, size, is_dir) of a folder's entries; linked folders are not followed."""
    filesystem, path = _open(uri)
    local = isinstance(filesystem, fs.LocalFileSystem)
    scheme = uri[: len(uri) - len(path)]
    infos = filesystem.get_file_info(fs.FileSelector(path))
    kinds = ((i, i.type == fs.FileType.Directory) for i in infos)
    return ((scheme + i.path, i.size or 0, d) for i, d in kinds if not (d and local and os.path.islink(i.path)))


def _walk(repo_id, root, start, levels, prune_dirs):
    """Files below `start`, and the folders `levels` below it (None: all the way down)."""
    frontier = [(start, 0)]
    while frontier:
        folder, depth = frontier.pop()
        if levels is not None and depth == levels:
            yield repo_id, root, folder, 0, True, None
            continue
        try:
            children = _children(folder)
        except OSError as problem:
            yield repo_id, root, folder, 0, False, str(problem)
            continue
        for path, size, is_dir in children:
            if not is_dir:
                yield repo_id, root, path, size, False, None
            else:
                name = path.rsplit("/", 1)[-1]
                hidden = name.startswith(".") or name in settings.IGNORED_DIRS
                if not (prune_dirs and hidden):
                    frontier.append((path, depth + 1))


def _lister(levels, prune_dirs, step=10_000):
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
    names = ["repo_id", "root", "path", "size", "is_dir", "error"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                entries = _walk(row["repo_id"], row["root"], row["path"], levels, prune_dirs)
                while found := list(itertools.islice(entries, step)):
                    columns = [pa.array(c, t) for c, t in zip(zip(*found), types)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def list_checkouts(checkouts: DataFrame, partitions: int, split_levels=2, prune_dirs=True) -> tuple[DataFrame, DataFrame]:
    """All files below each checkout: (repo_id, root, path, size), and errors (repo_id, error_message).

    A checkout whose root or any folder cannot be listed has an error; the others go on, and so do
    the files of it that were found.

    `checkouts` has (repo_id, root).  The first `split_levels` levels are listed one checkout
    per row; every folder found there becomes a row of its own, spread over `partitions`
    tasks, so that one very large checkout is not one task's work.
    """
    starts = checkouts.select("repo_id", "root", F.rtrim(F.col("root"), F.lit("/")).alias("path"))
    top = starts.repartition(partitions, "repo_id", "path").mapInArrow(
        _lister(split_levels, prune_dirs), _ENTRY
    )
    # Read for its files and for its folders; listing is slow, so it is done once.
    top = written(top, "listing")
    folders = top.filter("is_dir").select("repo_id", "root", "path").repartition(partitions, "path")
    deep = folders.mapInArrow(_lister(None, prune_dirs), _ENTRY)
    found = written(top.filter("NOT is_dir").unionByName(deep), "files")
    errors = found.filter("error IS NOT NULL").groupBy("repo_id").agg(F.min("error").alias("error_message"))
    return found.filter("error IS NULL").select("repo_id", "root", "path", "size"), errors


def list_files(checkouts: DataFrame, partitions: int, split_levels=2, prune_dirs=True) -> DataFrame:
    """The files alone, see `list_checkouts`."""
    return list_checkouts(checkouts, partitions, split_levels, prune_dirs)[0]


def read_contents(files: DataFrame, partitions: int, batch_bytes=8 * 1024 * 1024) -> DataFrame:
    """Add `content` (bytes) and `error` to rows with a `path`.

    Paths are spread by hash before any content is read; content itself is not shuffled.
    An unreadable file keeps its row, with NULL content and the message in `error`.
    """
    schema = files.drop("content", "error").schema
    names = list(schema.names)

    def read(path):
        try:
            filesystem, path = _open(path)
            with filesystem.open_input_stream(path) as stream:
                return stream.read(), None
        except OSError as problem:
            return None, str(problem)

    def run(batches):
        for batch in batches:
            start, found, held = 0, [], 0
            for end, path in enumerate(batch.column("path").to_pylist(), 1):
                found.append(read(path))
                held += len(found[-1][0] or b"")
                if held >= batch_bytes or end == batch.num_rows:
                    content, error = zip(*found)
                    rows = batch.slice(start, end - start)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(n) for n in names]
                        + [pa.array(content, pa.binary()), pa.array(error, pa.string())],
                        names=names + ["content", "error"],
                    )
                    start, found, held = end, [], 0

    spread = files.select(*names).repartition(partitions, "path")
    return spread.mapInArrow(run, schema.add("content", "binary").add("error", "string"))


def _decode(raw):
    import pyarrow as pa

    text = [None if v is None else v.decode("utf-8", "ignore") for v in raw.to_pylist()]
    text = [v if v is None or "\r" not in v else v.replace("\r\n", "\n").replace("\r", "\n") for v in text]
    return pa.array(text, pa.string())


def decode(content):
    """Bytes as UTF-8 text without the invalid bytes, and with `\\n` line ends."""
    return F.arrow_udf(_decode, "string")(content)

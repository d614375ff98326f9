"""Which files of a checkout are source files, and in which language."""

from pyspark.sql import DataFrame, functions as F

from snipquarry.functions import paths


def discover(files: DataFrame, prune_dirs=True, path="file_path") -> DataFrame:
    """Source files of a path table, with their `language`.

    `prune_dirs` leaves out everything below an ignored folder.  Without it only the file's
    own name is tested.
    """
    p = F.col(path)
    keep = ~paths.ignored_name(paths.file_name(p))
    if prune_dirs:
        keep = keep & ~paths.below_ignored_dir(p)
    return files.filter(keep).withColumn("language", paths.language(p)).filter("language IS NOT NULL")


def with_relative_path(files: DataFrame) -> DataFrame:
    """Add `file_path`, the path below the checkout's root."""
    return files.withColumn("file_path", paths.relative_path(F.col("path"), F.col("root")))

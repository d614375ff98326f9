"""File streams with bounded micro-batches."""

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 1024**3


def read_stream(spark: SparkSession, path: str, schema, batch_bytes=BATCH_BYTES) -> DataFrame:
    """Parquet files arriving in a folder, at most `batch_bytes` of them per micro-batch.

    The bound also holds after a pause: a backlog is read in several micro-batches, so the
    rows of one key that meet in one task stay limited.
    """
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(path)

"""Embedding records: shape, limits and pooling."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from snipquarry import settings

# The fields that are stored with a vector.
FIELDS = [
    "id", "repo_id", "file_path", "language", "function_name", "class_name", "start_line",
    "end_line", "embedding",
]


def embedding_records(rows: DataFrame) -> DataFrame:
    """The nine stored fields; absent function and class names are empty strings."""
    empty = {"function_name", "class_name"}
    return rows.select(*[
        (F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")).alias(c)
        if c in empty else F.col(c)
        for c in FIELDS
    ])


def validate(records: DataFrame, dim=settings.EMBEDDING_DIM, limits=None) -> DataFrame:
    """Add `reasons`: the fields that break a limit.  Rows to keep have an empty array.

    Text lengths are in bytes.  A NULL breaks any limit.
    """
    limits = limits or settings.VECTOR_FIELD_BYTES
    broken = [
        F.when(F.coalesce(F.octet_length(F.col(c).cast("string")) > n, F.lit(True)), c)
        for c, n in limits.items()
    ]
    width = F.when(F.coalesce(F.size("embedding") != dim, F.lit(True)), "embedding")
    return records.withColumn("reasons", F.array_compact(F.array(*broken, width)))


def split_valid(validated: DataFrame):
    """(accepted, rejected) rows of `validate`."""
    accepted = validated.filter(F.size("reasons") == 0).drop("reasons")
    return accepted, validated.filter(F.size("reasons") > 0)


def mean_pool(token_vectors: DataFrame, by="id", vector="vec", mask="mask") -> DataFrame:
    """Masked mean of the vectors of each group; a group without any mask gives zeros.

    Sums combine on the map side, one dense buffer per group and task.
    """
    weighted = F.transform(vector, lambda x: x.cast("double") * F.col(mask))
    sums = Summarizer.metrics("sum").summary(array_to_vector(weighted)).getField("sum")
    total = F.greatest(F.sum(F.col(mask).cast("double")), F.lit(1e-9))
    pooled = token_vectors.groupBy(by).agg(sums.alias("_sums"), total.alias("_total"))
    mean = F.transform(vector_to_array("_sums"), lambda x: x / F.col("_total"))
    return pooled.select(by, mean.alias("embedding"))

"""Schemas of the stored tables."""

from pyspark.sql import types as T


def _table(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


_S, _I, _TS = T.StringType(), T.IntegerType(), T.TimestampType()

REPOSITORIES = _table(
    ("id", _S, False), ("name", _S, False), ("url", _S, False), ("project", _S, True),
    ("status", _S, True), ("last_indexed", _TS, True), ("created_at", _TS, True),
    ("updated_at", _TS, True),
)

CODE_SNIPPETS = _table(
    ("id", _S, False), ("repo_id", _S, False), ("file_path", _S, False), ("language", _S, False),
    ("content", _S, False), ("start_line", _I, False), ("end_line", _I, False),
    ("function_name", _S, True), ("class_name", _S, True), ("doc_string", _S, True),
    ("embedding_id", _S, False), ("created_at", _TS, True), ("updated_at", _TS, True),
)

INDEX_JOBS = _table(
    ("id", _S, False), ("repo_id", _S, False), ("status", _S, True), ("celery_task_id", _S, True),
    ("total_files", _I, True), ("processed_files", _I, True), ("total_snippets", _I, True),
    ("error_message", _S, True), ("started_at", _TS, True), ("completed_at", _TS, True),
    ("created_at", _TS, True),
)

SUGGESTION_REQUESTS = _table(
    ("id", _S, False), ("snippet_id", _S, False), ("issue_type", _S, False),
    ("issue_description", _S, False), ("suggested_fix", _S, True),
    ("model_confidence", T.DoubleType(), True), ("created_at", _TS, True),
)

SNIPPET_VECTORS = _table(
    ("id", _S, False), ("repo_id", _S, False), ("file_path", _S, False), ("language", _S, False),
    ("function_name", _S, False), ("class_name", _S, False), ("start_line", _I, False),
    ("end_line", _I, False), ("embedding", T.ArrayType(T.FloatType(), False), False),
)

CACHE = _table(
    ("key", _S, False), ("value", _S, True), ("written_at", _TS, False), ("expires_at", _TS, False),
)

# One cut-out of a file; `ordinal` is its position, `error` marks a file that could not be read.
CHUNK = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("function_name", T.StringType()),
    T.StructField("class_name", T.StringType()),
    T.StructField("doc_string", T.StringType()),
    T.StructField("error", T.StringType()),
])


def conform(df, schema):
    """Project `df` onto `schema`, casting types and adding absent nullable columns as NULL."""
    from pyspark.sql import functions as F

    columns = []
    for field in schema:
        if field.name in df.columns:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        elif field.nullable:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        else:
            raise ValueError(f"column {field.name} is required")
    return df.select(*columns)

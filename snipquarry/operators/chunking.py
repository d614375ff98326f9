"""Cut files into snippets: line windows, or the definitions of Python files."""

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from snipquarry import schemas, settings
from snipquarry.functions import paths, text
from snipquarry.plans.size import spread


def _windows(lines: Column, size: int, overlap: int) -> Column:
    if not 0 <= overlap < size:
        raise ValueError(f"overlap must be at least 0 and below the chunk size, got {overlap} of {size}")
    total = F.size(lines)
    step = size - overlap

    def window(start, ordinal):
        return F.struct(
            ordinal.cast("int").alias("ordinal"),
            (start + 1).alias("start_line"),
            F.least(start + size, total).alias("end_line"),
            F.array_join(F.slice(lines, start + 1, F.lit(size)), "\n").alias("content"),
            F.lit(None).cast("string").alias("function_name"),
            F.lit(None).cast("string").alias("class_name"),
            F.lit(None).cast("string").alias("doc_string"),
            F.lit(None).cast("string").alias("error"),
        )

    return F.transform(F.sequence(F.lit(0), total - 1, F.lit(step)), window)


def chunk_lines(
    files: DataFrame, size=settings.CHUNK_LINES, overlap=settings.OVERLAP_LINES, content="content"
) -> DataFrame:
    """One row per window of `size` lines, each sharing `overlap` lines with the next.

    The windows of a file are built before they become rows, so its lines are not repeated
    for every row.
    """
    keep = [c for c in files.columns if c != content]
    split = files.select(*keep, text.lines(F.col(content)).alias("_lines"))
    return split.select(*keep, F.inline(_windows(F.col("_lines"), size, overlap)))


_BLOCKS = (ast.stmt, ast.excepthandler, ast.match_case)


def _statements(tree):
    """All statements, breadth first.  Expressions are left out: they hold no definitions."""
    queue = [tree]
    for node in queue:
        for field in node._fields:
            inner = getattr(node, field, None)
            if type(inner) is list and inner and isinstance(inner[0], _BLOCKS):
                queue.extend(inner)
    return queue


def _cut(source):
    """Chunks of one Python text, as dicts in the order of a breadth-first tree walk."""
    rows = source.split("\n")
    whole = {"ordinal": 0, "start_line": 1, "end_line": len(rows), "content": source}
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return [whole]
    except (ValueError, RecursionError, MemoryError) as problem:
        return [{"ordinal": 0, "error": f"{type(problem).__name__}: {problem}"}]
    found = []
    for node in _statements(tree):
        name_field = {ast.FunctionDef: "function_name", ast.ClassDef: "class_name"}.get(type(node))
        if name_field:
            first, last = node.lineno, node.end_lineno
            found.append({
                "ordinal": len(found),
                "start_line": first,
                "end_line": last,
                "content": "\n".join(rows[first - 1:last]),
                name_field: node.name,
                "doc_string": ast.get_docstring(node),
            })
    return found or [whole]


# Files that are cut before their chunks become rows of Arrow.
FILES = 128


def _definitions(sources):
    import warnings

    fields = [
        ("ordinal", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()),
        ("content", pa.string()), ("function_name", pa.string()), ("class_name", pa.string()),
        ("doc_string", pa.string()), ("error", pa.string()),
    ]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        # A few files at a time: chunks of a file repeat its text, as objects and then as rows.
        kind, parts = pa.list_(pa.struct(fields)), []
        for start in range(0, len(sources), FILES):
            cut = [None if s is None else _cut(s) for s in sources.slice(start, FILES).to_pylist()]
            parts.append(pa.array(cut, kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def definitions(source: Column) -> Column:
    """Functions and classes of a Python text as an array of chunks.

    `async def` is not a definition here, decorators are outside the lines, and methods are
    listed on their own and inside their class.  A text without definitions, or one that
    does not parse, is one chunk; one that cannot be read at all is one row with `error`.
    """
    # "Nondeterministic" keeps Spark from parsing twice, for the rows and for a filter it infers.
    return F.arrow_udf(_definitions, T.ArrayType(schemas.CHUNK)).asNondeterministic()(source)


def extract_definitions(files: DataFrame, content="content") -> DataFrame:
    """One row per definition of each Python file."""
    keep = [c for c in files.columns if c != content]
    return spread(files).select(*keep, definitions(F.col(content)).alias("_chunks")).select(*keep, F.inline("_chunks"))


def chunk_files(
    files: DataFrame, size=settings.CHUNK_LINES, overlap=settings.OVERLAP_LINES,
    path="file_path", content="content",
) -> DataFrame:
    """Definitions of `.py` files and line windows of all others, in one pass over the files.

    Only Python texts go to Python workers.  A row with `error` stands for a file that could
    not be processed; `ordinal` 0 occurs once per file.
    """
    keep = [c for c in files.columns if c not in (content, "error")]
    is_python = paths.suffix(F.col(path)) == ".py"
    read_error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    body = F.col(content)
    prepared = spread(files).select(
        *keep,
        read_error.alias("_read_error"),
        definitions(F.when(is_python, body)).alias("_definitions"),
        F.when(~is_python, text.lines(body)).alias("_lines"),
    )
    none = {f.name: F.lit(None).cast(f.dataType) for f in schemas.CHUNK}
    unread = F.struct(*[
        {"ordinal": F.lit(0), "error": F.coalesce("_read_error", F.lit("no content"))}
        .get(n, c).alias(n) for n, c in none.items()
    ])
    chunks = F.coalesce(
        F.col("_definitions"), _windows(F.col("_lines"), size, overlap), F.array(unread)
    )
    return prepared.select(*keep, F.inline(chunks))


def line_stats(files: DataFrame, content="content") -> DataFrame:
    """Number of lines, and of characters in the longest one."""
    keep = [c for c in files.columns if c != content]
    split = files.select(*keep, text.lines(F.col(content)).alias("_lines"))
    longest = F.array_max(F.transform("_lines", lambda line: F.length(line)))
    return split.select(*keep, F.size("_lines").alias("n_lines"), longest.alias("longest_line"))

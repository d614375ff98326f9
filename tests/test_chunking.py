"""Line windows and definitions."""

import pytest
from pyspark.sql import functions as F

from snipquarry.operators import chunking

SOURCE = '''import os

@decorated
def outer(a):
    """Outer.

    More.
    """
    def inner():
        return a
    return inner


async def later():
    def within():
        pass


class K(object):
    "Class text."

    def method(self):
        return 1
'''


def _files(spark, contents, path="f.py"):
    rows = [(i, path, c) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "n int, file_path string, content string")


def test_definitions(spark):
    rows = chunking.extract_definitions(_files(spark, [SOURCE])).orderBy("ordinal").collect()
    got = [(r.function_name, r.class_name, r.start_line, r.end_line, r.doc_string) for r in rows]
    assert got == [
        ("outer", None, 4, 11, "Outer.\n\nMore."),
        (None, "K", 19, 23, "Class text."),
        ("inner", None, 9, 10, None),
        ("within", None, 15, 16, None),
        ("method", None, 22, 23, None),
    ]
    assert rows[0].content.startswith("def outer(a):") and rows[2].content == "    def inner():\n        return a"


def test_statements_come_in_the_order_of_a_full_walk():
    import ast
    import glob
    import os

    for path in sorted(glob.glob(os.path.join(os.path.dirname(ast.__file__), "*.py"))):
        with open(path, encoding="utf-8", errors="ignore") as f:
            tree = ast.parse(f.read())
        kinds = (ast.FunctionDef, ast.ClassDef)
        want = [n for n in ast.walk(tree) if isinstance(n, kinds)]
        assert [n for n in chunking._statements(tree) if isinstance(n, kinds)] == want


def test_texts_are_parsed_once(spark):
    files = _files(spark, [SOURCE])
    for rows in (chunking.extract_definitions(files), chunking.chunk_files(files).filter("error IS NULL")):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [") == 1


@pytest.mark.parametrize("source", ["", "x = 1\ny = 2\n", "def broken(:\n  pass", "async def f():\n    pass", "a\x00b"])
def test_whole_file(spark, source):
    row, = chunking.extract_definitions(_files(spark, [source])).collect()
    assert (row.ordinal, row.start_line, row.end_line, row.content) == (0, 1, source.count("\n") + 1, source)
    assert (row.function_name, row.class_name, row.doc_string, row.error) == (None, None, None, None)


def test_unreadable_python_is_an_error_row(spark):
    deep = "x = " + "(" * 150 + "1" + ")" * 150 + "\n" + "y = " + "-" * 100_000 + "1"
    row, = chunking.extract_definitions(_files(spark, [deep])).collect()
    assert row.ordinal == 0 and (row.error is not None or row.content == deep)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 12, 13, 16, 17, 40])
def test_line_windows(spark, n):
    content = "\n".join(f"line {i}" for i in range(n))
    lines = content.split("\n")
    rows = chunking.chunk_lines(_files(spark, [content]), size=16, overlap=4).orderBy("ordinal").collect()
    starts = list(range(0, len(lines), 12))
    assert [(r.ordinal, r.start_line, r.end_line) for r in rows] == [
        (i, s + 1, min(s + 16, len(lines))) for i, s in enumerate(starts)
    ]
    assert [r.content for r in rows] == ["\n".join(lines[s:s + 16]) for s in starts]
    assert {i for r in rows for i in range(r.start_line, r.end_line + 1)} == set(range(1, len(lines) + 1))


@pytest.mark.parametrize("n,expected", [(824, 1), (825, 2), (1024, 2), (1025, 2), (1649, 3)])
def test_default_window(spark, n, expected):
    rows = chunking.chunk_lines(_files(spark, ["\n" * (n - 1)])).collect()
    assert len(rows) == expected and max(r.end_line for r in rows) == n


@pytest.mark.parametrize("size,overlap", [(4, 4), (4, 5), (4, -1)])
def test_overlap_must_be_smaller(spark, size, overlap):
    with pytest.raises(ValueError):
        chunking.chunk_lines(_files(spark, ["x"]), size, overlap)


def test_dispatch_by_suffix(spark):
    py = _files(spark, [SOURCE], "a/B.PY")
    go = _files(spark, [SOURCE], "a/b.go")
    lost = _files(spark, [None], "a/c.go").withColumn("error", F.lit("not readable"))
    both = py.unionByName(go).withColumn("error", F.lit(None).cast("string")).unionByName(lost)
    rows = chunking.chunk_files(both, size=10, overlap=0).collect()
    counts = {}
    for r in rows:
        counts[r.file_path] = counts.get(r.file_path, 0) + 1
    assert counts == {"a/B.PY": 5, "a/b.go": 3, "a/c.go": 1}
    assert [r.error for r in rows if r.file_path == "a/c.go"] == ["not readable"]
    assert sum(r.ordinal == 0 for r in rows) == 3

"""Listing and reading checkouts."""

import os

from pyspark.sql import functions as F

from snipquarry.functions import paths
from snipquarry.operators import files, indexing
from snipquarry.sources import tree
from snipquarry.sources.store import Store

TREE = {
    "pkg/__init__.py": b"",
    "pkg/a.PY": b"def f():\r\n    return 1\r\n",
    "__tests__/t.js": b"let x\rlet y",
    "_private/b.go": b"package b\xff\xfe",
    "node_modules/dep/x.js": b"x",
    ".git/hooks/h.py": b"x = 1",
    "src/.hidden.py": b"x = 1",
    "src/build/deep/c.java": b"class C {}",
    "src/notes.md": b"text",
    "package-lock.json": b"{}",
    "a/b/c/d/e.ts": b"let e",
    "noext": b"",
}
KEPT = {"pkg/__init__.py", "pkg/a.PY", "__tests__/t.js", "_private/b.go", "a/b/c/d/e.ts"}
BELOW_IGNORED = {"node_modules/dep/x.js", ".git/hooks/h.py", "src/build/deep/c.java"}


def _checkout(spark, root):
    for name, content in TREE.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content)
    return spark.createDataFrame([("r1", str(root))], "repo_id string, root string")


def test_listing_and_discovery(spark, tmp_path):
    checkouts = _checkout(spark, tmp_path)
    os.symlink(tmp_path / "pkg", tmp_path / "loop")
    for levels in (1, 2, 9):
        for prune, expected in ((True, KEPT), (False, KEPT | BELOW_IGNORED)):
            listed = files.with_relative_path(tree.list_files(checkouts, 3, levels, prune_dirs=prune))
            found = files.discover(listed, prune_dirs=prune)
            names = [r.file_path for r in found.collect()]
            assert sorted(names) == sorted(expected)
    everything = tree.list_files(checkouts, 3, prune_dirs=False)
    sizes = {r.file_path: r.size for r in files.with_relative_path(everything).collect()}
    assert sizes == {name: len(content) for name, content in TREE.items()}


def test_file_addresses(spark, tmp_path):
    _checkout(spark, tmp_path)
    checkouts = spark.createDataFrame([("r1", f"file://{tmp_path}/")], "repo_id string, root string")
    found = files.discover(files.with_relative_path(tree.list_files(checkouts, 2)))
    assert {r.file_path for r in found.collect()} == KEPT


def test_reading_and_indexing(spark, tmp_path):
    checkouts = _checkout(spark, tmp_path)
    found = files.discover(files.with_relative_path(tree.list_files(checkouts, 2)))
    gone = found.limit(1).withColumns({"path": F.lit(f"{tmp_path}/gone.go"), "file_path": F.lit("gone.go")})
    read = tree.read_contents(found.unionByName(gone), 2, batch_bytes=10).withColumn("content", tree.decode(F.col("content")))
    chunks = indexing.index_chunks(read)
    rows = {r.file_path: r for r in indexing.snippets(chunks).collect()}
    assert set(rows) == KEPT
    assert rows["pkg/a.PY"].content == "def f():\n    return 1" and rows["pkg/a.PY"].function_name == "f"
    assert rows["__tests__/t.js"].content == "let x\nlet y" and rows["__tests__/t.js"].end_line == 2
    assert rows["_private/b.go"].content == "package b"
    assert (rows["pkg/__init__.py"].content, rows["pkg/__init__.py"].end_line) == ("", 1)
    repos = spark.createDataFrame([("r1",)], "id string")
    job = indexing.index_jobs(indexing.file_results(chunks), repos).first()
    assert (job.status, job.total_files, job.processed_files, job.total_snippets) == ("completed", 6, 5, 5)


def test_one_bad_checkout_fails_alone(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "missing"
    good.mkdir()
    _checkout(spark, good)
    urls = ["https://h/good.git", "https://h/bad.git"]
    checkouts = spark.createDataFrame([(urls[0], str(good)), (urls[1], str(bad))], "url string, root string")
    requests = spark.createDataFrame([(u, "p") for u in urls], "url string, project string")
    store = Store(spark, str(tmp_path / "store"))
    done = indexing.index_checkouts(checkouts, requests, store, 2)
    jobs = {r.status: r for r in done["jobs"].collect()}
    assert jobs["completed"].processed_files == len(KEPT) and jobs["failed"].error_message
    assert {r.file_path for r in store.read("snippets").collect()} == KEPT


def test_suffix_and_names(spark):
    names = ["a.py", "a.tar.GZ", ".py", "a.", "x/y.d/z", "..py", "a..py"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = [r[0] for r in df.select(paths.suffix(F.col("p"))).collect()]
    assert got == [".py", ".gz", "", "", "", ".py", ".py"]
    urls = {"https://h/u/repo.git": "repo", "https://h/u/a.git.github": "ahub", "x": "x", "https://h/": ""}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(paths.repo_name(F.col("u"))).collect()] == list(urls.values())
    ok = {"invalid-url": False, "https://github.com/user/repo.git": True, "https://x": True, "git@h:r.git": True, None: False}
    df = spark.createDataFrame([(u,) for u in ok], "u string")
    assert [r[0] for r in df.select(paths.valid_repo_url(F.col("u"))).collect()] == list(ok.values())

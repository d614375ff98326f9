"""Stores: changes of many tables at once, against a model in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from snipquarry.operators import indexing, inference, repositories
from snipquarry.sources import store as stores
from snipquarry.sources.store import Conflict, Store
from snipquarry.streaming import indexing as streams

SCHEMA = "id string, repo_id string, v int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).coalesce(1)


def rows_of(store, table="t", version=None):
    return sorted(tuple(r) for r in store.read(table, version).collect())


def test_as_a_model(spark, tmp_path):
    """Random additions, removals by two kinds of keys, replacements and merges."""
    rng, store, model, versions = random.Random(0), Store(spark, str(tmp_path)), [], {}
    for step in range(16):
        new = [(f"i{rng.randrange(12)}", f"r{rng.randrange(4)}", step) for _ in range(rng.randrange(1, 6))]
        kind = rng.choice(["append", "replace", "remove", "ids", "compact"]) if step else "append"
        if kind == "compact":
            before = store.manifest()["tables"]["t"]
            merged = store.compact("t", fanout=2, whole=rng.random() < 0.3)
            after = store.manifest()["tables"]["t"]
            assert not merged or len(after["data"]) == len(before["data"]) - merged + (len(rows_of(store)) > 0 or len(after["data"]) > 0) or not after["data"]
        else:
            with store.change() as change:
                if kind == "append":
                    change.append("t", frame(spark, new))
                    model += new
                elif kind == "ids":
                    # Rows of the change itself stay, also those with a removed key.
                    change.append("t", frame(spark, new))
                    change.remove("t", frame(spark, [(i,) for i, _, _ in new], "id string"))
                    model = [r for r in model if r[0] not in {n[0] for n in new}] + new
                else:
                    gone = [f"r{rng.randrange(4)}"]
                    keep = [r for r in new if r[1] in gone] if kind == "replace" else []
                    keys = frame(spark, [(g,) for g in [*gone, None]], "repo_id string")
                    change.replace("t", frame(spark, keep), keys) if keep else change.remove("t", keys)
                    model = [r for r in model if r[1] not in gone] + keep
        versions[max(store.versions())] = sorted(model)
        assert rows_of(store) == sorted(model), (step, kind)
    for version, rows in versions.items():
        assert rows_of(store, version=version) == rows
    store.vacuum()
    assert rows_of(store) == sorted(model) and len(store.versions()) == 1
    # With the newest manifest only, nothing is deleted by a second run.
    assert store.vacuum() == 0


def test_the_first_of_two_changes_wins(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one, two = store.change(), store.change()
    one.append("t", frame(spark, [("a", "r", 1)]))
    two.append("t", frame(spark, [("b", "r", 2)]))
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert rows_of(store) == [("a", "r", 1)] and store.versions() == [1]
    with store.change() as again:
        again.append("t", frame(spark, [("b", "r", 2)]))
    assert rows_of(store) == [("a", "r", 1), ("b", "r", 2)]


def test_a_repeated_step_is_seen(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for step, again in ((0, False), (0, True), (1, False), (0, True)):
        with store.change("writer", step) as change:
            assert change.repeated == again
            if not again:
                change.append("t", frame(spark, [("a", "r", step)]))
    assert rows_of(store) == [("a", "r", 0), ("a", "r", 1)]


FILES = "url string, file_path string, content string"
URLS = ["https://h/a.git", "https://h/b.git"]
TABLES = ["jobs", "repositories", "snippets", "vectors"]


def indexed(spark, store, files, **options):
    requests = frame(spark, [(u, "p") for u in sorted({f[0] for f in files})], "url string, project string")
    options = {"size": 2, "overlap": 0, "provider": inference.hash_provider(dim=4), "dim": 4} | options
    return indexing.index_repositories(requests, frame(spark, files, FILES), store, **options)


def test_a_run_that_fails_between_any_two_writes(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    first = [(u, f"{i}.go", f"text {i}\nb\nc") for u in URLS for i in range(3)]
    indexed(spark, store, first)
    before = {t: sorted(map(str, store.read(t).collect())) for t in TABLES}
    assert store.tables() == TABLES
    write = stores.Change._write
    for allowed in range(8):
        calls = []

        def failing(self, table, *rest):
            calls.append(table)
            if len(calls) > allowed:
                raise OSError("lost")
            return write(self, table, *rest)

        monkeypatch.setattr(stores.Change, "_write", failing)
        with pytest.raises(OSError):
            indexed(spark, store, [(URLS[0], "0.go", "other")])
        monkeypatch.setattr(stores.Change, "_write", write)
        assert {t: sorted(map(str, store.read(t).collect())) for t in TABLES} == before
    # Eight writes in all: keys and rows of four tables.
    done = indexed(spark, store, [(URLS[0], "0.go", "other")])
    assert done["version"] == 2 and done["added"] == 1
    contents = sorted(r.content for r in store.read("snippets").collect())
    assert contents == sorted(["other", *["c"] * 3, *[f"text {i}\nb" for i in range(3)]])
    assert {r.id for r in store.read("vectors").collect()} == {r.id for r in store.read("snippets").collect()}
    assert store.read("repositories").count() == 2 and store.read("jobs").count() == 3
    # What the failed runs left behind is not part of any version.
    assert store.vacuum() > 0 and store.read("snippets").count() == 7


def test_what_is_written_follows_the_change(spark, tmp_path):
    store, rng = Store(spark, str(tmp_path)), random.Random(1)
    text = lambda: "\n".join(f"{rng.getrandbits(64):x}" for _ in range(40))
    files = [(f"https://h/{i}.git", f"{j}.go", text()) for i in range(60) for j in range(10)]
    indexed(spark, store, files)

    def written(version):
        return sum(e["bytes"] for s in store.manifest()["tables"].values() for e in s["data"] + s["removed"] if e["version"] == version)

    one = [f for f in files if f[0] == "https://h/7.git"]
    indexed(spark, store, [(u, p, text()) for u, p, _ in one])
    # A sixtieth of the rows, with the fixed part of eight small files.
    assert written(2) < written(1) / 60 + 8 * 8000 < written(1) / 8
    rows = store.read("snippets").count()
    assert rows == 600 * 20 and store.compact("snippets", fanout=2) in (0, 2)
    store.compact("snippets", whole=True)
    assert store.read("snippets").count() == rows and len(store.manifest()["tables"]["snippets"]["data"]) == 1
    assert store.manifest()["tables"]["snippets"]["removed"] == []


def test_folders_merge_by_size(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for i in range(20):
        with store.change() as change:
            change.replace("t", frame(spark, [(f"i{i}", f"r{i % 5}", i)]), frame(spark, [(f"r{i % 5}",)], "repo_id string"))
        store.compact("t", fanout=4)
        state = store.manifest()["tables"]["t"]
        assert len(state["data"]) < 8 and rows_of(store) == sorted((f"i{j}", f"r{j % 5}", j) for j in range(max(0, i - 4), i + 1))
    # Removals end with the rows that they could hide.
    assert len(state["removed"]) < 8


def test_deleting_writes_only_ids(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    indexed(spark, store, [(u, f"{i}.go", "x\n" * 50) for u in URLS for i in range(20)])
    gone = store.read("repositories").filter(F.col("url") == URLS[0]).select(F.col("id").alias("repo_id"))
    version = repositories.delete_stored(store, gone)
    new = [e for s in store.manifest()["tables"].values() for e in s["data"] + s["removed"] if e["version"] == version]
    assert [e["rows"] for e in new] == [1] * 4
    assert {t: store.read(t).count() for t in ("repositories", "jobs")} == {"repositories": 1, "jobs": 1}
    assert {r.repo_id for t in ("snippets", "vectors") for r in store.read(t).collect()} == {store.read("repositories").first().id}
    assert store.read("snippets", version - 1).select("repo_id").distinct().count() == 2


def test_lookups_read_little(spark, tmp_path):
    """A lookup by id is pushed down to files that are sorted and carry Bloom filters."""
    import pyarrow.parquet as pq

    store = Store(spark, str(tmp_path))
    rows = spark.range(0, 200_000, 1, 2).select(F.md5(F.col("id").cast("string")).alias("id"), F.col("id").alias("v"))
    with store.change() as change:
        change.append("t", rows, order=["id"], find_by=["id"])
    wanted = store.read("t").filter(F.col("v") == 4711).first().id
    found = store.read("t").filter(F.col("id") == wanted)
    assert found.collect()[0].v == 4711 and "EqualTo(id," in found._jdf.queryExecution().executedPlan().toString()
    for path in tmp_path.rglob("*.parquet"):
        column = pq.read_table(path).column("id").to_pylist()
        assert column == sorted(column)
        # The filter lies behind the row groups: one of the column's bits is there.
        assert path.stat().st_size > sum(pq.ParquetFile(path).metadata.row_group(i).column(0).total_compressed_size for i in range(pq.ParquetFile(path).metadata.num_row_groups)) + 100_000


def versions(spark, rows):
    return frame(spark, rows, "repo_id string, file_path string, version bigint, content string")


def test_upserts_of_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_STORE)
    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    schema = "repo_id string, file_path string, version bigint, content string"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        streams.upsert_stream(stream, store, str(tmp_path / "state"), provider=inference.hash_provider(dim=4), dim=4, size=2, overlap=0).awaitTermination()
        found = store.read("snippets").collect()
        assert sorted(r.id for r in found) == sorted(r.id for r in store.read("vectors").collect())
        assert len({r.id for r in found}) == len(found)
        return sorted((r.repo_id, r.file_path, r.content) for r in found)

    versions(spark, [("r", "a.go", 1, "a\nb\nc"), ("r", "b.go", 1, "b"), ("r", "c.go", 1, "c"), ("r", "no.txt", 1, "x"), (None, "d.go", 1, "d"), ("r", "e.go", None, "e")]).write.parquet(source)
    assert run() == [("r", "a.go", "a\nb"), ("r", "a.go", "c"), ("r", "b.go", "b"), ("r", "c.go", "c")]
    # Twice in one batch, in an older version, gone, as it was, and the same file of another repository.
    versions(spark, [("r", "a.go", 3, "A"), ("r", "a.go", 2, "older"), ("r", "b.go", 0, "old"), ("r", "c.go", 2, None), ("s", "a.go", 1, "s")]).write.mode("append").parquet(source)
    want = [("r", "a.go", "A"), ("r", "b.go", "b"), ("s", "a.go", "s")]
    assert run() == want
    version = max(store.versions())
    versions(spark, [("r", "a.go", 3, "late"), ("r", "b.go", 9, "b"), ("r", "c.go", 3, None)]).write.mode("append").parquet(source)
    assert run() == want
    # Nothing had changed: not a row was written.
    new = [e for s in store.manifest()["tables"].values() for e in s["data"] + s["removed"] if e["version"] > version]
    assert new == []
    # A file comes back after it was gone.
    versions(spark, [("r", "c.go", 4, "c")]).write.mode("append").parquet(source)
    assert run() == sorted([*want, ("r", "c.go", "c")])


def test_a_batch_that_is_repeated(spark, tmp_path, monkeypatch):
    """The commit is made, and the stream is stopped before it knows."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_STORE)
    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    versions(spark, [("r", f"{i}.go", 1, "a") for i in range(5)]).write.parquet(source)

    def run():
        stream = spark.readStream.schema("repo_id string, file_path string, version bigint, content string").parquet(source)
        streams.upsert_stream(stream, store, str(tmp_path / "state"), compact=True).awaitTermination()

    def lost(self, table, **_):
        raise OSError("lost")

    monkeypatch.setattr(Store, "compact", lost)
    with pytest.raises(Exception):
        run()
    monkeypatch.undo()
    assert store.read("snippets").count() == 5 and store.versions() == [1]
    run()
    assert store.read("snippets").count() == 5 and store.versions() == [1]

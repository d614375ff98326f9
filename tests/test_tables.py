"""Stored tables, registration and service flow."""

import numpy as np
from pyspark.sql import functions as F

from snipquarry import schemas
from snipquarry.operators import cache, indexing, inference, repositories, service
from snipquarry.sources import tables
from snipquarry.sources.store import Store


def test_append_counts_and_repeats_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("part"))
    assert tables.append(rows, path, ["part"]) == 100
    more = spark.range(90, 120).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("part"))
    assert tables.append(tables.new_rows(more, tables.read_table(spark, path), ["id"]), path, ["part"]) == 20
    assert tables.read_table(spark, path).count() == 120
    tables.replace_partitions(spark.createDataFrame([("x", 1)], "id string, part long"), path, ["part"])
    counts = {r.part: r["count"] for r in tables.read_table(spark, path).groupBy("part").count().collect()}
    assert counts == {0: 40, 1: 1, 2: 40}


def test_register_keeps_the_first(spark):
    rows = [("https://h/a.git", "p2", "2024-01-02"), ("https://h/a.git", "p1", "2024-01-01"), ("invalid-url", "p", "2024-01-01")]
    df = spark.createDataFrame(rows, "url string, project string, c string").withColumn("created_at", F.col("c").cast("timestamp"))
    repos = repositories.register(df)
    row, = repos.collect()
    assert (row.name, row.project, row.status) == ("a", "p1", "pending")
    assert schemas.conform(repos, schemas.REPOSITORIES).columns == schemas.REPOSITORIES.names
    assert repositories.register(df).first().id == row.id


def test_indexing_again_adds_nothing(spark, tmp_path):
    requests = spark.createDataFrame([("https://h/a.git", "p"), ("nowhere", "p")], "url string, project string")
    files = spark.createDataFrame(
        [("https://h/a.git", "x.go", "a\nb"), ("https://h/a.git", "y.py", "def f(): pass"), ("nowhere", "z.go", "z"),
         ("https://h/a.git", "build/w.go", "w")],
        "url string, file_path string, content string",
    )
    table = Store(spark, str(tmp_path))
    done = indexing.index_repositories(requests, files, table)
    assert done["added"] == 2
    repo, job = done["repositories"].first(), done["jobs"].first()
    assert (repo.status, repo.project, repo.last_indexed == job.completed_at) == ("completed", "p", True)
    assert (job.repo_id, job.total_files, job.processed_files, job.total_snippets) == (repo.id, 2, 2, 2)
    assert indexing.index_repositories(requests, files, table)["added"] == 0
    more = files.unionByName(spark.createDataFrame([("https://h/a.git", "n.ts", "n")], files.schema))
    assert indexing.index_repositories(requests, more, table, prune_dirs=False)["added"] == 2
    stored = table.read("snippets")
    assert table.read("jobs").count() == 3 and table.read("repositories").count() == 1
    assert stored.count() == 4 and stored.filter("id <> embedding_id").isEmpty()
    failed = spark.createDataFrame([(repo.id, "clone failed")], "repo_id string, error_message string")
    gone = indexing.index_repositories(requests, files.limit(0), table, failed)
    assert gone["repositories"].first().status == "failed" and gone["jobs"].first().error_message == "clone failed"


def test_reindexing_replaces(spark, tmp_path):
    """Changed, shortened and removed files; a repeated path; a repository that failed; one without files."""
    schema = "url string, file_path string, content string"
    urls = ["https://h/a.git", "https://h/b.git", "https://h/c.git"]
    requests = spark.createDataFrame([(u, "p") for u in urls], "url string, project string")
    store = Store(spark, str(tmp_path))
    options = {"provider": inference.hash_provider(dim=4), "dim": 4}

    def run(rows, errors=None):
        return indexing.index_repositories(requests, spark.createDataFrame(rows, schema), store, errors, size=2, overlap=0, **options)

    def state():
        stored = store.read("snippets").collect()
        known = {r.id for r in store.read("vectors").collect()}
        assert known == {r.id for r in stored} and len(known) == len(stored)
        return sorted(r.content for r in stored)

    first = [(urls[0], "x.go", "a\nb\nc"), (urls[0], "y.go", "y"), (urls[1], "z.go", "z"), (urls[2], "w.go", "w")]
    assert run([*first, first[1]])["added"] == 5
    assert state() == ["a\nb", "c", "w", "y", "z"]
    b = spark.createDataFrame([(u,) for u in urls], "url string").select(indexing.keys.stable_id(F.col("url")).alias("id"), "url")
    failed = b.filter(F.col("url") == urls[1]).select(F.col("id").alias("repo_id"), F.lit("gone").alias("error_message"))
    assert run([(urls[0], "x.go", "A\nB"), (urls[1], "z.go", "other")], failed)["added"] == 1
    assert state() == ["A\nB", "z"]


def test_answers_end_with_their_time_to_live(spark):
    snippets = spark.createDataFrame([("s1", "one"), ("s2", "two")], "id string, content string")
    rows = [(1, "s1", "lint", "d1", 0), (2, "s1", "lint", "d2", 100), (3, "s1", "lint", "d3", 90_000), (4, "s2", "lint", "d", 5),
            (5, "none", "lint", "d", 5), (6, "s1", "odd", "d", 5), (7, "s1", "lint", "d4", 170_000)]
    asked = spark.createDataFrame(rows, "request_id int, snippet_id string, issue_type string, issue_description string, t long")
    asked = asked.withColumn("requested_at", F.timestamp_seconds("t")).drop("t")
    nothing = spark.createDataFrame([], schemas.CACHE)
    answers, records, entries = service.suggest(asked, snippets, nothing)
    got = {r.request_id: (r.suggested_fix, r.cached) for r in answers.collect()}
    assert got == {1: ("one", False), 2: ("one", True), 3: ("one", False), 4: ("two", False), 7: ("one", True)}
    assert records.count() == 3
    spans = {(r.expires_at - r.written_at).total_seconds() for r in entries.collect()}
    assert spans == {86_400}
    again, more, _ = service.suggest(asked.filter("request_id = 7"), snippets, cache.current(entries))
    assert [(r.suggested_fix, r.cached) for r in again.collect()] == [("one", True)] and more.count() == 0


def test_requests_of_one_key_are_not_put_together(spark, monkeypatch):
    plans, written = [], service.written
    monkeypatch.setattr(service, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df, name))
    rng, ttl = np.random.default_rng(3), 60
    rows = [(i, f"k{int(rng.integers(4)) if i % 3 else 0}", int(rng.integers(-400, 1500)) * 500_000) for i in range(900)]
    rows += [(1000 + i, "k0", 30_000_000) for i in range(300)] + [(2000, None, 0), (2001, None, 59_999_999), (2002, None, 60_000_000)]
    asked = spark.createDataFrame(rows, "id int, key string, t long").withColumn("requested_at", F.timestamp_micros("t"))
    want, last = {}, {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in last or t - last[key][0] >= ttl * 1_000_000:
            last[key] = t, i
        want[i] = last[key][1] != i, last[key][1]
    hits = spark.createDataFrame([(i, hit) for i, (hit, _) in want.items()], "id int, hit boolean")
    found = service._answered_by(asked.join(hits, "id"), ttl, "id", ["t"])
    assert {r.id: (r.hit, r._first) for r in found.collect()} == want
    assert len(plans) == 3 and not any("Window" in plan for plan in plans)


def test_empty_page(spark):
    rows = spark.createDataFrame([], "id string, created_at timestamp")
    assert repositories.page(rows).collect() == []


def test_cached_retrieval(spark):
    snippets = spark.createDataFrame(
        [(f"s{i}", "r1" if i < 3 else "r2", t) for i, t in enumerate(["a b", "a", "b c", "a a", "z"])],
        "id string, repo_id string, content string",
    )
    provider = inference.hash_provider(dim=32)
    vectors = inference.embed(snippets, provider, "content").select("id", "repo_id", "embedding")
    at = "2024-01-01 00:00:0"
    asked = spark.createDataFrame(
        [(1, "a", 2, None, at + "1"), (2, "a", 50, "", at + "2"), (3, "a", 9, "r2", at + "3"), (4, "z", 1, None, at + "4")],
        "query_id int, query string, k int, repo_id string, t string",
    ).withColumn("requested_at", F.col("t").cast("timestamp")).drop("t")
    nothing = spark.createDataFrame([], schemas.CACHE)
    answered, entries = service.retrieve(asked, nothing, vectors, snippets, provider)
    got = {r.query_id: ([x.id for x in r.results], r["count"], r.cached) for r in answered.collect()}
    # The key leaves out k: the second request gets the two results of the first.
    assert got == {1: (["s1", "s0"], 2, False), 2: (["s1", "s0"], 2, True), 3: (["s3", "s4"], 2, False), 4: (["s4"], 1, False)}
    later = asked.withColumn("requested_at", F.col("requested_at") + F.expr("INTERVAL 30 MINUTES"))
    stored = cache.current(entries)
    again, new = service.retrieve(later, stored, vectors, snippets, provider)
    assert new.count() == 0 and all(r.cached for r in again.collect())
    assert {r.query_id: [x.id for x in r.results] for r in again.collect()} == {i: g[0] for i, g in got.items()}
    apart = asked.filter("query_id <= 2").withColumn("requested_at", F.col("requested_at") + F.when(F.col("query_id") == 2, F.expr("INTERVAL 8 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS")))
    days, _ = service.retrieve(apart, nothing, vectors, snippets, provider)
    assert {r.query_id: (r["count"], r.cached) for r in days.collect()} == {1: (2, False), 2: (5, False)}
    expired = asked.withColumn("requested_at", F.col("requested_at") + F.expr("INTERVAL 2 HOURS"))
    assert service.retrieve(expired, stored, vectors, snippets, provider)[1].count() == 3
    apart, _ = service.retrieve(asked, nothing, vectors, snippets, provider, include_k=True)
    assert {r.query_id: r["count"] for r in apart.collect()} == {1: 2, 2: 5, 3: 2, 4: 1}


def test_pages_read_their_own_range(spark):
    # A third of the rows have one time.
    rows = spark.range(3000).select(
        F.md5(F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 37 % 1009).alias("created_at")
    )
    pages, want = repositories.Pages(rows, parts=20), [tuple(r) for r in rows.orderBy("created_at", "id").collect()]
    assert sum(pages.counts) == 3000 and max(pages.counts) < 600
    for skip, limit in ((0, 5), (2700, 20), (2990, 50), (5000, 3), (140, 400), (10, 0)):
        page = pages.page(skip, limit)
        assert [(r.id, r.created_at) for r in page.collect()] == want[skip:skip + limit]
        assert all(r.total == 3000 for r in page.collect())
    read = pages.page(2700, 20).inputFiles()
    assert len({f.split("_part=")[1].split("/")[0] for f in read}) <= 20
    plan = pages.page(2700, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and plan.split("PartitionFilters: [")[1].split("]")[0].count(",") <= 2
    nothing = repositories.Pages(rows.limit(0))
    assert nothing.page(0, 10).count() == 0

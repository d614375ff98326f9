"""Joins, first rows and numbering with a hot key."""

import pytest
from pyspark.sql import Window, functions as F

from snipquarry.plans import keys
from snipquarry.plans.numbering import number_in_group
from snipquarry.plans.skew import first_per_key, hot_keys, salted_join
from snipquarry.plans.size import broadcast_bytes, spread


@pytest.fixture(scope="module")
def tables(spark):
    n = spark.range(3000)
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(
        (F.col("id") % 700).cast("string")
    )
    big = n.select("id", key.alias("key"), (F.col("id") * 7919 % 1000).alias("x"))
    single = spark.range(0, 900, 2).select(F.col("id").cast("string").alias("key"), (F.col("id") * 2).alias("y"))
    return big, single.unionByName(spark.createDataFrame([("hot", -1)], "key string, y long"))


def _rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("share,rows,copy", [(1.0, 10**6, 0), (0.05, 0, 0), (1e-4, 3, 0), (1e-4, 0, 0), (1, 1, None)])
def test_salted_join(spark, tables, how, share, rows, copy):
    big, single = tables
    got = salted_join(big, single, ["key"], ["id"], how, share=share, rows=rows, copy_bytes=copy)
    assert _rows(got) == _rows(big.join(single, "key", how))


def test_salted_join_with_condition(spark, tables):
    big, single = tables
    got = salted_join(big, single, ["key"], ["id"], "left", F.col("x") > F.col("y"), rows=0, copy_bytes=0)
    near = salted_join(big, single, ["key"], ["id"], "left", F.col("x") > F.col("y"))
    assert _rows(got) == _rows(near)
    b, s = big.alias("b"), single.alias("s")
    want = b.join(s, (F.col("b.key") == F.col("s.key")) & (F.col("x") > F.col("y")), "left").select("b.*", "y")
    assert _rows(got) == _rows(want)


def test_hot_rows_are_spread(spark, tables):
    big, single = tables
    assert [tuple(r) for r in hot_keys(big, ["key"], 0.1, 0).collect()] == [("hot", 4)]
    joined = salted_join(big, single, ["key"], ["id"], share=0.01, rows=0, copy_bytes=0).filter("key = 'hot'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        used = joined.groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert used == 4


@pytest.mark.parametrize("last", [False, True])
def test_first_per_key(spark, tables, last):
    big, _ = tables
    order = [F.desc("x"), F.desc("id")] if last else ["x", "id"]
    ranked = big.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    assert _rows(first_per_key(big, ["key"], ["x", "id"], last)) == _rows(ranked.filter("_n = 1").drop("_n"))


def test_numbering(spark, tables):
    big, _ = tables
    got = number_in_group(big.na.fill("none"), ["key"], ["x", "id"], F.floor(F.col("x") / 10))
    w = Window.partitionBy("key").orderBy("x", "id")
    want = big.na.fill("none").withColumn("position", (F.row_number().over(w) - 1).cast("long"))
    assert _rows(got) == _rows(want)


def test_spread_only_small_inputs(spark, tables):
    big, _ = tables
    assert spread(big).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(big, piece_bytes=100) is big


@pytest.mark.parametrize("setting,size", [("10MB", 10 << 20), ("-1", -1), ("1048576b", 1 << 20), ("1g", 1 << 30), ("77", 77)])
def test_broadcast_setting(spark, setting, size):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", setting)
    try:
        assert broadcast_bytes(spark) == size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("n, most, passing", [(0, None, 0), (1, None, 0.001), (3_000, None, 0.05), (5_000_000, None, 0.05), (200_000, 1, 1)])
def test_the_filter_grows_with_its_ids(spark, n, most, passing):
    ids = spark.range(n).select((F.col("id") * 3).cast("string").alias("k"))
    rows = spark.range(600_000).select(F.col("id").cast("string").alias("k"), "id")
    marked = keys.marked_likely(rows, ids, ["k"], "m", most)
    assert marked.columns == ["k", "id", "m"]
    own = (F.col("id") % 3 == 0) & (F.col("id") < 3 * n)
    counts = {(r.own, r.m): r["count"] for r in marked.groupBy(own.alias("own"), "m").count().collect()}
    assert (True, False) not in counts and sum(counts.values()) == 600_000
    assert counts.get((False, True), 0) <= passing * 600_000


def test_the_filter_takes_missing_keys(spark):
    ids = spark.createDataFrame([(None, 1), ("a", None)], "k string, j int")
    rows = spark.createDataFrame([(None, 1), ("a", None), ("b", 2), (None, None)], "k string, j int")
    got = {(r.k, r.j): r.m for r in keys.marked_likely(rows, ids, ["k", "j"], "m").collect()}
    assert got[None, 1] and got["a", None] and len(got) == 4


@pytest.mark.parametrize("weights, broadcasts, shuffled", [
    ({"a": 30, "b": 20}, True, False), ({f"k{i}": 1 for i in range(40)}, False, True),
    ({"a": 30, **{f"k{i}": 1 for i in range(20)}}, True, True), ({}, False, True),
])
def test_a_lookup_joins_once_where_all_keys_are_alike(spark, weights, broadcasts, shuffled):
    """Hot keys are those with more than a twentieth of all rows."""
    rows = [(k, i) for k, n in {**weights, "other": 2}.items() for i in range(n)] + [(None, 0)]
    table = spark.createDataFrame([(k, n, None if n == 20 else k * 2) for k, n in weights.items()], "k string, n long, name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = keys.lookup(spark.createDataFrame(rows, "k string, i int"), table, ["k"], "n", 0.05)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        got = _rows(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found.columns == ["k", "i", "n", "name"]
    own = {k: (n, None if n == 20 else k * 2) for k, n in weights.items()}
    assert got == sorted([(i, k, *own.get(k, (None, None))) for k, i in rows], key=str)
    assert (plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")) == (broadcasts, shuffled)
    assert "ubquery" not in plan


@pytest.mark.parametrize("n, joins", [(0, 0), (10, 1)])
def test_few_ids_are_copied_without_a_filter(spark, n, joins):
    ids = spark.range(n).select(F.col("id").alias("k")).unionByName(spark.range(n).select(F.col("id").alias("k")))
    marked = keys.marked_likely(spark.range(100).select(F.col("id").alias("k")), ids, ["k"], "m")
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == joins and "bit_or" not in plan
    assert {r.k for r in marked.collect() if r.m} == {*range(n)} and marked.count() == 100


def test_scratch_tables_are_removed(spark):
    from snipquarry.plans.scratch import noted, remove_scratch, written

    folders, other = [], written(spark.range(3), "other")
    with noted(folders):
        stored = written(spark.range(5), "noted")
    more = written(spark.range(2), "more")
    assert len(folders) == 1 and stored.count() == 5
    remove_scratch(spark, folders)
    assert folders == [] and other.count() == 3 and more.count() == 2
    with pytest.raises(Exception):
        stored.collect()

"""Connected components of links between whole numbers."""

from pyspark.sql import DataFrame, functions as F

from snipquarry.plans.keys import lookup
from snipquarry.plans.scratch import written


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: neither step changes such edges."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    sums = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return sums.filter("out > 1 OR out = 1 AND into = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) lead to, for every node with a link.

    Alternates two steps until all are stars: each node hangs its larger neighbours, and then its
    smaller ones, on the smallest that it sees.  Takes about the logarithm of the longest chain
    in rounds; nodes with very many links are looked up apart.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "mins")
        larger = lookup(both.filter("v > u"), mins, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = written(larger.distinct(), "larger")
        mins = written(larger.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "mins")
        smaller = lookup(larger, mins, ["u"], "n").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(smaller.unionByName(mins.select("u", F.col("m").alias("v"))).distinct(), "edges")
    hung = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return hung.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

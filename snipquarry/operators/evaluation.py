"""Quality and service figures."""

from pyspark.sql import DataFrame, functions as F

from snipquarry.operators.search import join_hits
from snipquarry.plans.skew import salted_join


def judge_by_label(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Hits with `relevant`: the hit has the label of its query and is not the query itself.

    `labels` has (id, label) for queries and vectors alike.
    """
    own = labels.select(F.col("id").alias("query_id"), F.col("label").alias("_wanted"))
    got = join_hits(hits, labels.select("id", "label"))
    relevant = (F.col("label") == F.col("_wanted")) & (F.col("id") != F.col("query_id"))
    return got.join(own, "query_id").withColumn("relevant", relevant).drop("label", "_wanted")


def totals_by_label(labels: DataFrame) -> DataFrame:
    """Number of relevant vectors of each query under `judge_by_label`."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    joined = salted_join(labels, sizes, ["label"], ["id"])
    return joined.select(F.col("id").alias("query_id"), (F.col("_n") - 1).alias("relevant_total"))


def judge_by_list(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """Hits with `relevant`: the pair (query_id, id) is in `judgments`."""
    marked = judgments.select("query_id", "id").distinct().withColumn("relevant", F.lit(True))
    joined = hits.join(marked, ["query_id", "id"], "left")
    return joined.withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def totals_by_list(judgments: DataFrame) -> DataFrame:
    pairs = judgments.select("query_id", "id").distinct()
    return pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant_total"))


def mrr_recall(judged: DataFrame, totals: DataFrame) -> DataFrame:
    """Mean reciprocal rank and mean recall over all queries in `totals`.

    Queries without anything relevant have no recall and are left out of it.
    """
    best = judged.groupBy("query_id").agg(
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.count_if("relevant").alias("found"),
    )
    per_query = totals.join(best, "query_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    recall = F.when(F.col("relevant_total") > 0, F.col("found") / F.col("relevant_total"))
    return per_query.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.avg(recall).alias("recall"),
    )


def overlap(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that an approximate search found."""
    found = approximate.select("query_id", "id", F.lit(1).alias("_found"))
    joined = exact.join(found, ["query_id", "id"], "left")
    return joined.agg(F.count(F.lit(1)).alias("n_hits"), F.avg(F.coalesce("_found", F.lit(0))).alias("recall"))


def acceptance_rate(suggestions: DataFrame) -> DataFrame:
    """Share of accepted suggestions per issue type."""
    return suggestions.groupBy("issue_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("accepted").cast("double")).alias("acceptance_rate")
    )


def job_stats(jobs: DataFrame) -> DataFrame:
    """Number of successful jobs, and mean and median indexing time in seconds."""
    done = F.col("status") == "completed"
    micros = F.unix_micros("completed_at") - F.unix_micros("started_at")
    seconds = F.when(done, micros / 1e6)
    return jobs.agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.count_if(done).alias("n_completed"),
        F.avg(seconds).alias("avg_seconds"),
        F.percentile_approx(seconds, 0.5, 10_000).alias("median_seconds"),
    )


def histogram(log: DataFrame, value: str, low, high, buckets: int, by=()) -> DataFrame:
    """Counts by bucket of equal width; 0 and buckets + 1 hold what lies outside."""
    place = F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(buckets))
    return log.filter(F.col(value).isNotNull()).groupBy(*by, place.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def quantile_sketches(log: DataFrame, value: str, by=(), k=200) -> DataFrame:
    """(by, n, sketch): a mergeable sketch of the values of each group, e.g. a day and kind, to be stored.

    A sketch has some `k` values, whatever it stands for; its ranks are off by about 1.65 % at 200.
    """
    return log.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch")
    )


def merged_quantiles(sketches: DataFrame, ranks, by=()) -> DataFrame:
    """(by, n, rank, value): quantiles of the sketches of any period, merged; the values are not read again."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    wanted = F.array(*[F.lit(float(r)) for r in ranks])
    found = F.kll_sketch_get_quantile_double("sketch", wanted)
    return merged.select(*by, "n", F.explode(F.arrays_zip(wanted.alias("rank"), found.alias("value"))).alias("_q")).select(*by, "n", "_q.rank", "_q.value")

"""Not-modified revisits of web archives, resolved against earlier full responses."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from snipquarry.llm.url_filter import canonical, host, path
from snipquarry.plans.keys import cut_points

# Header fields of a not-modified answer that never replace those of the stored response.
KEPT_FIELDS = [
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te",
    "trailer", "transfer-encoding", "upgrade",
]
SLICES = 64


def url_key(url: Column) -> Column:
    """Scheme, leading www., query, fragment and trailing slashes do not tell urls apart."""
    return canonical(host(url), path(url))


def _fields(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the last by name."""
    return F.map_from_entries(F.array_distinct(F.transform(
        F.map_entries(headers),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), headers[F.array_max(F.filter(F.map_keys(headers), lambda k: F.lower(k) == F.lower(e["key"])))].alias("value")),
    )))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^[Ww]/", "")


def resolve(records: DataFrame, slices=SLICES) -> DataFrame:
    """(record_id, refers_to, status, headers) for every revisit among records
    (record_id, kind, url, at, headers).

    `kind` is response or revisit, `at` a whole number that grows with time, `headers` a map.  A
    revisit refers to the latest response of the same canonical url strictly before it (at the
    same time, the largest record_id).  `status` is

    * missing: there is none, or the revisit has no url or time;
    * matched: the entity tags agree (weak comparison), or, where one has no tag, the dates of last
      modification do;
    * changed: they disagree.  The revisit is not resolved;
    * unchecked: no validator is on both sides.

    Matched and unchecked ones get the response's header fields, updated by those of the revisit
    that a not-modified answer may change; others keep their own.  Missing headers count as none.
    Repeated revisits each give a row; responses without a url or time are not used.  Other kinds
    and columns are not looked at.

    A url's records are cut at common times into `slices`, so a url with a third of all records is
    worked on by many tasks: inside a slice by a window, and between slices by the last response
    of each, of which a url has at most one a slice.
    """
    rows = records.select(
        "record_id", "kind", url_key(F.col("url")).alias("key"), F.col("at").cast("long").alias("at"),
        _fields(F.coalesce("headers", F.create_map().cast("map<string,string>"))).alias("headers"),
    ).filter(F.col("kind").isin("response", "revisit"))
    cuts = cut_points(rows, "at", slices)
    slice_ = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c <= F.col("at")))
    # Rows without a url or time match nothing; each is spread by itself.
    usable = F.col("at").isNotNull() & (F.col("key") != "")
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = rows.filter((F.col("kind") == "revisit") | F.col("usable"))
    rows = rows.withColumns({
        "slice": F.when(F.col("usable"), slice_).otherwise(-1),
        "key": F.when(F.col("usable"), F.col("key")).otherwise(F.concat(F.lit("\0"), F.xxhash64("record_id", F.map_entries("headers")).cast("string"))),
        "full": F.when(F.col("kind") == "response", F.struct("record_id", "headers")),
        "order": F.when(F.col("kind") == "response", F.struct("at", "record_id")),
    })
    last = F.max_by("full", "order")
    ends = rows.filter("usable").groupBy("key", "slice").agg(last.alias("end"), F.max("order").alias("end_order"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "slice", F.max_by("end", "end_order").over(before).alias("carried"))
    inside = Window.partitionBy("key", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", last.over(inside)).filter("kind = 'revisit'")
    found = near.join(carried, ["key", "slice"], "left").withColumn("full", F.coalesce("near", "carried"))

    own, stored = F.col("headers"), F.col("full.headers")
    tags, dates = (own["etag"], stored["etag"]), (own["last-modified"], stored["last-modified"])
    status = (
        F.when(F.col("full").isNull(), "missing")
        .when(tags[0].isNotNull() & tags[1].isNotNull(), F.when(_weak(tags[0]) == _weak(tags[1]), "matched").otherwise("changed"))
        .when(dates[0].isNotNull() & dates[1].isNotNull(), F.when(F.trim(dates[0]) == F.trim(dates[1]), "matched").otherwise("changed"))
        .otherwise("unchecked")
    )
    permitted = F.map_filter(own, lambda name, _: ~name.isin(KEPT_FIELDS))
    left = F.map_filter(stored, lambda name, _: ~F.array_contains(F.map_keys(permitted), name))
    solved = F.col("status").isin("matched", "unchecked")
    return found.withColumn("status", status).select(
        "record_id", F.when(solved, F.col("full.record_id")).alias("refers_to"), "status",
        F.when(solved, F.map_concat(left, permitted)).otherwise(own).alias("headers"),
    )

"""URL filters: a blocked Bloom filter in front of an exact hash join, in DataFrame functions only."""

from pyspark.sql import Column, DataFrame, functions as F

from snipquarry.plans.keys import lookup
from snipquarry.plans.scratch import written

# The filter has at most this many blocks of 256 bits, so a copy has at most 4 MB.  A longer list
# makes more false positives, which the exact join removes.
MOST_BLOCKS = 131_072
KEYS_PER_BLOCK = 20
WORDS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first ://, up to / ? # or the end, with A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., and path without trailing slashes."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


def suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, word: int) -> Column:
    """The bit of one 32-bit word of a block that a key sets."""
    at = F.shiftrightunsigned(F.xxhash64(key, F.lit("bits")), 5 * word).bitwiseAND(F.lit(31)).cast("int")
    return F.call_function("shiftleft", F.lit(1), at)


def bloom_blocks(listed: DataFrame, most_blocks=MOST_BLOCKS) -> tuple[DataFrame, int]:
    """The filter as rows (block, w0 to w7), for the keys in `key`, and its number of blocks."""
    n = listed.count()
    blocks = 1
    while blocks < min(most_blocks, n // KEYS_PER_BLOCK + 1):
        blocks *= 2
    bits = listed.select(_block(F.col("key"), blocks).alias("block"), *[_mask(F.col("key"), i).alias(f"w{i}") for i in range(WORDS)])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def possible_hits(rows: DataFrame, listed: DataFrame, most_blocks=MOST_BLOCKS) -> DataFrame:
    """Rows whose `key` may be listed: all that are, and a few others."""
    filter_, blocks = bloom_blocks(listed, most_blocks)
    filter_ = F.broadcast(filter_.select(F.col("block").alias("_block"), *[F.col(f"w{i}").alias(f"_w{i}") for i in range(WORDS)]))
    found = rows.withColumn("_block", _block(F.col("key"), blocks)).join(filter_, "_block")
    for i in range(WORDS):
        mask = _mask(F.col("key"), i)
        found = found.filter(F.col(f"_w{i}").bitwiseAND(mask) == mask)
    return found.select(*rows.columns)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, otherwise="allow", most_blocks=MOST_BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, listed, verdict) for every row of pages (page_id, url).

    `rules` has (host, path, verdict): a rule fits its host and all domains below, where the path
    starts with the rule's; the longest rule wins (as text, by characters; of equals the first).
    Where none fits, a page whose canonical url is in `listed` (url) is blocked, and any other is
    `otherwise`.  A missing url, or one without ://, has an empty host and path.  Rows repeated in
    all three columns come out as often as they came in.  Empty rules or lists match nothing; a
    rule with a null part and a listed null are left out.  Other columns are not used.

    A page's keys are its domains with the path prefixes of the lengths that rules have, and its
    canonical url.  The copied filter drops nearly all that are not listed.  Keys that pass are
    counted, joined exactly with the list (one row per key on both sides), and looked up by the
    pages with frequent keys apart, so a host with a third of all pages does no harm.
    """
    kind = dict(pages.dtypes)["page_id"]
    url = F.col("url")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"))

    rules = rules.select("host", "path", "verdict").dropna()
    rule_text = F.concat("host", "path")
    by_rule = rules.groupBy(F.concat(F.lit("r"), "host", F.lit(" "), "path").alias("key")).agg(
        F.min_by(F.struct(rule_text.alias("rule"), "verdict"), "verdict").alias("entry")
    ).select("key", "entry.rule", "entry.verdict")
    urls = listed.select(canonical(host(url), path(url)).alias("url")).filter("url <> ''").distinct()
    by_url = urls.select(F.concat(F.lit("u"), "url").alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"))
    entries = written(by_rule.unionByName(by_url), "url_list")

    lengths = rules.agg(F.collect_set(F.length("path"))).scalar()
    prefixes = F.transform(F.filter("_lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    rule_keys = F.flatten(F.transform(suffixes(F.col("host")), lambda h: F.transform(prefixes, lambda p: F.concat(F.lit("r"), h, F.lit(" "), p))))
    url_key = F.concat(F.lit("u"), canonical(F.col("host"), F.col("path")))
    keys = F.explode(F.concat(rule_keys, F.array(url_key)))
    keyed = rows.withColumn("_lengths", lengths).select(*rows.columns, keys.alias("key"))
    possible = written(possible_hits(keyed, entries, most_blocks), "url_hits")

    counted = possible.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    confirmed = written(counted.join(entries, "key"), "url_confirmed")
    hits = lookup(possible, confirmed, ["key"], "n").filter("verdict IS NOT NULL")

    # One marker for each page row keeps pages without a hit, and counts repeated rows.
    nothing = F.lit(None).cast("string")
    markers = rows.select("*", nothing.alias("rule"), nothing.alias("verdict"), F.lit(1).cast("long").alias("n"))
    every = markers.unionByName(hits.select("page_id", "host", "path", "rule", "verdict", F.lit(0).cast("long").alias("n")))
    is_rule = F.col("rule").isNotNull()
    best = F.max_by(F.when(is_rule, F.struct("rule", "verdict")), F.when(is_rule, F.struct(F.length("rule"), F.col("rule"))))
    judged = every.groupBy("page_id", "host", "path").agg(
        best.alias("best"), F.sum("n").alias("n"),
        F.coalesce(F.max(F.col("rule").isNull() & F.col("verdict").isNotNull()), F.lit(False)).alias("listed"),
    )
    verdict = F.coalesce("best.verdict", F.when(F.col("listed"), "block"), F.lit(otherwise))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return judged.select(
        F.col("page_id").cast(kind).alias("page_id"), "host", "path", F.col("best.rule").alias("rule"), "listed",
        verdict.alias("verdict"), again.alias("_again"),
    ).drop("_again")

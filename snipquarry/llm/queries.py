"""The registered queries of this folder and their SQL forms."""

import public_tokenizers
from pyspark.sql import functions as F

from snipquarry.llm import (
    decontaminate, importance, jaccard, line_dedup, packing, phrases, pii, secrets, suffix_dedup, topk, toxicity, url_filter,
    warc,
)

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Fixed values: (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

# Pages of hosts that are known for spam make the list of urls.
SPAM_LABEL = "(^|[.])(spam|cheap)-"

URL_SQL = f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS r
  FROM pages),
named AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '{SPAM_LABEL}')),
rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
fitting AS (
  SELECT r, rule_host || rule_path AS rule, rule_verdict FROM named JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path DESC) = 1)
SELECT page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM named LEFT JOIN fitting USING (r)"""


@query("op2_url_filter", URL_SQL)
def op2(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    listed = pages.select("url").filter(url_filter.host(F.col("url")).rlike(SPAM_LABEL))
    return url_filter.judge(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict")



@query("op5_secrets")
def op5(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    text = lambda spans: F.array_join(F.transform(spans, one), ",")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )


DECONTAMINATE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
items AS (
  SELECT item_id, ws, least(10, len(ws)) AS n FROM (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark) WHERE len(ws) > 0),
grams AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (
  SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, sizes WHERE len(ws) >= n)),
found AS (SELECT r, p.n, i, item_id FROM places p JOIN grams USING (n, g)),
words AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS w FROM found) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)"""


@query("op6_decontaminate", DECONTAMINATE_SQL)
def op6(spark, sf_dir):
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    # Items without an id count as one.
    n_items = F.size("items").cast("long") + F.col("unnamed").cast("long")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e::DOUBLE[], b.e::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scores QUALIFY rank <= 5"""


@query("op9_topk", TOPK_SQL)
def op9(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.topk(vectors.filter("vec_id % 50 = 0"), vectors, k=5, scale=256)


@query("op1_packing")
def op1(spark, sf_dir):
    """Tested by its own checks: pieces, gapless sequences, and their number against the sum of lengths."""
    pieces = packing.tokenised(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


LINES_SQL = r"""
WITH lines AS (
  SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5),
marked AS (SELECT r, doc_id, line, i, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN frequent USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id"""


@query("op3_line_dedup", LINES_SQL)
def op3(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op10_suffix_dedup")
def op10(spark, sf_dir):
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return kept.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op4_jaccard_join")
def op4(spark, sf_dir):
    return jaccard.similar(table(spark, sf_dir, "documents"), words=4, percent=85)


@query("op7_toxicity")
def op7(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    found = toxicity.score(documents, model)
    return found.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


# Pages as records of an archive: each is fetched once, and asked for again later.  The second
# answer has another spelling of the url; its tag differs in some, is missing in others, and some
# second requests come before the first.
def warc_records(pages):
    def part(kind, url, at, headers):
        return pages.select(
            F.concat(F.lit(f"{kind}-"), F.col("page_id").cast("string")).alias("record_id"), F.lit(kind).alias("kind"),
            url.alias("url"), at.alias("at"), F.map_filter(F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in headers]), lambda _, v: v.isNotNull()).alias("headers"),
        )

    n = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 8), F.lit('"'))
    day = F.concat(F.lit("day "), (n % 9).cast("string"))
    response = part("response", F.col("url"), 10 * n, [
        "Content-Type", F.lit("text/html"), "Content-Length", F.length("html").cast("string"), "ETag", tag,
        "Last-Modified", day, "Cache-Control", F.lit("max-age=60"), "Server", F.concat(F.lit("s"), (n % 3).cast("string")),
    ])
    later = F.when(n % 13 == 0, -5).otherwise(10 * (n % 97) + 5)
    revisit = part("revisit", F.concat(F.regexp_replace("url", "^http:", "https:"), F.lit("#again")), 10 * n + later, [
        "etag", F.when(n % 11 == 0, F.lit(None)).when(n % 7 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag)),
        "last-modified", F.when(n % 22 == 0, F.lit(None)).otherwise(day), "cache-control", F.lit("max-age=600"),
        "content-length", F.lit("0"), "date", n.cast("string"),
    ])
    return response.unionByName(revisit)


WARC_SQL = r"""
WITH named AS (
  SELECT page_id AS n, html, regexp_replace(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', '')
    || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS key FROM pages),
responses AS (
  SELECT n, key, 10 * n AS at, 'response-' || n AS id, '"' || substr(md5(html), 1, 8) || '"' AS tag, 'day ' || (n % 9) AS day,
         length(html)::VARCHAR AS len, 's' || (n % 3) AS server FROM named),
revisits AS (
  SELECT n, key, 10 * n + CASE WHEN n % 13 = 0 THEN -5 ELSE 10 * (n % 97) + 5 END AS at, 'revisit-' || n AS id,
         CASE WHEN n % 11 = 0 THEN NULL WHEN n % 7 = 0 THEN '"other"' ELSE 'W/"' || substr(md5(html), 1, 8) || '"' END AS tag,
         CASE WHEN n % 22 = 0 THEN NULL ELSE 'day ' || (n % 9) END AS day FROM named),
found AS (
  SELECT v.*, r.id AS rid, r.tag AS rtag, r.day AS rday, r.len AS rlen, r.server AS rserver
  FROM revisits v LEFT JOIN responses r ON v.key = r.key AND v.key <> '' AND r.at < v.at
  QUALIFY row_number() OVER (PARTITION BY v.n ORDER BY r.at DESC NULLS LAST, r.id DESC) = 1),
judged AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'missing'
    WHEN tag IS NOT NULL THEN CASE WHEN regexp_replace(tag, '^W/', '') = rtag THEN 'matched' ELSE 'changed' END
    WHEN day IS NOT NULL THEN CASE WHEN day = rday THEN 'matched' ELSE 'changed' END
    ELSE 'unchecked' END AS status FROM found)
SELECT id AS record_id, CASE WHEN status IN ('matched', 'unchecked') THEN rid END AS refers_to, status,
  CASE WHEN status IN ('matched', 'unchecked') THEN
    concat_ws('|', 'cache-control=max-age=600', 'content-length=' || rlen, 'content-type=text/html', 'date=' || n,
      'etag=' || coalesce(tag, rtag), 'last-modified=' || coalesce(day, rday), 'server=' || rserver)
  ELSE concat_ws('|', 'cache-control=max-age=600', 'content-length=0', 'date=' || n, 'etag=' || tag, 'last-modified=' || day) END AS headers
FROM judged"""


@query("op8_warc_revisits", WARC_SQL)
def op8(spark, sf_dir):
    found = warc.resolve(warc_records(table(spark, sf_dir, "pages")))
    fields = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("record_id", "refers_to", "status", F.array_join(fields, "|").alias("headers"))


# crc32 is built from its rule: the reflected polynomial 0xEDB88320, bit by bit for the 256 values of a byte.
IMPORTANCE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS start, i AS v, 0 AS k FROM range(256) AS r(i)
  UNION ALL
  SELECT start, xor(v >> 1, CASE WHEN (v & 1) = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY start) AS t FROM bits WHERE k = 8),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
doc_words AS (
  SELECT r, w, count(*) AS n FROM (
    SELECT r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM docs) GROUP BY r, w),
target_words AS (
  SELECT w, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY w),
named AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM doc_words UNION SELECT w FROM target_words)),
buckets AS (
  SELECT w, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS b
  FROM named, crc),
src AS (SELECT b, sum(n)::DOUBLE AS s FROM doc_words JOIN buckets USING (w) GROUP BY b),
tgt AS (SELECT b, sum(n)::DOUBLE AS t FROM target_words JOIN buckets USING (w) GROUP BY b),
gain AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM src), 0) + 10000)
    / ((s + 1) * (coalesce((SELECT sum(t) FROM tgt), 0) + 10000))))::BIGINT AS g
  FROM src LEFT JOIN tgt USING (b)),
weighed AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM doc_words JOIN buckets USING (w) JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (r)),
drawn AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank FROM scored WHERE n_features >= 20
  QUALIFY rank <= 10 * count(*) OVER () // 100)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (r)"""


@query("op12_importance", IMPORTANCE_SQL)
def op12(spark, sf_dir):
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
runs AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (
    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM runs, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size)),
freq AS (SELECT lang, size, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
cands AS (SELECT *, string_split(g, ' ') AS w FROM freq WHERE size >= 2),
cuts AS (
  SELECT lang, g, f AS a, k, array_to_string(w[1:k], ' ') AS g1, array_to_string(w[k + 1:], ' ') AS g2
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cands)),
scores AS (
  SELECT c.lang, c.g, a, k, x.f AS l, y.f AS r, ((a::HUGEINT * a * 1000000) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN freq x ON x.lang = c.lang AND x.g = g1 JOIN freq y ON y.lang = c.lang AND y.g = g2),
least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_runs AS (
  SELECT lang, f, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT lang, f, w, n, unnest(range(1, size - n + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS n FROM cands))),
covers AS (SELECT lang, g, max(f) AS f FROM inner_runs GROUP BY lang, g),
kept AS (SELECT s.* FROM least s LEFT JOIN covers c ON s.lang = c.lang AND s.g = c.g WHERE c.f IS NULL OR 100 * c.f < 50 * s.a),
sums AS (SELECT lang, sum(len(w))::BIGINT AS n FROM runs GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM kept JOIN sums USING (lang) QUALIFY rank <= 2000"""


@query("op13_phrases", PHRASES_SQL)
def op13(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op11_pii")
def op11(spark, sf_dir):
    """Tested by its own checks: base spans by plain patterns, the tagger's on held-out rows."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.scan(documents, pii.fit(documents.select("text")))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    text = lambda spans: F.array_join(F.transform(spans, one), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )

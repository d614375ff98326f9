"""N-gram Jaccard join by a token-group matrix."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from snipquarry.llm.common import U64, WordHashes, lists, mixed, ngrams, per_batch, signed, utf8, worker_state
from snipquarry.llm.graph import components
from snipquarry.plans.keys import lookup, marked_likely
from snipquarry.plans.scratch import written

WORDS = 5
PERCENT = 80
# Documents that one task compares with each other, and rounds of doing so by other keys.
TOGETHER = 128
ROUNDS = 3
# Shingles that are found more than so often by one task count as frequent; the most frequent ones
# stand last in the order of shingles.  This decides the work, never the result.
OFTEN = 4
MOST_FREQUENT = 300_000
# Members of a chunk of a group, and of a block of queries, that one task opens.
CHUNK = 64
QUERIES = 128
SALTS = (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F)
# Words of 64 bits of a set's parities.
PARITIES = [f"b{i + 1}" for i in range(8)]


def shingles(text: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words make one shingle of all."""
    w = text.lower().split()
    if not w:
        return np.empty(0, U64)
    n = min(words, len(w))
    return np.unique(mixed(ngrams(hashes.of(w), n) + U64(n)))


def _least_common(n, percent):
    """Least number of shingles that two linked sets share, if one has n."""
    return -(-n * percent // 100)


def _pair_links(n1, n2, common, percent):
    return 100 * common >= percent * (n1[:, None] + n2[None, :] - common)


def _common(one: list[np.ndarray], two: list[np.ndarray], columns=16_384) -> np.ndarray:
    """How many tokens each set of `one` shares with each of `two`, by products of 0/1 matrices."""
    counts = np.zeros((len(one), len(two)))
    flat1, flat2 = np.concatenate(one), np.concatenate(two)
    shared = np.intersect1d(flat1, flat2)
    row1, row2 = np.repeat(np.arange(len(one)), [*map(len, one)]), np.repeat(np.arange(len(two)), [*map(len, two)])
    if not len(shared):
        return counts

    def places(flat, rows):
        at = np.searchsorted(shared, flat)
        at[at == len(shared)] = 0
        hit = shared[at] == flat
        by = np.argsort(at[hit], kind="stable")
        return at[hit][by], rows[hit][by]

    col1, row1 = places(flat1, row1)
    col2, row2 = places(flat2, row2)
    for start in range(0, len(shared), columns):
        width = min(columns, len(shared) - start)
        parts = []
        for col, row, n in ((col1, row1, len(one)), (col2, row2, len(two))):
            a, b = np.searchsorted(col, [start, start + width])
            dense = np.zeros((n, width), np.float32)
            dense[row[a:b], col[a:b] - start] = 1
            parts.append(dense)
        counts += parts[0] @ parts[1].T
    return counts.astype(np.int64)


def _sets(column) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    flat = column.flatten().to_numpy(zero_copy_only=False).view(U64)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


# --- passes over the texts -------------------------------------------------------------


def _digest_rows(rows: DataFrame, words: int) -> DataFrame:
    """For each row (doc_id, n, s1, s2, m1 to m3): size and digest of its set and least hashes of it
    under three orders.  And rows (token, often): what a task finds often."""
    schema = "doc_id bigint, n bigint, s1 bigint, s2 bigint, m1 bigint, m2 bigint, m3 bigint, token bigint, often bigint"

    def often(sets):
        token, count = np.unique(np.concatenate(sets), return_counts=True)
        keep = count >= OFTEN
        nothing = pa.nulls(int(keep.sum()), pa.int64())
        return {c: nothing for c in ("doc_id", "n", "s1", "s2", "m1", "m2", "m3")} | {
            "token": signed(token[keep]), "often": pa.array(count[keep].astype(np.int64))
        }

    def run(batches):
        hashes = worker_state("word_hashes", WordHashes)
        arrow = pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")])
        held, n_held = [], 0
        for batch in batches:
            made = {c: [] for c in ("n", "s1", "s2", "m1", "m2", "m3")}
            for text in utf8(batch.column("text")):
                tokens = shingles(text, words, hashes)
                made["n"].append(len(tokens))
                both = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64)
                for c, v in zip(("s1", "s2", "m1", "m2", "m3"), [*both.tolist(), *_least(tokens)]):
                    made[c].append(v)
                held.append(tokens)
                n_held += len(tokens)
                if n_held > 4_000_000:
                    yield pa.RecordBatch.from_pydict(often(held), schema=arrow)
                    held, n_held = [], 0
            nothing = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **made, "token": nothing, "often": nothing}, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pydict(often(held), schema=arrow)

    return rows.mapInArrow(run, schema)


def _frequent(digests: DataFrame, most: int):
    """Frequent shingles by hash, with their place in the order; copied to the tasks, `most` at most."""
    sums = digests.filter("token IS NOT NULL").groupBy("token").agg(F.sum("often").alias("often"))
    table = sums.orderBy(F.desc("often"), "token").limit(most).toArrow()
    token = table.column("token").to_numpy().view(U64)
    by = np.argsort(token)
    # Those that occur often come last.
    return token[by], (len(token) - np.arange(len(token), dtype=np.int64))[by]


def _prefix(tokens: np.ndarray, percent, frequent, place) -> np.ndarray:
    """The tokens of which linked sets share at least one: the first in the common order."""
    n = len(tokens)
    size = n - _least_common(n, percent) + 1
    if not len(frequent):
        return tokens[:size]
    at = np.searchsorted(frequent, tokens)
    at[at == len(frequent)] = 0
    late = np.where(frequent[at] == tokens, place[at], 0)
    return tokens[np.lexsort((tokens, late))[:size]]


def _least(tokens: np.ndarray) -> list[int]:
    """Least hashes of a set under three orders."""
    return [int(mixed(tokens ^ U64(salt)).min().view(np.int64)) if len(tokens) else 0 for salt in SALTS]


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, by bit, whether it has an odd number of tokens with that place: two sets differ by at least
    as many tokens as these differ by bits."""
    bits = 64 * len(PARITIES)
    row = np.repeat(np.arange(len(sets)), [*map(len, sets)])
    at = row * bits + (np.concatenate(sets) & U64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(sets) * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(len(sets), len(PARITIES))


def _token_rows(rows: DataFrame, words, percent, frequent) -> DataFrame:
    """(doc_id, s1, s2, n, b1 to b8, prefix, tokens) of rows (doc_id, text, full): whole sets where `full`."""
    copied = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batch):
        hashes = worker_state("word_hashes", WordHashes)
        sets = [shingles(t, words, hashes) for t in utf8(batch.column("text"))]
        prefixes = [_prefix(s, percent, *copied.value) if len(s) else s for s in sets]
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
        full = batch.column("full").to_pylist()
        none = np.empty(0, U64)
        return {
            "doc_id": batch.column("doc_id"), "s1": digest[:, 0], "s2": digest[:, 1], "n": [*map(len, sets)],
            **dict(zip(PARITIES, _parities(sets).T)), "prefix": lists(prefixes), "tokens": lists([s if f else none for s, f in zip(sets, full)]),
        }

    schema = ", ".join(f"{c} bigint" for c in ("doc_id", "s1", "s2", "n", *PARITIES)) + ", prefix array<bigint>, tokens array<bigint>"
    return per_batch(rows.select("doc_id", "text", "full"), run, schema)


def _spare(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, s1, s2, again) of rows that do not stand for their class, or more than once (again)."""
    several = classes.filter("rows > 1").select("s1", "s2", "node", "rows")
    held = lookup(rows.select("doc_id", "s1", "s2"), several, ["s1", "s2"], "rows").filter("node IS NOT NULL")
    counted = held.groupBy("doc_id", "s1", "s2", "node").agg(F.count(F.lit(1)).alias("times"))
    return counted.filter("doc_id <> node OR times > 1").select("doc_id", "s1", "s2", (F.col("doc_id") == F.col("node")).alias("again"))


def _representatives(rows: DataFrame, spare: DataFrame) -> DataFrame:
    """One row for each class, with doc_id as `node`; only rows that may be spare are shuffled."""
    key, columns = ["doc_id", "s1", "s2"], [c for c in rows.columns if c not in ("s1", "s2")]
    marked = marked_likely(rows, spare, key, "_spare")
    some = marked.filter("_spare").drop("_spare").join(spare.hint("merge"), key, "left")
    some = some.filter("again IS NULL OR again").dropDuplicates(key)
    out = some.select(*columns).unionByName(marked.filter("NOT _spare").select(*columns))
    return out.withColumnRenamed("doc_id", "node")


# --- groups ----------------------------------------------------------------------------


def _bucket_links(members: DataFrame, percent: int) -> DataFrame:
    """Compare what is together in (bucket, part); (node, leader, keep): leader is the smallest node
    that links in the part lead to."""

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        sets = _sets(table.column("tokens"))
        n = np.array([*map(len, sets)])
        linked = _pair_links(n, n, _common(sets, sets), percent)
        leader = np.arange(len(nodes))
        for i in np.argsort(nodes):
            if leader[i] == i:
                stack = [i]
                seen = {i}
                while stack:
                    for j in np.flatnonzero(linked[stack.pop()]).tolist():
                        if j not in seen:
                            seen.add(j)
                            stack.append(j)
                leader[list(seen)] = i
        return pa.table({"node": nodes, "leader": nodes[leader]})

    return members.groupBy("bucket", "part").applyInArrow(run, "node bigint, leader bigint")


def _bucket(i: int):
    """Key of a round: one of the least hashes."""
    return F.col(f"m{i}").alias("bucket")


def _group_rounds(nodes: DataFrame, sets: DataFrame, percent, together, rounds) -> DataFrame:
    """Groups (node, component) of documents (node, m1 to m3; node, tokens) that share least hashes and link.

    Round by round, and only leaders go on.  A bucket of any size is cut into parts by a hash.
    `component` is the group's last leader; documents without a link are in no group.
    """
    links = []
    for i in range(1, rounds + 1):
        keyed = nodes.select("node", _bucket(i))
        sizes = written(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
        part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / together))
        placed = lookup(keyed, sizes, ["bucket"], "size").filter("size IS NOT NULL").select("node", "bucket", part.alias("part"))
        placed = written(placed, "placed")
        near = marked_likely(sets, placed.select("node"), ["node"], "_near").filter("_near").select("node", "tokens")
        found = _bucket_links(near.join(placed.hint("merge"), "node"), percent).filter("node <> leader")
        links.append(written(found, "bucket_links"))
        if i < rounds:
            nodes = nodes.join(links[-1].select("node"), "node", "left_anti")
    # A document follows once, so from the last round back each leader's own leader is known.
    groups = links[-1].select("node", F.col("leader").alias("component"))
    for earlier in links[-2::-1]:
        leaders = earlier.groupBy("leader").agg(F.count(F.lit(1)).alias("followers"))
        known = leaders.join(groups.withColumnRenamed("node", "leader"), "leader", "left")
        known = written(known.select("leader", "followers", F.coalesce("component", "leader").alias("component")), "leaders")
        groups = groups.unionByName(lookup(earlier, known, ["leader"], "followers").select("node", "component"))
    groups = written(groups, "followers")
    return written(groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct()), "groups")


def _components(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(root, component_id, members) for groups (node, component) and links (a, b) between documents of them
    or alone: the smallest document of what the links join, for every group and every linked document."""

    def root(end):
        own = groups.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
        return own, F.coalesce(f"_{end}", end).alias(end)

    (left, a), (right, b) = root("a"), root("b")
    joined = written(components(links.join(left, "a", "left").join(right, "b", "left").select(a, b)), "joined")
    sizes = groups.groupBy(F.col("component").alias("root")).agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("members"))
    each = written(sizes.join(joined.withColumnRenamed("node", "root"), "root", "full").select(
        "root", F.coalesce("component", "root").alias("component"), F.coalesce("low", "root").alias("low"), F.coalesce("members", F.lit(1)).alias("members"),
    ), "roots")
    lowest = each.groupBy("component").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    return lookup(each, written(lowest, "lowest"), ["component"], "n").select("root", "component_id", "members")


# --- the matrix ------------------------------------------------------------------------


def _asked(asking: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """(query, group, n, least, most) for each token of a query that the matrix has for a larger group.

    Where one member alone has the token, the parities bound how many tokens it differs by from the query, and
    too many give no row.  So documents that are alike, but too little to link, are not paired token by token.
    """
    bits = [b for b in PARITIES if b in matrix.columns]
    target = matrix.select(
        "token", F.col("group").alias("target"), F.col("size").alias("target_size"), "least", "most", "holders", *[F.col(b).alias(f"_{b}") for b in bits]
    )
    smaller = (F.col("size") < F.col("target_size")) | (F.col("size") == F.col("target_size")) & (F.col("group") > F.col("target"))
    fits = (F.col("most") * 100 >= F.col("n") * percent) & (F.col("least") * percent <= F.col("n") * 100)
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"_{b}"))) for b in bits), F.lit(0))
    near = (F.col("holders") > 1) | (differ * (100 + percent) <= (F.col("n") + F.col("most")) * (100 - percent))
    joined = asking.join(target, "token").filter(smaller & fits & near)
    return joined.select(F.col("node").alias("query"), F.col("target").alias("group"), "n", "least", "most")


def _candidates(prefixes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(query, group): documents and other groups that share a token which linked ones must share.

    `prefixes` has (node, n, prefix) and may have b1 to b8, `groups` (node, component) of nodes that are not alone.
    The matrix has a row for each token and group, with the sizes of the members that have the token.
    Of two groups the documents of the smaller are the queries; the tokens that a query shares with
    a group bound its overlap with every member.
    """
    bits = [b for b in PARITIES if b in prefixes.columns]
    rows = prefixes.select(F.explode("prefix").alias("token"), "node", "n", *bits)
    tokens = rows.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    tokens = written(tokens.filter("held > 1"), "shared_tokens")
    likely = marked_likely(rows, tokens, ["token"], "_likely").filter("_likely").drop("_likely")
    rows = written(lookup(likely, tokens, ["token"], "held").filter("held IS NOT NULL").drop("held"), "shared_rows")
    sizes = written(groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "group_sizes")
    sized = lookup(groups, sizes, ["component"], "size")
    rows = rows.join(sized, "node", "left").select(
        "token", "node", "n", F.coalesce("component", "node").alias("group"), F.coalesce("size", F.lit(1)).alias("size"), *bits
    )
    rows = written(rows, "matrix_rows")
    matrix = rows.groupBy("token", "group", "size").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("holders"), *[F.min(b).alias(b) for b in bits]
    )
    matrix = written(matrix, "matrix")
    top = matrix.groupBy("token").agg(F.max("size").alias("top"), F.sum("size").alias("weight"))
    # A document of the only largest group of a token asks nobody.
    largest = matrix.groupBy("token", "size").agg(F.count(F.lit(1)).alias("as_large"))
    alone = top.join(largest.select("token", F.col("size").alias("top"), "as_large"), ["token", "top"])
    alone = written(alone.select("token", F.when(F.col("as_large") == 1, F.col("top")).otherwise(F.col("top") + 1).alias("below"), "weight"), "largest")
    asking = written(lookup(rows, alone, ["token"], "weight").filter("size < below").drop("below", "weight"), "asking")
    pairs = _asked(asking, matrix, percent).groupBy("query", "group").agg(
        F.count(F.lit(1)).alias("common"), F.min("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    # How many of the tokens at the front must be common.  Of two linked sets, all tokens of one's
    # front that the other has stand in the other's front, so the overlap is at most what the fronts
    # share and what stands behind the one's front.  Up to the query's own size this grows with the
    # member's size m, rounding included, and is least at `low`.  Beyond, rounding makes it go up and
    # down, but a difference of ceilings is never less than the floor of the plain difference, which
    # falls with m and is least at `high`.
    n, low, high = F.col("n"), F.greatest("least", F.ceil(F.col("n") * percent / 100)), F.least("most", F.floor(F.col("n") * 100 / percent))
    smaller_need = F.ceil((n + low) * percent / (100 + percent)) - F.ceil(n * percent / 100) + 1
    larger_need = F.floor((n * 100 - high * percent) * percent / (100 * (100 + percent))) + 1
    need = F.least(F.when(low <= n, smaller_need), F.when(high > n, larger_need))
    return written(pairs.filter(F.col("common") >= need).select("query", "group"), "candidates")


def _opened(pairs: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of queries with the chunks of groups that `pairs` (query, group, chunk) name.

    A task has one chunk and a block of queries.  It first bounds each query's overlap by the
    chunk's token union, and compares members only where the bound allows a link.
    """
    many = pairs.groupBy("group", "chunk").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("blocks"))
    many = written(many, "blocks")
    asked = pairs.join(many, ["group", "chunk"])
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")))
    asked = asked.join(sets.select(F.col("node").alias("query"), "tokens"), "query")
    left = members.join(many, ["group", "chunk"]).join(sets, "node")
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def run(held: pa.Table, asking: pa.Table) -> pa.Table:
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not held.num_rows or not asking.num_rows:
            return empty
        nodes, queries = held.column("node").to_numpy(), asking.column("_query").to_numpy()
        own, asked = _sets(held.column("tokens")), _sets(asking.column("_tokens"))
        n, q = np.array([*map(len, own)]), np.array([*map(len, asked)])
        union = np.unique(np.concatenate(own))
        bound = _common(asked, [union])[:, 0]
        need = -(-percent * (q + n.min()) // (100 + percent))
        open_ = np.flatnonzero(bound >= need)
        if not len(open_):
            return empty
        linked = _pair_links(q[open_], n, _common([asked[i] for i in open_], own), percent)
        hit = linked.any(axis=1)
        return pa.table({"a": queries[open_[hit]], "b": nodes[linked[hit].argmax(axis=1)]})

    keys = ["group", "chunk", "block"]
    # Both sides come from the same tables; new names keep their columns apart.
    asked = asked.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "query", "tokens")])
    grouped = left.select(*keys, "node", "tokens").groupBy(*keys)
    return grouped.cogroup(asked.groupBy(*[f"_{c}" for c in keys])).applyInArrow(run, "a bigint, b bigint")


def similar(
    documents: DataFrame, words=WORDS, percent=PERCENT, together=TOGETHER, rounds=ROUNDS, frequent=MOST_FREQUENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of documents (doc_id, text).

    A text's set is its distinct shingles of `words` words (A-Z lower-cased, split at ASCII white
    space), or all its words as one shingle where it has fewer; a text without words, or a
    missing one, has none and is linked with nothing.  Texts link when 100 * common shingles
    >= `percent` * all shingles of the two; `component_id` is the smallest doc_id that links lead
    to.  Rows with the same set link; each repeated row gets its row.  Ids are whole numbers; a
    row without one links nothing and has no component.  Other columns are not used.

    1. Rows with one set are one class from here on, represented by their smallest id.
    2. Documents that share a least hash are compared in parts of `together`; what links becomes
       a group, and its leader goes on to the next round with another hash.
    3. The token-group matrix holds, for each group, the tokens of its members of which two linked
       documents must share one (prefixes in an order that puts frequent shingles last).
       Documents whose tokens meet those of a larger group are that group's queries, unless the parities of
       the two sets tell that they differ by too much.
    4. A query's overlap with the token union of a chunk of the group is bounded, and the chunk
       opened only if the bound allows a link.  Further chunks are opened only for queries without
       a link to the first.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digests = written(_digest_rows(rows, words), "digests")
    sized = digests.filter("n IS NOT NULL")
    in_part = sized.filter("n > 0 AND doc_id IS NOT NULL")
    classes = written(
        in_part.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows"), *[F.min(f"m{i}").alias(f"m{i}") for i in (1, 2, 3)]),
        "classes",
    )
    nodes = classes.select("node", "s1", "s2", "m1", "m2", "m3")
    wanted = None
    for i in range(1, rounds + 1):
        keyed = nodes.select("node", _bucket(i))
        shared = written(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), "shared_hashes")
        one = lookup(keyed, shared, ["bucket"], "many").filter("many IS NOT NULL").select("node")
        wanted = one if wanted is None else wanted.unionByName(one)
    wanted = written(wanted.distinct(), "wanted")
    marked = marked_likely(rows, wanted.select(F.col("node").alias("doc_id")), ["doc_id"], "full")
    tokens = _token_rows(marked, words, percent, _frequent(digests, frequent)).filter("n > 0 AND doc_id IS NOT NULL")
    tokens = written(tokens.select("doc_id", "s1", "s2", "n", *PARITIES, "prefix", "tokens"), "tokens")
    spare = written(_spare(in_part, classes), "spare")
    prefixes = _representatives(tokens.select("doc_id", "s1", "s2", "n", *PARITIES, "prefix"), spare)
    held = _representatives(tokens.filter(F.size("tokens") > 0).select("doc_id", "s1", "s2", "tokens"), spare)

    groups = _group_rounds(nodes.select("node", "m1", "m2", "m3"), held, percent, together, rounds)
    pairs = _candidates(prefixes, groups, percent)

    # Members of the groups that are asked, cut into chunks; a document that is alone is its group.
    asked = written(pairs.select("group").distinct(), "asked")
    in_groups = groups.join(asked, groups.component == asked.group).select("node", "group")
    sizes = written(in_groups.groupBy("group").agg(F.count(F.lit(1)).alias("size")), "asked_sizes")
    chunks = F.ceil(F.col("size") / CHUNK)
    alone = asked.join(sizes, "group", "left_anti").select(F.col("group").alias("node"), "group", F.lit(0).cast("long").alias("chunk"))
    cut = lookup(in_groups, sizes, ["group"], "size").select("node", "group", F.pmod(F.xxhash64("node"), chunks).alias("chunk"))
    members = written(cut.unionByName(alone), "members")
    need = written(members.select("node").unionByName(pairs.select(F.col("query").alias("node"))).distinct(), "opened")
    likely = marked_likely(rows, need.select(F.col("node").alias("doc_id")), ["doc_id"], "full").filter("full")
    sets = _token_rows(likely, words, percent, (np.empty(0, U64), np.empty(0, np.int64)))
    sets = _representatives(sets.select("doc_id", "s1", "s2", "tokens"), spare)
    sets = written(sets.join(need.hint("merge"), "node", "left_semi").select("node", "tokens"), "sets")

    with_size = pairs.join(sizes, "group", "left").withColumn("chunks", F.coalesce(chunks, F.lit(1)))
    first = F.pmod(F.xxhash64("query"), F.col("chunks"))
    found = written(_opened(with_size.select("query", "group", first.alias("chunk")), members, sets, percent), "opened_links")
    done = found.join(members, found.b == members.node).select(F.col("a").alias("query"), "group")
    rest = with_size.filter("chunks > 1").join(done, ["query", "group"], "left_anti")
    rest = rest.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).filter(F.col("chunk") != first)
    more = written(_opened(rest.select("query", "group", "chunk"), members, sets, percent), "opened_links")

    roots = written(_components(groups, found.unionByName(more)), "components")
    # A class is one row here; a group of very many classes is looked up apart.
    rooted = classes.select("s1", "s2", "node", "rows").join(groups, "node", "left").withColumn("root", F.coalesce("component", "node"))
    labels = lookup(rooted.select("s1", "s2", "rows", "root"), roots, ["root"], "members")
    labels = written(labels.select("s1", "s2", F.coalesce("component_id", "root").alias("component_id"), "rows"), "labels")
    every = lookup(sized.select("doc_id", "n", "s1", "s2"), labels, ["s1", "s2"], "rows")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return every.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))

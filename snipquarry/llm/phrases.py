"""Phrase collocations by dynamic itemset counting over shards of the texts."""

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from snipquarry.llm.common import U64, mixed, sliced, strings, utf8
from snipquarry.plans.keys import lookup, marked_likely
from snipquarry.plans.scratch import scratch_dir, written, written_rows

UNKNOWN = "und"
# Shards that a cycle scans.  Lengths are activated between scans, so more shards mean earlier starts and more scans.
SHARDS = 4
# Tokens of a stored row, 256 KB of them, and of one round of counting in a task (pieces are never cut).  Arrays of more
# than half a region of a small heap, 512 KB, take whole regions of it.
CHUNK_TOKENS = 1 << 15
ROUND_TOKENS = 1 << 18
# Bits of a filter for each phrase that has reached the threshold when it is first made, and most bits of it: 16 MB.
PHRASE_BITS = 64
FILTER_BITS = 1 << 27
# Hashes of words that a task holds in all.
HELD_WORDS = 300_000
# Rows of counts that go to Spark together, and files that a task writes at a time.
COUNT_ROWS = 50_000
OPEN_FILES = 32
PROBES = 3

# White space within a piece becomes a space; what ends a piece becomes a byte that UTF-8 never holds.
END = b"\xff"
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256)
)


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, with END wherever a piece ends."""
    return text.translate(_FOLD).replace(END, b" \xff ").split()


class _Hashes(dict):
    """64-bit hashes of the words of one language, 0 for END; `news` are those that it did not hold, until it is emptied."""

    def __init__(self, lang: str, seed: int, most: int):
        self.seed, self.news, self.most = xxhash.xxh3_64_intdigest(lang.encode(), seed), [], most
        self[END] = 0

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
            self[END] = 0
            if word == END:
                return 0
        self[word] = value = xxhash.xxh3_64_intdigest(word, self.seed) or 1
        self.news.append((value, word))
        return value


def _stored(documents: DataFrame, shards: int, seed: int) -> DataFrame:
    """Shards of hashed words, stored.

    Rows are (shard, tokens) with the hashes of many pieces, ended by 0; and, with shard -1, (h, lang,
    word) for each word of a task and (lang, n) with how many words it read.
    """
    schema = pa.schema([("shard", pa.int32()), ("tokens", pa.binary()), ("h", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def rows(**columns):
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([
            pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema
        ], schema=schema)

    def run(batches):
        shard = itertools.count(TaskContext.get().partitionId())
        held = {}  # by language: hashes, arrays that wait, their size

        def flush(lang):
            hashes, waiting, size = held[lang]
            made = np.concatenate(waiting)
            if hashes.news:
                h = np.array([h for h, _ in hashes.news], U64).view(np.int64)
                yield rows(shard=[-1] * len(h), h=h, lang=[lang] * len(h), word=[w.decode() for _, w in hashes.news])
                hashes.news = []
            yield rows(shard=[next(shard) % shards], tokens=[made.tobytes()])
            yield rows(shard=[-1], lang=[lang], n=[int(np.count_nonzero(made))])
            waiting.clear()
            held[lang][2] = 0

        for batch in sliced(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
                w = tokens(text)
                if not w:
                    continue
                lang = UNKNOWN if lang is None else lang
                if lang not in held:
                    if len(held) >= 64:
                        # Very many languages: give their memory back.
                        for other in held:
                            if held[other][1]:
                                yield from flush(other)
                        held.clear()
                    held[lang] = [_Hashes(lang, seed, HELD_WORDS), [], 0]
                    for own, _, _ in held.values():
                        own.most = HELD_WORDS // len(held)
                own = held[lang]
                own[1].append(np.fromiter(map(own[0].__getitem__, itertools.chain(w, (END,))), U64, len(w) + 1))
                own[2] += len(w) + 1
                if own[2] >= CHUNK_TOKENS:
                    yield from flush(lang)
        for lang in held:
            if held[lang][1]:
                yield from flush(lang)

    spark, path = documents.sparkSession, scratch_dir(documents.sparkSession, "shards")
    texts = documents.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    made = texts.mapInArrow(run, "shard int, tokens binary, h bigint, lang string, word string, n bigint")
    _write_by(made, "shard", path)
    return spark.read.schema(made.schema).parquet(path)


def _write_by(rows: DataFrame, column: str, path: str) -> None:
    """Write rows in folders by a column of few values, with a file open for each of them instead of a sort."""
    conf, name = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, OPEN_FILES)
    try:
        rows.write.partitionBy(column).parquet(path)
    finally:
        conf.set(name, before)


class Filter:
    """Bloom filter over 64-bit hashes; phrases are only ever added, and its size stays."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(h: np.ndarray, bits: int) -> np.ndarray:
        other = mixed(h) | U64(1)
        return np.stack([(h + U64(i) * other) & U64(bits - 1) for i in range(PROBES)])

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in self.places(h, len(self.words) * 64):
            found &= (self.words[at >> U64(6)] >> (at & U64(63))) & U64(1) != 0
        return found


def _run_hashes(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, from those of the runs less their last word."""
    return mixed(h * U64(0x9E3779B97F4A7C15) + last)


def _counted(words: np.ndarray, single: bool, filters: dict) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(length, its words, counts) of the active phrases in hashed words, which 0 ends.

    `filters` has, by length, the filter of parts (one word shorter) that have reached the
    threshold by now, and that of a cycle ago: what passed this one has completed its cycle.
    Equal phrases are found by numbering equal parts, not by their hashes.
    """
    distinct, number = np.unique(words, return_inverse=True)
    if single:
        n = np.bincount(number, minlength=len(distinct))
        real = distinct != 0
        yield 1, [distinct[real]], n[real]
    h, inside = words, words != 0
    for size in range(2, max(filters, default=1) + 1):
        k = len(words) - size + 1
        if k <= 0:
            break
        inside = inside[:k] & (words[size - 1:] != 0)
        if size in filters:
            now, before = filters[size]
            at = np.flatnonzero(inside)
            passed = now.has(h)
            active = passed[at] & passed[at + 1]
            if before is not None:
                old = before.has(h)
                active &= ~(old[at] & old[at + 1])
            at = at[active]
            part = number[at]
            for j in range(1, size):
                found = np.unique(part * len(distinct) + number[at + j], return_index=True, return_inverse=True, return_counts=True)
                part = found[2]
            if len(at):
                first = at[found[1]]
                yield size, [words[first + j] for j in range(size)], found[3]
        h = _run_hashes(h[:k], words[size - 1:])


def _scan(shard: DataFrame, single: bool, filters: dict, longest: int) -> DataFrame:
    """(size, w1, w2, ..., n): the active phrases of a shard with their counts, added up by task."""
    names = ["size", *[f"w{i + 1}" for i in range(longest)], "n"]

    def rows(buffer):
        loaded = {size: (now.value, before and before.value) for size, (now, before) in filters.items()}
        for size, columns, n in _counted(np.concatenate(buffer), single, loaded):
            for start in range(0, len(n), COUNT_ROWS):
                part = slice(start, start + COUNT_ROWS)
                none = np.zeros(len(n[part]), np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(none + size, pa.int32()), *[pa.array(c[part].view(np.int64)) for c in columns],
                    *[pa.array(none)] * (longest - size), pa.array(n[part], pa.int64()),
                ], names=names)

    def run(batches):
        buffer, held = [], 0
        for batch in sliced(batches, 1):
            for row in batch.column("tokens").to_pylist():
                buffer.append(np.frombuffer(row, U64))
                held += len(buffer[-1])
            if held >= ROUND_TOKENS:
                yield from rows(buffer)
                buffer, held = [], 0
        if buffer:
            yield from rows(buffer)

    words = names[1:-1]
    found = shard.select("tokens").mapInArrow(run, "size int, " + ", ".join(f"{w} bigint" for w in words) + ", n bigint")
    return found.groupBy("size", *words).agg(F.sum("n").alias("n"))


def _of_size(tables: list[DataFrame], size: int) -> DataFrame:
    """(w1, ..., n): the rows of phrases of one length in tables of counts."""
    rows = [t.filter(F.col("size") == size).select(*[f"w{i + 1}" for i in range(size)], "n") for t in tables]
    return functools.reduce(DataFrame.unionByName, rows)


def _summed(rows: DataFrame, wanted: DataFrame, threshold: int) -> DataFrame:
    """(w1, ..., n): the sums of `rows` for phrases that are in `wanted` (w1, ...) and reach the threshold.

    Rows of nearly all other phrases are left out before any are brought together.
    """
    likely = marked_likely(rows, wanted, wanted.columns, "_likely").filter("_likely")
    return likely.groupBy(*wanted.columns).agg(F.sum("n").alias("n")).filter(F.col("n") >= threshold)


def _strong(rows: DataFrame, threshold: int, most: int) -> DataFrame:
    """(w1, ...): phrases that may reach the threshold: each is in at most `most` tables, so one of them
    has its share of it."""
    return rows.filter(F.col("n") >= -(-threshold // most)).drop("n")


def _added(old: np.ndarray, reached: DataFrame, size: int) -> np.ndarray:
    """The words of a filter with the hashes of phrases (w1, ...) added to it."""
    bits = len(old) * 64

    def run(batches):
        made = np.zeros(bits // 64, U64)
        for batch in batches:
            columns = [batch.column(i).to_numpy().view(U64) for i in range(size)]
            h = columns[0]
            for last in columns[1:]:
                h = _run_hashes(h, last)
            for at in Filter.places(h, bits):
                np.bitwise_or.at(made, at >> U64(6), U64(1) << (at & U64(63)))
        used = np.flatnonzero(made)
        yield pa.RecordBatch.from_pydict({"at": pa.array(used, pa.int64()), "bits": pa.array(made[used].view(np.int64))})

    found = reached.select(*[f"w{i + 1}" for i in range(size)]).mapInArrow(run, "at bigint, bits bigint")
    # No more rows than the filter has words.
    rows = found.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    new = old.copy()
    new[rows.column("at").to_numpy()] |= rows.column("bits").to_numpy().view(U64)
    return new


def frequent_phrases(stored: DataFrame, threshold: int, longest: int, shards: int, filter_bits: int) -> dict[int, DataFrame]:
    """{length: (w1, ..., n)}, stored: all phrases of 1 to `longest` hashed words that occur `threshold` times.

    Shards are scanned one after another, in cycles.  Words are counted from the first scan on.
    Between scans, a longer phrase is activated once its first and its last words (all but one) have
    both reached the threshold in what is counted so far, and is then counted in each shard once: until the
    scan of a cycle later.  A part occurs as often as what holds it, so no frequent phrase is left out.
    What is active follows from two Bloom filters, that of now and that of a cycle ago.  They only grow, so
    a phrase that passes by chance is counted in each shard once, too: all counts are exact.
    """
    spark = stored.sparkSession
    # By length of a phrase: the filter of its parts before each step (none yet: None), and the last step that changed it.
    filters = {size: [] for size in range(2, longest + 1)}
    words = {size: None for size in filters}
    changed = {size: None for size in filters}
    # By length: stored phrases that have reached the threshold, and the step that first counted any.
    reached, began, tables = {part: [] for part in range(1, longest)}, {1: 0}, []
    for step in itertools.count():
        for size, history in filters.items():
            if words[size] is not None and changed[size] == step:
                made = Filter(words[size])
                history.append(spark.sparkContext.broadcast(made))
            else:
                history.append(history[-1] if history else None)
        active = {
            size: (history[step], history[step - shards] if step >= shards else None)
            for size, history in filters.items() if changed[size] is not None and step < changed[size] + shards
        }
        if step >= shards and not active:
            break
        for size in active:
            began.setdefault(size, step)
        shard = stored.filter(F.col("shard") == step % shards)
        path = scratch_dir(spark, "counted")
        counted = _scan(shard, step < shards, active, longest)
        _write_by(counted, "size", path)
        tables.append(spark.read.schema(counted.schema).parquet(path))
        for part in range(1, longest):
            if part in active or part == 1 and step < shards:
                # What is active now was first counted less than a cycle ago.
                window = tables[max(began[part], step + 1 - shards):]
                rows = _of_size(window, part)
                if len(window) == 1:
                    found = rows.filter(F.col("n") >= threshold).drop("n")
                else:
                    # After a cycle only few are still counted, and only these can get there.
                    late = step >= began[part] + shards
                    maybe = _of_size(tables[-1:], part).drop("n") if late else _strong(rows, threshold, shards)
                    for done in reached[part]:
                        maybe = maybe.join(done, done.columns, "left_anti")
                    found = _summed(rows, written(maybe, "maybe"), threshold).drop("n")
                found, n = written_rows(found, "reached")
                reached[part].append(found)
                if not n:
                    continue
                old = words[part + 1]
                if old is None:
                    old = np.zeros(max(1, (1 << (min(PHRASE_BITS * n, filter_bits) - 1).bit_length()) >> 6), U64)
                new = _added(old, found, part)
                if not np.array_equal(new, old):
                    words[part + 1], changed[part + 1] = new, step + 1
    out = {}
    for size in range(1, longest + 1):
        rows = _of_size(tables, size)
        if size < longest:
            # Whatever is frequent has reached the threshold when its cycle ended, if not before.
            wanted = functools.reduce(DataFrame.unionByName, reached[size]) if reached[size] else rows.limit(0).drop("n")
        else:
            wanted = written(_strong(rows, threshold, shards), "maybe")
        out[size] = written(_summed(rows, wanted, threshold), "frequent")
    for history in filters.values():
        for copied in history:
            if copied is not None:
                copied.unpersist()
    return out


def _named(documents: DataFrame, shards: int) -> DataFrame:
    """Stored shards, hashed with another seed where two words share a hash."""
    for seed in itertools.count():
        stored = _stored(documents, shards, seed)
        other = F.xxhash64("lang", "word")
        found = stored.filter("shard = -1 AND h IS NOT NULL").groupBy("h").agg(F.min(other).alias("least"), F.max(other).alias("most"))
        if found.filter("least <> most").isEmpty():
            return stored


def _frequent_words(stored: DataFrame, counts: DataFrame) -> DataFrame:
    """(w1, n, lang, word) of the frequent words, stored."""
    wanted = counts.select(F.col("w1").alias("h"), "n")
    rows = marked_likely(stored.filter("shard = -1 AND h IS NOT NULL"), wanted, ["h"], "_likely").filter("_likely")
    names = rows.groupBy("h").agg(F.first("lang").alias("lang"), F.first("word").alias("word"))
    return written(names.join(wanted, "h").select(F.col("h").alias("w1"), "n", "lang", "word"), "frequent_words")


def _scored(counts: dict[int, DataFrame], words: DataFrame, size: int, longest: int, share: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates of a length that no longer one covers."""
    keys = [f"w{i + 1}" for i in range(size)]
    rows, inner = counts[size].withColumnRenamed("n", "a"), None
    for longer in range(size + 1, longest + 1):
        runs = F.array(*[F.struct(*[F.col(f"w{i + j + 1}").alias(w) for j, w in enumerate(keys)]) for i in range(longer - size + 1)])
        held = counts[longer].select(F.explode(runs).alias("run"), "n").select("run.*", "n")
        inner = held if inner is None else inner.unionByName(held)
    if inner is not None:
        most = inner.groupBy(*keys).agg(F.max("n").alias("_longer"))
        rows = rows.join(most, keys, "left").filter(F.coalesce(100 * F.col("_longer") < share * F.col("a"), F.lit(True))).drop("_longer")
    # A word's or part's own count tells in how many phrases it can be.
    for i, w in enumerate(keys):
        own = words.select(F.col("w1").alias(w), F.col("n").alias(f"_n{i}_1"), F.col("word").alias(f"_word{i}"), *([F.col("lang")] if i == 0 else []))
        rows = lookup(rows, own, [w], f"_n{i}_1")
    for part in range(2, size):
        for i in (0, size - part):
            own = counts[part].select(*[F.col(f"w{j + 1}").alias(keys[i + j]) for j in range(part)], F.col("n").alias(f"_n{i}_{part}"))
            rows = lookup(rows, own, keys[i:i + part], f"_n{i}_{part}")
    # Up to 38 digits: exact for counts below 10 ** 16.
    score = "CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)) * 1000000 div (CAST({l} AS DECIMAL(19, 0)) * CAST({r} AS DECIMAL(19, 0)))"
    cuts = []
    for k in range(1, size):
        l, r = f"_n0_{k}", f"_n{k}_{size - k}"
        cuts.append(F.struct(F.expr(score.format(l=l, r=r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")))
    phrase = F.concat_ws(" ", *[f"_word{i}" for i in range(size)]).alias("phrase")
    found = rows.select("lang", phrase, "a", F.array_min(F.array(*cuts)).alias("_cut"))
    return found.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")


def collocations(
    documents: DataFrame, lengths=(2, 3), threshold=10, share=50, most=2000, shards=SHARDS, filter_bits=FILTER_BITS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the strongest phrases of each language of documents (text, lang).

    A phrase of `lengths[0]` to `lengths[1]` words within a piece of a text is a candidate if it occurs a >= `threshold`
    times.  Its score is the least, over the places k where it can be cut in two parts that occur l and r
    times, of a * a / (l * r) in millionths, rounded down; the smallest such k gives l and r.  Candidates
    whose words lie inside a longer candidate that has `share` percent of their count are dropped.  The first `most` of a
    language stay: by score, then a, both falling, then phrase.  n is the number of words of the language.

    A missing or empty text has no words; a missing language counts as "und"; repeated rows count
    again; empty tables give no rows; ids and other columns are not looked at.
    """
    shortest, longest = lengths
    stored = _named(documents, shards)
    counts = frequent_phrases(stored, threshold, longest, shards, filter_bits)
    words = _frequent_words(stored, counts[1])
    found = None
    for size in range(shortest, longest + 1):
        own = written(_scored(counts, words, size, longest, share), "scored")
        found = own if found is None else found.unionByName(own)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # First within parts of a language, so that none is ranked in one task as a whole.
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    near = found.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= most)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    # One row a language.
    sums = F.broadcast(stored.filter("shard = -1 AND n IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")))
    return ranked.join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

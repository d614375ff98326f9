"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm."""

import bisect
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from snipquarry.llm.common import per_batch, utf8, worker_state
from snipquarry.plans.scratch import written, written_rows

SIZE = 4096
END_ID = 1
# Pieces that one group of islands packs, and islands, members, rounds and generations of each.
SHARD = 4096
ISLANDS = 3
POPULATION = 4
ROUNDS = 2
GENERATIONS = 4
# Sequences filled less than this are opened again at the next level.
WELL_FILLED = 0.995

# --- tokens ----------------------------------------------------------------------------

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]?)")
_SAFE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
# Fixed value: how the tokenizer file splits a normalised word, over the safe characters.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class _Bounded(dict):
    def __init__(self, most):
        self.most = most

    def keep(self, key, value):
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class _Pieces(_Bounded):
    """Ids of parts of a word that is normalised and split already."""

    def __init__(self, path, most):
        super().__init__(most)
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.normalizer = None
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, piece):
        ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return self.keep(piece, _raw(ids))


def _raw(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Words(_Bounded):
    """Ids (as bytes) of what stands between ASCII white space, by the whole tokenizer.

    Nothing that the tokenizer does reaches over white space, so a text's ids are those of its
    words, and a word is tokenised once.  Words of usual letters and signs that are split and
    lower-cased by rule go part by part, all others through the tokenizer as they are.
    """

    def __init__(self, path, most=300_000, most_pieces=800_000):
        super().__init__(most)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(path, most_pieces)

    def __missing__(self, word):
        text = word.decode()
        if plain := _PLAIN.fullmatch(text):
            letters, sign = plain.groups()
            ids = self.pieces[letters.lower()] + (self.pieces[sign] if sign else b"")
        elif _SAFE.fullmatch(text) and "<|" not in text:
            ids = b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))
        else:
            ids = _raw(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return self.keep(word, ids)


def tokenised(documents: DataFrame, path: str, size=SIZE, end_id=END_ID, most_words=300_000, most_pieces=800_000) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every row of documents (doc_id, text).

    `ids` are little-endian unsigned 32-bit numbers: the text's ids by the tokenizer file at
    `path`, then `end_id`.  Longer documents are cut every `size` ids.  A missing text counts as
    empty and gives one piece of the end id; repeated rows each give their pieces.  A worker keeps the ids of
    at most `most_words` words and `most_pieces` parts of words.
    """
    end = _raw([end_id])

    def run(batch):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = worker_state("words " + path, lambda: Words(path, most_words, most_pieces))
        rows, pieces, starts, lengths, ids = [], [], [], [], []
        for row, text in enumerate(utf8(batch.column("text"))):
            raw = b"".join(map(words.__getitem__, text.split())) + end
            n = len(raw) // 4
            for piece, start in enumerate(range(0, n, size)):
                rows.append(row)
                pieces.append(piece)
                starts.append(start)
                lengths.append(min(size, n - start))
                ids.append(raw[4 * start:4 * (start + size)])
        return {
            "doc_id": batch.column("doc_id").take(pa.array(rows)), "piece": pieces, "start": starts,
            "length": lengths, "ids": ids,
        }

    kind = dict(documents.dtypes)["doc_id"]
    return per_batch(documents.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


# --- one island ------------------------------------------------------------------------
#
# A solution is an array with the bin of each item.


def best_fit(lengths, order, bins, free, size) -> None:
    """Put the items of `order` each into the bin that it leaves least room in; opens bins at need.

    `bins` gets the bin of each item; `free` is the room of the bins so far and is extended.
    """
    room = sorted((r, b) for b, r in enumerate(free) if r > 0)
    for item in order:
        n = int(lengths[item])
        at = bisect.bisect_left(room, (n, -1))
        if at == len(room):
            b = len(free)
            left = size - n
            free.append(left)
        else:
            left, b = room.pop(at)
            left -= n
            free[b] = left
        bins[item] = b
        if left > 0:
            bisect.insort(room, (left, b))


def _numbered(bins):
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def _filled(lengths, bins):
    return np.bincount(bins, weights=lengths)


def _worth(lengths, bins):
    """Fewest bins first; of as many, those with the fuller bins."""
    fill = _filled(lengths, bins)
    return len(fill), -float(np.square(fill).sum())


def _start(lengths, rng, first, size):
    noise = 1.0 if first else rng.uniform(0.8, 1.25, len(lengths))
    bins = np.empty(len(lengths), np.int32)
    best_fit(lengths, np.argsort(-lengths * noise, kind="stable"), bins, [], size)
    return bins


def cross(lengths, mother, father, rng, size):
    """A child: the father's well-filled bins go whole into the mother.

    Bins of the mother that hold an item of these are opened, which removes the duplicates; their
    other items are put where they fit best.
    """
    fill = _filled(lengths, father)
    share = rng.uniform(0.1, 0.6)
    good = np.argsort(-fill, kind="stable")[:max(1, int(len(fill) * share))]
    injected = np.isin(father, good)
    opened = np.isin(mother, np.unique(mother[injected]))
    # The mother's worst bins are opened as well, so that displaced items find room.
    kept_fill = _filled(lengths, mother)
    worst = np.argsort(kept_fill, kind="stable")[:max(1, len(kept_fill) // 20)]
    opened |= np.isin(mother, worst)
    child = np.full(len(lengths), -1, np.int32)
    stay = ~opened & ~injected
    child[stay] = _numbered(mother[stay]) if stay.any() else 0
    n = int(child.max(initial=-1)) + 1
    if injected.any():
        child[injected] = _numbered(father[injected]) + n
    placed = child >= 0
    n_bins = int(child.max(initial=-1)) + 1
    free = (size - np.bincount(child[placed], weights=lengths[placed], minlength=n_bins)).astype(int).tolist()
    rest = np.flatnonzero(~placed)
    best_fit(lengths, rest[np.argsort(-lengths[rest], kind="stable")], child, free, size)
    return _numbered(child)


def evolve(lengths, members, seed, size, population, generations):
    """The members of an island after some generations, best first.

    Ends as soon as the best needs no more bins than the sum of lengths does.
    """
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // size)
    members = [np.asarray(m, np.int32) for m in members]
    while len(members) < population:
        members.append(_start(lengths, rng, not members, size))
        if _worth(lengths, members[-1])[0] <= least:
            break
    members.sort(key=lambda m: _worth(lengths, m))
    for _ in range(generations):
        if _worth(lengths, members[0])[0] <= least:
            break
        for _ in range(2):
            mother, father = rng.choice(len(members), 2, replace=len(members) < 2)
            members.append(cross(lengths, members[mother], members[father], rng, size))
        members.sort(key=lambda m: _worth(lengths, m))
        del members[population:]
    return members


# --- all islands -----------------------------------------------------------------------


def _evolved(islands: DataFrame, round_, size, population, generations) -> DataFrame:
    def run(batch):
        made = []
        for shard, island, lengths, members, guest in zip(*[batch.column(c).to_pylist() for c in ("shard", "island", "lengths", "members", "guest")]):
            start = [*(members or []), *([guest] if guest else [])]
            seed = [int(shard) & 0x7FFFFFFF, int(island), round_]
            out = evolve(np.array(lengths, np.int64), start, seed, size, population, generations)
            made.append([m.tolist() for m in out])
        return {c: batch.column(c) for c in ("shard", "island", "items", "lengths")} | {
            "members": made, "n_bins": [max(m[0]) + 1 for m in made],
        }

    return per_batch(islands, run, "shard bigint, island int, items array<bigint>, lengths array<bigint>, members array<array<int>>, n_bins int")


def _packed(items: DataFrame, shards: int, size, islands, population, rounds, generations) -> DataFrame:
    """(item, length, shard, bin) by one level of islands; items are (item, length)."""
    shard = F.pmod(F.xxhash64("item"), F.lit(shards))
    held = F.array_sort(F.collect_list(F.struct("item", "length")))
    groups = items.groupBy(shard.alias("shard")).agg(held.alias("held"))
    state = groups.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.col("held.item").alias("items"), F.col("held.length").alias("lengths"),
        F.lit(None).cast("array<array<int>>").alias("members"), F.lit(None).cast("array<int>").alias("guest"),
    )
    ring = Window.partitionBy("shard").orderBy("island")
    whole = Window.partitionBy("shard").orderBy("island").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for round_ in range(rounds):
        tasks = max(1, min(shards * islands, 4 * items.sparkSession.sparkContext.defaultParallelism))
        spread = state.repartition(tasks, "shard", "island")
        state = written(_evolved(spread, round_, size, population, generations), "islands")
        if round_ < rounds - 1:
            # Each island's best moves on to the next of its shard.
            elite = F.col("members")[0]
            state = state.withColumn("guest", F.coalesce(F.lag(elite).over(ring), F.last(elite).over(whole)))
    best = state.groupBy("shard").agg(F.min_by(F.struct("items", "lengths", F.col("members")[0].alias("bins")), F.struct("n_bins", "island")).alias("b"))
    one = F.explode(F.arrays_zip(F.col("b.items").alias("item"), F.col("b.lengths").alias("length"), F.col("b.bins").alias("bin")))
    return best.select("shard", one.alias("x")).select("x.item", "x.length", "shard", "x.bin")


def pack(
    pieces: DataFrame, size=SIZE, shard=SHARD, islands=ISLANDS, population=POPULATION, rounds=ROUNDS,
    generations=GENERATIONS, well_filled=WELL_FILLED,
) -> DataFrame:
    """`pieces` (length, and any other columns) with `sequence_id` and `offset`, in few sequences of at most `size`.

    Pieces are spread by a hash into shards of about `shard`; each shard is packed by islands of
    their own, whose best solutions move to the next island between rounds.  The sequences of a
    shard's best solution that are less than `well_filled` are opened, and their pieces packed
    again over all shards, level by level, until one shard is left or a level no longer helps.
    So the loss against the sum of lengths does not grow with the number of shards.

    Lengths must lie in 1 to `size`; others fail the job.  Rows are told apart by their place, so
    repeated rows are packed each.  No rows give no rows.  Columns named like the results or
    starting with an underscore must be renamed before.
    """
    spark = pieces.sparkSession
    good = F.col("length").between(1, size)
    checked = pieces.withColumn("length", F.when(good, F.col("length").cast("long")).otherwise(F.raise_error(F.lit("a piece must have 1 to size tokens"))))
    stored = written(checked.withColumn("_item", F.monotonically_increasing_id()), "pieces")
    items = stored.select(F.col("_item").alias("item"), "length")
    n = items.count()
    placed, level = None, 0
    while n:
        shards = max(1, -(-n // shard))
        found = written(_packed(items, shards, size, islands, population, rounds, generations), "packed")
        fill = found.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
        last = shards == 1 or level >= 8
        done = found if last else found.join(fill.filter(F.col("fill") >= size * well_filled), ["shard", "bin"], "left_semi")
        # Levels and shards keep their numbers apart.
        number = (F.lit(level) * (1 << 58) + F.col("shard") * (1 << 20) + F.col("bin")).cast("long")
        part = done.select("item", "length", number.alias("sequence_id"))
        placed = part if placed is None else placed.unionByName(part)
        if last:
            break
        open_ = found.join(fill.filter(F.col("fill") < size * well_filled), ["shard", "bin"], "left_semi")
        items, left = written_rows(open_.select("item", "length"), "open_pieces")
        if left > 0.7 * n:
            level = 8
        else:
            level += 1
        n = left
    if placed is None:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).limit(0)
    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    where = placed.select(F.col("item").alias("_item"), "sequence_id", offset.alias("offset"))
    return stored.join(where, "_item").drop("_item")

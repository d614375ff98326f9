"""From raw documents to packed training sequences.

Stages, in order: documents that are scored toxic go; lines that many documents repeat go; of
near-duplicate documents one stays; benchmark passages go; what is left is packed.  All but the
last return the columns of documents, with `n_chars` following the text where they change it.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from snipquarry.llm import decontaminate, jaccard, line_dedup, packing, toxicity
from snipquarry.plans.keys import marked_likely
from snipquarry.plans.scratch import noted, remove_scratch, written

TOKENIZER = "word_bpe_49k.json"
# Words and parts of words that a worker keeps: fewer than in packing alone, as memory of the stages before stays taken.
KNOWN_WORDS, KNOWN_PIECES = 100_000, 200_000


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with a number of their own, stored, and (doc_id, text) with that number as doc_id.

    Operators give results by id, and ids may be missing or repeated.
    """
    stored = written(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*docs.columns).alias("_doc")), "numbered")
    return stored, stored.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text"))


def _with_text(stored: DataFrame, changed: DataFrame, columns: list[str]) -> DataFrame:
    """The stored rows with their new (doc_id, text); only rows whose text changed are shuffled."""
    marked = marked_likely(stored, changed.select(F.col("doc_id").alias("_row")), ["_row"], "_hit")
    news = changed.select(F.col("doc_id").alias("_row"), F.col("text").alias("_text"), F.lit(True).alias("_new"))
    joined = marked.filter("_hit").join(news.hint("merge"), "_row", "left")
    text = F.when(F.col("_new"), F.col("_text")).otherwise(F.col("_doc.text"))
    values = [_value(c, text) for c in columns]
    return joined.select(*values).unionByName(marked.filter("NOT _hit").select(*[F.col("_doc")[c].alias(c) for c in columns]))


def _value(column, text):
    if column == "text":
        return text.alias("text")
    if column == "n_chars":
        return F.when(F.col("_new"), F.length(text).cast("long")).otherwise(F.col("_doc.n_chars")).alias("n_chars")
    return F.col("_doc")[column].alias(column)


def _only(stored: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The stored rows without those whose number is in `gone` (doc_id)."""
    out = gone.select(F.col("doc_id").alias("_row"))
    marked = marked_likely(stored, out, ["_row"], "_hit")
    kept = marked.filter("_hit").join(out.hint("merge"), "_row", "left_anti")
    both = kept.select("_doc").unionByName(marked.filter("NOT _hit").select("_doc"))
    return both.select(*[F.col("_doc")[c].alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic.  It learns from the labels of the table."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return docs.filter(~toxicity.is_toxic(F.col("text"), model, docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least five of them hold, but for the one of the largest id
    (of equals, the last row; rows without an id come first)."""
    stored, _ = _numbered(docs)
    rows = stored.select(F.col("_row").alias("doc_id"), F.col("_doc.doc_id").alias("_own"), F.col("_doc.text").alias("text"))
    found = line_dedup.dedup_lines(rows, order="_own")
    changed = written(found.filter("n_dropped > 0").select("doc_id", "text"), "changed")
    return _with_text(stored, changed, docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id (of equals, the first row)."""
    stored, rows = _numbered(docs)
    found = jaccard.similar(rows).select("doc_id", "component_id")
    found = written(found.filter("component_id IS NOT NULL"), "components")
    # Groups of one need no further look.
    many = written(found.filter("component_id <> doc_id").select("component_id").distinct(), "grouped")
    marked = marked_likely(found, many, ["component_id"], "_many").filter("_many").drop("_many")
    ids = marked.join(stored.select(F.col("_row").alias("doc_id"), F.col("_doc.doc_id").alias("_own")), "doc_id")
    order = F.struct(F.col("_own").isNull(), "_own", "doc_id")
    first = ids.groupBy("component_id").agg(F.min_by("doc_id", order).alias("doc_id"))
    gone = ids.select("doc_id").join(first.select("doc_id"), "doc_id", "left_anti")
    return _only(stored, written(gone, "gone"), docs.columns)


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are little else go."""
    stored, rows = _numbered(docs)
    found = written(decontaminate.scan(rows, _table(spark, sf_dir, "benchmark")).filter(F.size("ranges") > 0), "contaminated")
    kept = written(decontaminate.cut(found), "cut")
    gone = written(found.select("doc_id").join(kept.select("doc_id"), "doc_id", "left_anti"), "gone")
    columns = docs.columns
    changed = _with_text(stored.join(gone.select(F.col("doc_id").alias("_row")).hint("merge"), "_row", "left_anti"), kept, columns)
    return changed


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    pieces = packing.tokenised(docs, public_tokenizers.path(TOKENIZER), most_words=KNOWN_WORDS, most_pieces=KNOWN_PIECES)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


_left: list[str] = []


def _tidy(stage, last=False):
    """A stage that first removes the scratch tables of the stage before it, whose rows are stored by then.

    Those of the last stage stay, since its rows are the result.
    """

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_scratch(spark, _left)
        with noted([] if last else _left):
            return stage(spark, docs, sf_dir)

    return run


# Each stage's rows must be stored before the next one is called.
STAGES = [
    ("toxicity", _tidy(drop_toxic)),
    ("line_dedup", _tidy(drop_lines)),
    ("ngram_jaccard", _tidy(drop_near_duplicates)),
    ("decontamination", _tidy(drop_benchmarks)),
    ("packing", _tidy(pack, last=True)),
]

# Learned scores and token ids have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's rows are stored for the next."""
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs

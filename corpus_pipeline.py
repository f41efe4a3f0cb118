"""A corpus pipeline: language ID, line dedup, near-dedup, mixing and packing, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import langid, linedup, mixing, packing, simhash
from siltstone.llm.shared import discard, written
from siltstone.session import table

#: The columns of documents.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose first language has a smaller share of it is rejected.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no letter, or none that has LEAST_SHARE of it); lang becomes the predicted one.

    Null texts have no language and go; repeated rows, ties and null ids are judged like any row; an empty
    table stays empty; columns beyond those of documents are dropped.
    """
    kept = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)
    return langid.labelled(docs, carry=COLUMNS).filter(kept).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; a document of which nothing is left stays as an empty text.

    Null texts stay null and empty ones empty; of equal lines the first by id and place stays, null ids last;
    rows equal in id and text are one document and keep the same lines; an empty table stays empty.
    """
    return linedup.dedup_lines(docs, short=True).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates, and one of repeated rows.

    Documents without a word, null or empty, have one fingerprint and are one group; null ids come after
    all others, ties go by the hash of the text; an empty table stays empty.
    """
    first = written(simhash.representatives(docs), "first")
    kept = on_document(docs, first, "left_semi")
    if not first.filter("n > 1").isEmpty():
        kept = kept.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"])
    return kept.select(*COLUMNS)


def on_document(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Joins by id, null or not, and text hash."""
    other = other.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    return docs.join(other, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), how)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps or leaves out documents until each source has its target; a document at a cut keeps its first words.

    A repeat has the id of its document. Null and empty texts have no words to take and go; a null source
    is a source; repeated rows are one document with all that they take; an empty table stays empty.
    """
    plan = mixing.mix(docs).groupBy("doc_id", "text_hash", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("n"))
    plan = written(plan.filter("taken > 0"), "mix")
    if not plan.filter("n > 1").isEmpty():  # repeated rows are one document with all that they take
        docs = docs.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).drop("h")
    copies = plan.withColumn("words", F.explode(F.expr("transform(sequence(0L, (taken - 1) div size), i -> least(size, taken - i * size))")))
    text = F.when(F.col("words") < F.col("size"), mixing.first_words(F.col("text"), F.col("words").cast("int"))).otherwise(F.col("text"))
    return on_document(docs, copies.drop("taken", "n"), "inner").withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 4096 tokens: one row a piece.

    A null text is an empty one, of its end token alone; repeated rows are packed each; an empty table
    gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: The learned model, the MinHash components and the tokenizer are beyond SQL; tests/llm compares each stage's rows with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each result written as a table and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k + 1}")
            if k:
                discard(before)
    return docs

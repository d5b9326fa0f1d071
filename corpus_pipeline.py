"""The training-data pipeline over ``documents``: five stages, each an operator of ``evenhand.llm`` over all rows that the one before kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``; each result is written as Parquet and read
again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.llm import bpe, language_id, mixing, near_dedup, substring_dedup
from evenhand.llm.catalog import register
from evenhand.llm.common import read, small_batches, written

# Shorter repeats are common phrases; passages of more words than this are copied text.
PASSAGE_WORDS = 50


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with that language; texts without letters or unlike all languages go."""
    small_batches(spark)
    sample = language_id.training_sample(docs, F.lit(True), language_id.TRAIN_DOCS, "doc_id", "text", "lang")
    found = language_id.identify(docs, language_id.fit(sample))
    return found.where("not rejected").withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; documents without an id stay, of equal rows with one id one stays."""
    small_batches(spark)
    gone = near_dedup.near_duplicates(docs).where("not kept").select("doc_id", "text_hash").distinct()
    rows = docs.withColumn("text_hash", F.xxhash64("text")).join(gone, ["doc_id", "text_hash"], "left_anti")
    rows = rows.withColumn("row", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    return rows.dropDuplicates(["doc_id", "text_hash", "row"]).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has."""
    small_batches(spark)
    left = substring_dedup.remove_repeats(docs, width=PASSAGE_WORDS)
    changed = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars").cast("long"))
    return left.withColumn("n_chars", changed).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weights of the sources ask for."""
    return mixing.emit(mixing.mix_sources(docs)).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    small_batches(spark)
    text_of = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = bpe.encode_decode(docs.select("doc_id", "lang", "source", text_of.alias("text_hash"), "text"))
    same = F.xxhash64("decoded") == F.col("text_hash")
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_to_weights),
    ("bpe", tokenize),
]

# Models, signatures and merges are not SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


@register("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

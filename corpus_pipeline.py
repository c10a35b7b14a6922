"""Corpus preparation in stages; each stage's result is written as Parquet and read as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, packing, shingle_join, suffix_dedup, toxicity
from tidemark.llm.scratch import materialize, small_batches, table

#: Documents with at least this score are rejected.
TOXIC = 0.5

def _retexted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``documents`` with ``n_chars`` brought up to date."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; null and empty texts stay.

    Only the row numbers of the rejected are written, so that the documents aren't stored
    twice. Up to a million go to the documents; beyond that the documents are shuffled to them.
    """
    row = shingle_join.row_number_of(F.col("doc_id"), F.col("text"))
    with small_batches(spark):
        lexicon, model = toxicity.train(docs, table(spark, sf_dir, "labels"))
        scored = toxicity.with_scores(docs.select(row.alias("_row"), "text"), lexicon, model, score_col="_toxicity")
        rejected = materialize(scored.where(F.col("_toxicity") >= TOXIC).select("_row").distinct(), "rejected")
    few = rejected.count() <= shingle_join.BROADCAST_KEYS
    return docs.withColumn("_row", row).join(F.broadcast(rejected) if few else rejected, "_row", "left_anti").select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A source's boilerplate lines go; every document stays."""
    return _retexted(line_dedup.drop_boilerplate(docs), docs.columns)


def shingle_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8) exactly one row stays; texts without words all stay.

    It is the one of least doc_id, nulls last, then of least row number; of rows alike in
    doc_id and text, which share that number, the one least in the other columns.
    """
    classes = shingle_join.classes(docs).where(F.col("n_shingles") > 0)
    members = classes.groupBy("class", "row").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("times"))
    first = members.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select("class", F.col("first.row").alias("survivor"))
    marks = materialize(members.join(first, "class").select(F.col("row").alias("_row"), (F.col("row") == F.col("survivor")).alias("stays"), "times"), "marks")
    others, repeated = marks.where(~F.col("stays")).select("_row"), marks.where(F.col("stays") & (F.col("times") > 1)).select("_row")
    kept = docs.withColumn("_row", shingle_join.row_number_of(F.col("doc_id"), F.col("text"))).join(others, "_row", "left_anti")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    one = kept.join(repeated, "_row", "left_semi").groupBy("_row").agg(F.min(F.struct(*docs.columns)).alias("one")).select("one.*")
    return kept.join(repeated, "_row", "left_anti").select(docs.columns).unionByName(one)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that recur go from all their places; every document stays."""
    return _retexted(suffix_dedup.drop_repeats(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 4096 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("shingle_join", shingle_join_stage),
    ("suffix_array", suffix_dedup_stage),
    ("packing", packing_stage),
]

#: Scoring, shingle classes and tokenizers are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality classifier, language ID, near-duplicates, benchmark decontamination, mixing.

Each stage works on all documents that the one before kept and returns the columns of documents; the last returns the
mix. run() writes every stage's rows as Parquet in the folder that executors share, and reads them again; what a stage
wrote on its way is removed with it.

Defined results, of every stage: an empty table stays empty; repeated rows are documents of their own (near_duplicates
keeps one); columns beyond those of documents, whatever their names, pass through unread. Null and empty texts are judged
by the classifier as texts without words, leave at the language stage (nothing tells their language), are never near
copies and hold no benchmark passage. A null lang, source or doc_id is no evidence, a source and an id of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.common import discard, settled, small_batches, table
from wordloom.llm.decontamination import clean_documents
from wordloom.llm.language_id import identified
from wordloom.llm.mixing import mix
from wordloom.llm.near_dedup import deduplicated
from wordloom.llm.quality_classifier import accepted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    small_batches(spark)
    return accepted(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    small_batches(spark)
    return identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage (window) of the benchmark."""
    small_batches(spark)
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix of what is left."""
    return mix(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]

#: SQL can't express the classifier and the language models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

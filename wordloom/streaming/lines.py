"""Structured Streaming forms of the line operators. All are stateless but the running lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.text import trim
from wordloom.operators.segment import Segmenter


def read_line_stream(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed, non-empty lines of the text files that arrive under path."""
    return spark.readStream.text(path, lineSep="\n").select(trim(F.col("value")).alias("line")).where(F.col("line") != "")


def segment_stream(lines: DataFrame, segmenter: Segmenter, column: str = "line") -> DataFrame:
    """Adds words; works alike on streams and tables."""
    return segmenter.segment(lines, column)


def running_counts(words: DataFrame) -> DataFrame:
    """Word counts so far; for update or complete mode."""
    return words.select(F.explode("words").alias("word")).groupBy("word").count()

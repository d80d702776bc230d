"""Text sources: document tables, line corpora, stop-word files, rows in memory."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.operators.ranking import number_rows
from reviewlens.session import file_system
from reviewlens.sizing import cluster_by, spread

PART_BYTES = 8 << 20
"""Bytes of a table of documents that one task groups by document."""


def read_documents(
    spark: SparkSession,
    path: str,
    keys: Sequence[str] = ("doc_id",),
    text: str = "text",
    per_document: bool = False,
) -> DataFrame:
    """Key columns and ``text`` of a Parquet table of documents.

    Rows stay where they are scanned. ``per_document`` lays them out by key, which moves
    all texts once, for work that groups them by document more than once or whose groups
    are many: parts are then of ``PART_BYTES`` of the table at the most, on average.
    """
    docs = spark.read.parquet(path).select(*keys, F.col(text).alias("text"))
    if not per_document:
        return spread(docs, *keys)
    files, place = file_system(spark, path)
    return cluster_by(docs, *keys, at_least=-(-files.getContentSummary(place).getLength() // PART_BYTES))


def documents_from_rows(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """A few texts held by the caller, numbered from 0 in their order."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words of text files, separated by any white space: ``term``."""
    words = F.explode(F.split("value", r"\s+")).alias("term")
    return spark.read.text(path).select(words).where("term <> ''").distinct()


def clean_lines(lines: DataFrame) -> DataFrame:
    """Lines without carriage returns and outer blanks; empty lines are dropped."""
    value = F.btrim(F.regexp_replace("value", "\r", ""), F.lit(" \t"))
    return lines.withColumn("value", value).where("value <> ''")


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One document per non-empty line, numbered from 0 in file and line order."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    numbered = number_rows(clean_lines(lines), "file", "block", "line", index="doc_id")
    return numbered.select("doc_id", F.col("value").alias("text"))

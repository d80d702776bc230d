"""Term counts, the ranked vocabulary and bags of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from reviewlens.operators.ranking import number_rows, top_per_group
from reviewlens.session import free_exchanges, passing_tables, stored, written_table
from reviewlens.sizing import join_dimension

HEAD_TERMS = 100_000
HEAD_TERM_BYTES = 100
"""The most frequent terms, unless very long, are broadcast when terms are looked
up: 10 MB at the most, however large the vocabulary is."""

MAX_VECTOR_SIZE = (1 << 31) - 1
"""Vector indices are 32-bit."""


def document_term_counts(tokens: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """How often each term occurs in each document: keys, ``term``, ``n``."""
    return tokens.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))


def term_counts(tokens: DataFrame) -> DataFrame:
    """How often each term occurs in the corpus: ``term``, ``n``.

    Tasks add up their own terms first, so a frequent term is one row per task.
    """
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def total_counts(doc_terms: DataFrame) -> DataFrame:
    """Corpus counts from per-document counts."""
    return doc_terms.groupBy("term").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, vocab_size: int | None = None) -> DataFrame:
    """Terms numbered from 0, most frequent first, equal counts by term.

    The result is written as a table to the checkpoint folder, as it is read many times.
    With ``vocab_size`` only that many top terms are kept.
    """
    order = [F.desc("n"), F.asc("term")]
    ranked = number_rows(counts.select("term", "n"), *order, index="term_index")
    return ranked if vocab_size is None else ranked.where(F.col("term_index") < vocab_size)


def bag_of_words(
    doc_terms: DataFrame,
    vocabulary: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    head_terms: int = HEAD_TERMS,
) -> DataFrame:
    """Sparse vectors in long form: keys, ``term_index``, ``value`` (count as double).

    Terms outside the vocabulary are dropped. The most frequent terms, which are
    the skewed ones, meet a broadcast of a fixed size. If there are others, the counts
    are written once with the indices found so far, or else with their term, and only the
    latter are exchanged by term: numbers tell that each is infrequent. Long frequent terms
    are spread over tasks.
    """
    index = vocabulary.select("term", "term_index")
    in_head = (F.col("term_index") < head_terms) & (F.octet_length("term") <= HEAD_TERM_BYTES)
    head, tail = index.where(in_head), index.where(~in_head)
    columns = [*keys, "term_index", F.col("n").cast("double").alias("value")]
    if tail.isEmpty():
        return doc_terms.join(F.broadcast(head), "term").select(*columns)
    joined = doc_terms.select(*keys, "term", "n").join(F.broadcast(head), "term", "left")
    rest = F.when(F.col("term_index").isNull(), F.col("term")).alias("term")
    met = stored(joined.select(*keys, "n", "term_index", rest))
    rare = met.where(F.col("term_index").isNull() & F.col("term").isNotNull()).drop("term_index")
    is_long = F.octet_length("term") > HEAD_TERM_BYTES
    long = tail.where(F.col("term_index") < head_terms)
    if long.isEmpty():
        found = rare.join(tail, "term").select(*columns)
    else:
        short = rare.where(~is_long).join(tail.where(~is_long), "term").select(*columns)
        found = join_dimension(rare.where(is_long), tail.where(is_long), "term").select(*columns).unionByName(short)
    return met.where(F.col("term_index").isNotNull()).select(*columns).unionByName(found)


def count_vectors(
    docs: DataFrame,
    doc_terms: DataFrame,
    vocabulary: DataFrame,
    keys: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The sparse count vector of every document: keys, ``features``.

    As wide as the vocabulary; a document without terms gets an empty vector.
    The vocabulary never passes through the driver: terms are looked up as in
    ``bag_of_words`` and each document's entries are written to a table in the
    checkpoint folder, in the layout of a vector column, and read back as one; what was
    written on the way is removed. The table is there until :func:`reviewlens.session.release`. Documents that share their keys
    share a vector.
    """
    size = vocabulary.count()
    if size > MAX_VECTOR_SIZE:
        raise ValueError("vectors cannot be that wide: give a vocab_size or use bag_of_words")
    spark = docs.sparkSession
    free_exchanges(spark)
    with passing_tables(spark) as kept:
        bags = bag_of_words(doc_terms, vocabulary, keys)
        index = F.col("term_index").cast("int").alias("term_index")
        entries = bags.select(*keys, F.struct(index, "value").alias("entry"))
        grouped = entries.unionByName(docs.select(*keys), allowMissingColumns=True).groupBy(*keys)
        sparse = F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            F.lit(size).cast("int").alias("size"),
            F.col("entries.term_index").alias("indices"),
            F.col("entries.value").alias("values"),
        )
        collected = grouped.agg(F.sort_array(F.collect_list("entry")).alias("entries"))
        written = written_table(collected.select(*keys, sparse.alias("features")))
        kept.append(written)
    schema = StructType([docs.schema[k] for k in keys] + [StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(written)


def top_document_terms(
    doc_terms: DataFrame, k: int = 5, keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The ``k`` most frequent terms of each document, ranked from 1."""
    return top_per_group(doc_terms, keys, [F.desc("n"), F.asc("term")], k)

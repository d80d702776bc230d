"""Sentences of documents and their sentiment class."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.scores import sentiment_class
from reviewlens.functions.text import sentence_array, valence_sum, word_array
from reviewlens.session import stored
from reviewlens.sizing import INLINE_ROWS, bounded_rows, join_dimension

Lexicon = DataFrame | Mapping[str, int]


def sentences(
    docs: DataFrame, keys: Sequence[str] = ("doc_id",), carry: Sequence[str] = (), outer: bool = False
) -> DataFrame:
    """One row per sentence: keys, ``sent_no`` from 1, ``sentence``.

    ``outer`` keeps a document without sentences as one row of NULLs.
    """
    split = F.posexplode_outer if outer else F.posexplode
    rows = docs.select(*keys, *carry, split(sentence_array("text")).alias("_at", "sentence"))
    return rows.select(*keys, *carry, (F.col("_at") + 1).alias("sent_no"), "sentence")


def _distinct_terms(lexicon: DataFrame) -> DataFrame:
    """One valence per lower-case term: the sum of its entries that have one."""
    entries = lexicon.where(F.col("term").isNotNull() & F.col("valence").isNotNull())
    return entries.groupBy(F.lower("term").alias("term")).agg(
        F.sum("valence").cast("int").alias("valence")
    )


def _folded(lexicon: Mapping[str, int]) -> dict[str, int]:
    """The same for a dictionary."""
    found: dict[str, int] = {}
    for term, valence in lexicon.items():
        if term is not None and valence is not None:
            found[term.lower()] = found.get(term.lower(), 0) + valence
    return found


def inline_lexicon(lexicon: Lexicon) -> dict[str, int] | None:
    """The lexicon as a dictionary if small enough for a literal, otherwise ``None``."""
    if isinstance(lexicon, DataFrame):
        rows = bounded_rows(_distinct_terms(lexicon))
        return None if rows is None else {r["term"]: r["valence"] for r in rows}
    found = _folded(lexicon)
    return found if len(found) <= INLINE_ROWS else None


def kept_lexicon(lexicon: Lexicon) -> Lexicon:
    """A lexicon that is a table written once, as it is read several times."""
    return stored(_distinct_terms(lexicon)) if isinstance(lexicon, DataFrame) else lexicon


def _frame(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    if isinstance(lexicon, DataFrame):
        return _distinct_terms(lexicon)
    return spark.createDataFrame(sorted(_folded(lexicon).items()), "term string, valence int")


def scores_found(
    sentences: DataFrame, lexicon: Lexicon, keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Keys, ``sent_no`` and ``score`` of sentences; those with no word of the lexicon may be left out.

    A short lexicon is part of the expression. A long one is joined to the words, and the
    valences found are added up, in each task first, so that a sum for a sentence is exchanged and
    not its words. Each sentence has a mark among its words, which tells how often it was given:
    the sum is divided by that. Sums of nothing are neutral and left out.
    """
    at = [*keys, "sent_no"]
    small = inline_lexicon(lexicon)
    if small is not None:
        total = valence_sum(word_array("sentence"), small)
        return sentences.select(*at, F.coalesce(sentiment_class(total), F.lit(2)).alias("score"))
    spark = sentences.sparkSession
    # No word is empty, so the empty term can be the mark.
    words = sentences.select(*at, F.explode(F.concat(F.array(F.lit("")), word_array("sentence"))).alias("term"))
    valences = _frame(spark, lexicon).where("term <> '' AND valence <> 0")
    mark = spark.range(1).select(F.lit("").alias("term"), F.lit(0).alias("valence"))
    hits = join_dimension(words, valences.unionByName(mark), "term")
    added = hits.groupBy(*at).agg(F.sum("valence").alias("_sum"), F.count_if(F.col("term") == "").alias("_given"))
    return added.where("_sum <> 0").select(*at, sentiment_class(F.expr("_sum div _given")).alias("score"))


def sentence_scores(
    sentences: DataFrame, lexicon: Lexicon, keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Add ``score``, the class 0 to 4 of the summed valences of a sentence's words.

    A sentence without a word of the lexicon is neutral (2). A short lexicon is
    part of the expression, so scoring adds no exchange; with a long one the scores
    found are joined back by sentence. ``keys`` and ``sent_no`` name a sentence of a
    text, and sentences alike in them and in their words are scored alike.
    """
    lexicon = kept_lexicon(lexicon)
    small = inline_lexicon(lexicon)
    if small is not None:
        total = valence_sum(word_array("sentence"), small)
        return sentences.withColumn("score", F.coalesce(sentiment_class(total), F.lit(2)))
    own = [*keys, "sent_no", "_sentence"]
    marked = sentences.withColumn("_sentence", F.xxhash64("sentence"))
    found = scores_found(marked, lexicon, [*keys, "_sentence"])
    found = found.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(own)), F.col("score").alias("_score"))
    same = reduce(and_, (marked[c].eqNullSafe(found[f"_{i}"]) for i, c in enumerate(own)))
    scored = marked.join(found, same, "left")
    return scored.select(*sentences.columns, F.coalesce("_score", F.lit(2)).alias("score"))

"""Documents to terms: tokenise, lemmatise, drop short words and stop words."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.text import word_array
from reviewlens.sizing import inline_terms, join_dimension, term_frame
from reviewlens.wordlists import ENGLISH_STOP_WORDS

# Fixed value: a kept term is strictly longer than this.
MIN_TERM_LENGTH = 1

Terms = DataFrame | Iterable[str]


def drop_terms(df: DataFrame, terms: Terms, column: str = "term") -> DataFrame:
    """Rows whose ``column`` is not among ``terms``; all copies of others stay.

    A short list is a hash-set filter in the scan stage, a long one an anti-join.
    """
    few = inline_terms(terms)
    if few is not None:
        return df.where(~F.col(column).isin(few)) if few else df
    listed = term_frame(df.sparkSession, terms, column)
    return join_dimension(df, listed, column, how="left_anti").select(*df.columns)


def lemmatise(df: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Replace each ``term`` by its lemma from ``lemmas(form, lemma)``, if it has one.

    A form listed twice takes the first of its lemmas in alphabetical order.
    """
    table = lemmas.groupBy(F.col("form").alias("term")).agg(F.min("lemma").alias("lemma"))
    joined = join_dimension(df, table, "term", how="left")
    return joined.withColumn("term", F.coalesce("lemma", "term")).drop("lemma").select(*df.columns)


def tokens(
    docs: DataFrame,
    stopwords: Terms = ENGLISH_STOP_WORDS,
    lemmas: DataFrame | None = None,
    lowercase: bool = True,
    symbols: bool = False,
    keys: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Kept terms in order: keys, ``pos`` among all words of the text, ``term``.

    By default words are lower-case runs of letters. ``lowercase=False`` keeps
    case and ``symbols=True`` keeps numbers and runs of punctuation too.
    """
    words = word_array("text", lowercase, symbols)
    found = docs.select(*keys, F.posexplode(words).alias("pos", "term"))
    if lemmas is not None:
        found = lemmatise(found, lemmas)
    found = found.where(F.length("term") > MIN_TERM_LENGTH)
    return drop_terms(found, stopwords)


def term_arrays(
    docs: DataFrame,
    stopwords: Terms = ENGLISH_STOP_WORDS,
    lemmas: DataFrame | None = None,
    lowercase: bool = True,
    symbols: bool = False,
    keys: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Kept terms per document as ``terms``; a document without any has ``[]``.

    Without a lemma table and with a short stop list nothing leaves its row. Each row is a
    document, whatever its keys.
    """
    few = inline_terms(stopwords)
    if lemmas is None and few is not None:
        words = F.coalesce(word_array("text", lowercase, symbols), F.array().cast("array<string>"))
        kept = F.filter(
            words, lambda w: (F.length(w) > MIN_TERM_LENGTH) & ~w.isin(few or [""])
        )
        return docs.select(*keys, kept.alias("terms"))
    # The empty term stands for the document itself; no word and no list has it.
    nothing = F.array().cast("array<string>")
    words = F.concat(F.array(F.lit("")), F.coalesce(word_array("text", lowercase, symbols), nothing))
    numbered = docs.select(*keys, "text", F.monotonically_increasing_id().alias("_row"))
    rows = numbered.select(*keys, "_row", F.posexplode(words).alias("pos", "term"))
    if lemmas is not None:
        rows = lemmatise(rows, lemmas.where("form <> ''"))
    rows = rows.where((F.col("pos") == 0) | (F.length("term") > MIN_TERM_LENGTH))
    if isinstance(stopwords, DataFrame):
        rows = drop_terms(rows, stopwords.where(F.col(stopwords.columns[0]) != ""))
    else:
        rows = drop_terms(rows, set(stopwords) - {""})
    term = F.when(F.col("pos") > 0, F.struct("pos", "term"))
    grouped = rows.groupBy(*keys, "_row").agg(F.sort_array(F.collect_list(term)).getField("term").alias("terms"))
    return grouped.drop("_row")

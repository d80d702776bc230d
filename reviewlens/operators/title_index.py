"""Name search by an index of grams: the titles that hold a word, without reading all of them.

A title's grams are its runs of one, two and three characters in lower case. The index is
a table of (gram, row) in ranges of gram, so a filter on a gram reads the blocks that hold
it, and a table of how many rows each gram has. A search takes the rarest grams of its
words, keeps the rows that have all of these, and looks for the words in their titles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.text import contains_all

GRAM = 3
RAREST = 3
"""So many characters has a gram at most, and so many grams of a search are looked up."""

LITERAL_ROWS = 1_000
"""Up to so many candidates are a filter of the scan of titles; more are a join."""


def _grams(text: Column) -> Column:
    """The distinct grams of a text, of each size up to ``GRAM``."""
    length = F.char_length(text)

    def of_size(size: int) -> Column:
        places = F.when(length >= size, F.sequence(F.lit(1), length - size + 1))
        return F.coalesce(F.transform(places, lambda at: F.substring(text, at, F.lit(size))), F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*(of_size(size) for size in range(1, GRAM + 1))))


def word_grams(word: str) -> list[str]:
    """The grams that say most of a word: itself if it is short, else those of full size."""
    if len(word) <= GRAM:
        return [word]
    return sorted({word[at : at + GRAM] for at in range(len(word) - GRAM + 1)})


@dataclass
class TitleIndex:
    spark: SparkSession
    path: str
    title: str = "title"

    def rarest(self, query: str) -> list[tuple[str, int]] | None:
        """The rarest grams of a search and how many titles have them; ``None`` if one has none."""
        grams = sorted({gram for word in query.lower().split() for gram in word_grams(word)})
        counts = self.spark.read.parquet(f"{self.path}/counts").where(F.col("gram").isin(grams))
        found = {row.gram: row.n for row in counts.collect()}
        if not grams or len(found) < len(grams):
            return None
        return sorted(found.items(), key=lambda pair: (pair[1], pair[0]))[:RAREST]

    def search(self, query: str) -> DataFrame:
        """The rows whose title holds every word of the query, in any letter case.

        What :func:`reviewlens.operators.catalog.title_search` finds, with the columns that
        were indexed. A blank query finds nothing, and neither does a null title.
        """
        titles = self.spark.read.parquet(f"{self.path}/titles")
        columns = [c for c in titles.columns if c != "_row"]
        rarest = self.rarest(query)
        if rarest is None:
            return titles.where(F.lit(False)).select(*columns)
        grams = [gram for gram, _ in rarest]
        postings = self.spark.read.parquet(f"{self.path}/postings").where(F.col("gram").isin(grams))
        # Each gram has a row once, so a row with all of them is met that often.
        met = postings.groupBy("_row").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(grams)).select("_row")
        if rarest[0][1] <= LITERAL_ROWS:
            # No more rows have all grams than have the rarest.
            rows = [row[0] for row in met.collect()]
            found = titles.where(F.col("_row").isin(rows) if rows else F.lit(False))
        else:
            found = titles.join(met, "_row", "left_semi")
        return found.where(contains_all(F.col(self.title), query.split())).select(*columns)


def write_title_index(movies: DataFrame, path: str, title: str = "title") -> TitleIndex:
    """Index the rows of ``movies`` by the grams of their titles; all columns are kept.

    A gram that very many titles have is spread over ranges by row. Rows are numbered as
    they are written, so neither ids nor titles need to be there or be unique.
    """
    spark = movies.sparkSession
    numbered = movies.withColumn("_row", F.monotonically_increasing_id())
    numbered.write.parquet(f"{path}/titles")
    numbered = spark.read.schema(numbered.schema).parquet(f"{path}/titles")
    postings = numbered.select(F.explode(_grams(F.lower(F.col(title)))).alias("gram"), "_row")
    by_range = postings.repartitionByRange("gram", "_row").sortWithinPartitions("gram", "_row")
    by_range.write.parquet(f"{path}/postings")
    held = spark.read.schema(postings.schema).parquet(f"{path}/postings")
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
    return TitleIndex(spark, path, title)

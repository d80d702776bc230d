"""Movie search from a name to a page of movies, as rows or as one JSON answer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.catalog import synopsis_or_default
from reviewlens.operators.catalog import PAGE_SIZE, newest_first, title_search
from reviewlens.operators.ranking import after, page


def search_movies(
    movies: DataFrame, query: str, number: int = 1, size: int = PAGE_SIZE
) -> DataFrame:
    """A page of the movies found, newest first, with a synopsis to show."""
    found = page(title_search(movies, query), *newest_first(), number=number, size=size)
    return found.withColumn("synopsis", synopsis_or_default(F.col("synopsis")))


def search_many(
    movies: DataFrame, queries: Sequence[str], number: int = 1, size: int = PAGE_SIZE
) -> DataFrame:
    """The same page of several searches, each row with its ``query``; a blank one has no rows."""
    pages = [search_movies(movies, query, number, size).withColumn("query", F.lit(query)) for query in queries]
    return reduce(DataFrame.unionByName, pages)


def search_after(
    movies: DataFrame, query: str, year: int | None, movie_id: object, size: int = PAGE_SIZE
) -> DataFrame:
    """The page of a search that follows the movie with this year and id, however deep."""
    found = after(title_search(movies, query), (year, movie_id), "year", "movie_id", descending=["year"], size=size)
    return found.withColumn("synopsis", synopsis_or_default(F.col("synopsis")))


def search_response(
    movies: DataFrame, query: str, number: int = 1, size: int = PAGE_SIZE
) -> DataFrame:
    """The answer to a search as one row: ``query`` and ``json``.

    The object has the query and its page of movies (at most ``size``), each as
    found: without a default for a missing synopsis, which is left out.
    """
    found = page(title_search(movies, query), *newest_first(), number=number, size=size)
    # Member names of the answer.
    movie = F.struct(
        F.col("year").alias("mYear"),
        F.col("movie_id").cast("string").alias("mId"),
        F.col("title").alias("mTitle"),
        F.col("synopsis").alias("mSynopsis"),
    )
    by_year = F.struct(
        F.coalesce(-F.col("year"), F.lit(2147483647)).alias("age"), "movie_id", movie.alias("movie")
    )
    answer = found.agg(F.sort_array(F.collect_list(by_year)).getField("movie").alias("movies"))
    answer = answer.select(F.lit(query).alias("query"), "movies")
    return answer.select("query", F.to_json(F.struct("query", "movies")).alias("json"))

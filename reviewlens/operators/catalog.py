"""The catalogue: movies by name, reviews by movie, and both together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.text import contains_all
from reviewlens.operators.ranking import page, top_per_group
from reviewlens.sizing import join_dimension

# What is asked of the service, and how much of it at a time.
REVIEW_TYPE = "top_critic"
COUNTRY = "us"
PAGE_SIZE = 50


def newest_first() -> list[Column]:
    """Movies by year from the newest, movies without a year last, then by id."""
    return [F.desc_nulls_last("year"), F.asc("movie_id")]


def title_search(movies: DataFrame, query: str) -> DataFrame:
    """Movies whose title contains every word of the query, in any letter case.

    A blank query finds nothing.
    """
    words = query.split()
    return movies.where(contains_all(F.col("title"), words) if words else F.lit(False))


def reviews_of_movie(
    reviews: DataFrame, movie_id: object, review_type: str = REVIEW_TYPE, country: str = COUNTRY
) -> DataFrame:
    """One movie's reviews of one type and country; plain equality, so the scan filters."""
    return reviews.where(
        (F.col("movie_id") == F.lit(movie_id))
        & (F.col("review_type") == review_type)
        & (F.col("country") == country)
    )


def review_page(reviews: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    return page(reviews, "review_id", number=number, size=size)


def first_reviews(reviews: DataFrame, per_movie: int = PAGE_SIZE) -> DataFrame:
    """The first reviews of every movie, at most ``per_movie`` each: adds ``rank``."""
    return top_per_group(reviews, ["movie_id"], [F.asc("review_id")], per_movie)


def review_counts(reviews: DataFrame) -> DataFrame:
    """Reviews per movie: ``movie_id``, ``n_reviews``."""
    return reviews.groupBy("movie_id").agg(F.count(F.lit(1)).alias("n_reviews"))


def join_reviews(movies: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every review with its movie's columns; a movie without reviews has no row."""
    return join_dimension(reviews, movies, "movie_id")


def append_reviews(shown: DataFrame, *arrived: DataFrame) -> DataFrame:
    """Reviews shown so far and those that arrived; nothing is removed."""
    for batch in arrived:
        shown = shown.unionByName(batch)
    return shown

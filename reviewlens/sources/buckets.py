"""The catalogue and its reviews laid out by movie, for joins and counts without an exchange.

Both tables are written in the same number of buckets by movie, so a join meets bucket
by bucket and a count needs only its own. A movie with more reviews than a bucket should
hold, and reviews of no movie, would make one bucket a burden: these reviews go to a
table of their own that is not bucketed, and meet their movies, fewer than there are
buckets, by broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "movie_id"


@dataclass
class ReviewBuckets:
    """The written tables, named in the session's catalogue."""

    spark: SparkSession
    name: str

    @property
    def movies(self) -> DataFrame:
        return self.spark.table(f"{self.name}_movies")

    @property
    def reviews(self) -> DataFrame:
        """The reviews of movies that share a bucket."""
        return self.spark.table(f"{self.name}_reviews")

    @property
    def hot_reviews(self) -> DataFrame:
        return self.spark.table(f"{self.name}_hot_reviews")

    @property
    def hot_movies(self) -> DataFrame:
        return self.spark.table(f"{self.name}_hot_movies")

    def joined(self) -> DataFrame:
        """Every review with its movie's columns, as :func:`reviewlens.operators.catalog.join_reviews`."""
        near = self.reviews.join(self.movies, KEY)
        return near.unionByName(self.hot_reviews.join(F.broadcast(self.hot_movies), KEY))

    def counts(self) -> DataFrame:
        """Reviews per movie, as :func:`reviewlens.operators.catalog.review_counts`."""
        own = self.reviews.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_reviews"))
        return own.unionByName(self.hot_reviews.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_reviews")))

    def drop(self) -> None:
        """Take the tables out of the catalogue; their files stay where they were written."""
        for table in ("movies", "reviews", "hot_reviews", "hot_movies"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")


def write_review_buckets(
    movies: DataFrame, reviews: DataFrame, name: str, path: str, buckets: int | None = None
) -> ReviewBuckets:
    """Write movies (unique ids) and reviews in ``buckets``, by default as many as shuffle partitions.

    A movie is hot if it has more than an even bucket's share of the reviews, so there are
    fewer of them than buckets. Reviews are exchanged here, once, and never again.
    """
    spark = movies.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = reviews.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    share = F.lit((reviews.count() or 1) / buckets)
    hot = counts.where((F.col("_n") > share) & F.col(KEY).isNotNull()).select(KEY).collect()
    keys = [row[0] for row in hot]
    is_hot = F.col(KEY).isNull() | (F.col(KEY).isin(keys) if keys else F.lit(False))

    def save(df: DataFrame, table: str, bucketed: bool) -> None:
        writer = df.repartition(buckets, KEY).write.bucketBy(buckets, KEY).sortBy(KEY) if bucketed else df.write
        writer.format("parquet").option("path", f"{path}/{table}").saveAsTable(f"{name}_{table}")

    save(movies.where(F.col(KEY).isNotNull()), "movies", True)
    save(reviews.where(~is_hot), "reviews", True)
    save(reviews.where(is_hot), "hot_reviews", False)
    save(movies.where(F.col(KEY).isin(keys) if keys else F.lit(False)), "hot_movies", False)
    return ReviewBuckets(spark, name)

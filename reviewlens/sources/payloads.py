"""Landed JSON answers of a movie service: movies, reviews, and what was wrong.

A payload is one JSON object in ``value``; other columns, such as the movie id
and page from the folders it landed in, are kept. Unknown fields are ignored.
A bad element is set aside and the rest of its payload is kept.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.session import stored

# Field names of the answers, and elements per page.
MOVIE_SCHEMA = "id string, title string, year string, synopsis string"
REVIEW_SCHEMA = "critic string, quote string"
PAGE_SIZE = 50


class Parsed(NamedTuple):
    """Good rows, and a quarantine of ``reason``, ``element_no`` and ``raw``."""

    rows: DataFrame
    quarantine: DataFrame


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file: ``value`` and the partition columns of its folder."""
    return spark.read.text(path, wholetext=True)


def _judged(payloads: DataFrame, schema: str, field: str, reason: Column) -> DataFrame:
    """What is in the payloads, each parsed once, as a written table.

    One row for each element of the array ``field``: its place ``element_no``, the
    ``element`` if it is good, else the ``reason`` and its ``raw`` text; and one row, without
    a place, for each payload that has no such array. ``_value`` and ``_size`` name the payload
    and say how many elements it has. The array is read as JSON texts, and each text as an
    element of its own, so what is wrong in one says nothing about the others.
    """
    keep = [c for c in payloads.columns if c != "value"]
    broken = {"columnNameOfCorruptRecord": "_broken"}
    parsed = payloads.select(
        *keep,
        "value",
        F.xxhash64("value").alias("_value"),
        F.from_json("value", f"{field} array<string>, _broken string", broken).alias("_json"),
    )
    array = F.col(f"_json.{field}")
    usable = F.coalesce(F.col("_json._broken").isNull() & array.isNotNull(), F.lit(False))

    def part(at: Column, raw: Column) -> Column:
        return F.struct(at.cast("int").alias("element_no"), raw.alias("raw"))

    whole = F.array(part(F.lit(None), F.col("value")))
    parts = F.when(usable, F.transform(array, lambda raw, at: part(at, raw))).otherwise(whole)
    size = F.greatest(F.coalesce(F.size(array), F.lit(0)), F.lit(0)).alias("_size")
    elements = parsed.select(*keep, "_value", size, F.inline(parts))
    is_object = F.col("element_no").isNotNull() & F.ltrim("raw").startswith("{")
    element = F.when(is_object, F.from_json("raw", f"{schema}, _broken string", broken))
    elements = elements.withColumn("element", element)
    elements = elements.withColumn("element", F.when(F.col("element._broken").isNull(), F.col("element")))
    no_array = F.col("element_no").isNull()
    why = F.when(no_array, F.lit(f"no {field} array")).when(F.col("element").isNull(), "not an object").otherwise(reason)
    judged = elements.withColumn("reason", why)
    good = F.col("reason").isNull()
    raw, element = F.when(~good, F.col("raw")), F.when(good, F.col("element"))
    return stored(judged.select(*keep, "_value", "_size", "element_no", "reason", raw.alias("raw"), element.alias("element")))


def _quarantine(judged: DataFrame, keep: list[str]) -> DataFrame:
    return judged.where(F.col("reason").isNotNull()).select(*keep, "reason", "element_no", "raw")


def parse_movies(payloads: DataFrame) -> Parsed:
    """Movies of the payloads: ``movie_id``, ``year``, ``title``, ``synopsis``.

    A number given as text is a year, and so is one with a zero fraction; a movie
    without id, title or year is bad. Payloads are parsed once, into a table that both
    results read; :func:`reviewlens.session.release` removes it.
    """
    keep = [c for c in payloads.columns if c != "value"]
    year = F.regexp_replace("element.year", r"\.0+$", "").try_cast("int")
    reason = (
        F.when(F.col("element.id").isNull(), "no id")
        .when(F.col("element.title").isNull(), "no title")
        .when(year.isNull(), "no year")
    )
    judged = _judged(payloads, MOVIE_SCHEMA, "movies", reason)
    movies = judged.where(F.col("reason").isNull()).select(
        *keep,
        F.col("element.id").alias("movie_id"),
        year.alias("year"),
        F.col("element.title").alias("title"),
        F.col("element.synopsis").alias("synopsis"),
    )
    return Parsed(movies, _quarantine(judged, keep))


def _before(judged: DataFrame, own: list[str]) -> DataFrame:
    """``_before`` for each payload: how many elements the earlier ones of the same movie have.

    Payloads of a movie are those with equal columns but ``page``; they go by page, then
    by what they hold. Only their sizes are exchanged and added up; payloads alike in all
    are the same answer landed twice, and count once.
    """
    movie = [c for c in own if c != "page"]
    order = ["page", "_value"] if "page" in own else ["_value"]
    sizes = judged.select(*own, "_value", "_size").distinct()
    earlier = Window.partitionBy(*movie).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*own, "_value", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))


def parse_reviews(payloads: DataFrame) -> Parsed:
    """Reviews of the payloads: ``review_id``, ``critic``, ``quote``.

    ``review_id`` counts a movie's reviews from 0 over its payloads, in the order of the
    column ``page`` if there is one, whatever the size of a page; the other columns say
    which movie it is. A review without critic or quote is bad, and leaves its number.
    Payloads are parsed once, into a table that numbers and both results are taken from.
    """
    keep = [c for c in payloads.columns if c != "value"]
    reason = F.when(F.col("element.critic").isNull(), "no critic").when(F.col("element.quote").isNull(), "no quote")
    judged = _judged(payloads, REVIEW_SCHEMA, "reviews", reason)
    starts = _before(judged, keep)
    named = starts.select(*(F.col(c).alias(f"_own_{c}") for c in keep), F.col("_value").alias("_own"), "_before")
    good = judged.where(F.col("reason").isNull())
    same = good["_value"] == named["_own"]
    for c in keep:
        same = same & good[c].eqNullSafe(named[f"_own_{c}"])
    reviews = good.join(named, same).select(
        *keep,
        (F.col("_before") + F.col("element_no")).cast("bigint").alias("review_id"),
        F.col("element.critic").alias("critic"),
        F.col("element.quote").alias("quote"),
    )
    return Parsed(reviews, _quarantine(judged, keep))

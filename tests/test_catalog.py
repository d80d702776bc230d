import json

import pytest
from pyspark.sql import functions as F

from reviewlens.functions.catalog import synopsis_or_default
from reviewlens.operators import catalog
from reviewlens.operators.ranking import number_rows, page
from reviewlens.plans.search import search_movies, search_response
from reviewlens.sizing import hot_keys, join_dimension


@pytest.fixture(scope="module")
def movies(spark):
    return spark.createDataFrame(
        [
            ("1", 1999, "The Red Bus", None),
            ("2", 2015, "Grey Yard RED", ""),
            ("3", 1999, "Red Dawn", "Dawn breaks."),
            ("4", None, "Infrared", "Heat."),
            ("5", 2001, "Blue Bus", "Wheels."),
        ],
        "movie_id string, year int, title string, synopsis string",
    )


@pytest.fixture(scope="module")
def reviews(spark):
    given = [("1", i, f"c{i}", f"q{i}", "top_critic", "us") for i in range(120)]
    given += [("2", 0, "a", "b", "top_critic", "us"), ("2", 1, "a", "b", "all", "us")]
    given += [("2", 2, "a", "b", "top_critic", "fr")]
    schema = "movie_id string, review_id bigint, critic string, quote string, review_type string, country string"
    return spark.createDataFrame(given, schema)


def ids(df):
    return [r.movie_id for r in df.collect()]


def test_search_needs_every_word_in_any_case(movies):
    assert sorted(ids(catalog.title_search(movies, "red"))) == ["1", "2", "3", "4"]
    assert sorted(ids(catalog.title_search(movies, " BUS  red "))) == ["1"]
    assert ids(catalog.title_search(movies, "it's")) == []


@pytest.mark.parametrize("query", ["", "  ", "\t"])
def test_blank_search_finds_nothing(movies, query):
    assert ids(catalog.title_search(movies, query)) == []
    assert json.loads(search_response(movies, query).head().json) == {"query": query, "movies": []}


def test_newest_first_with_unknown_years_last(movies):
    assert ids(search_movies(movies, "red")) == ["2", "1", "3", "4"]


def test_pages(movies):
    assert ids(search_movies(movies, "red", number=2, size=3)) == ["4"]
    assert ids(search_movies(movies, "red", number=3, size=3)) == []
    with pytest.raises(ValueError):
        page(movies, "movie_id", number=0)


def test_default_synopsis(movies):
    shown = {r.movie_id: r.synopsis for r in search_movies(movies, "red").collect()}
    assert shown == {"1": "No synopsis.", "2": "No synopsis.", "3": "Dawn breaks.", "4": "Heat."}


def test_response_is_one_object_in_page_order(movies):
    found = json.loads(search_response(movies, "red", size=3).head().json)
    assert found["query"] == "red"
    assert found["movies"] == [
        {"mYear": 2015, "mId": "2", "mTitle": "Grey Yard RED", "mSynopsis": ""},
        {"mYear": 1999, "mId": "1", "mTitle": "The Red Bus"},
        {"mYear": 1999, "mId": "3", "mTitle": "Red Dawn", "mSynopsis": "Dawn breaks."},
    ]


def test_reviews_of_a_movie(reviews):
    assert catalog.reviews_of_movie(reviews, "2").count() == 1
    first = catalog.review_page(catalog.reviews_of_movie(reviews, "1"))
    assert [r.review_id for r in first.collect()] == list(range(50))
    last = catalog.review_page(catalog.reviews_of_movie(reviews, "1"), number=3)
    assert [r.review_id for r in last.collect()] == list(range(100, 120))


def test_first_reviews_of_every_movie(reviews):
    found = catalog.first_reviews(reviews)
    assert {r.movie_id: r["count"] for r in found.groupBy("movie_id").count().collect()} == {"1": 50, "2": 3}
    assert found.where("movie_id = '1'").agg(F.max("review_id")).head()[0] == 49


def test_counts_join_and_append(movies, reviews, rows):
    assert rows(catalog.review_counts(reviews)) == [("1", 120), ("2", 3)]
    joined = catalog.join_reviews(movies, reviews)
    assert joined.count() == 123
    assert joined.where("movie_id = '2'").head().title == "Grey Yard RED"
    assert catalog.append_reviews(reviews, reviews.limit(2), reviews).count() == 248


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot", [4, 5, None])
def test_joins_with_hot_keys_give_the_plain_result(spark, monkeypatch, rows, how, hot):
    """A third of the facts share one key: in the dimension, not in it, or NULL."""
    key = F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("id") % 50)
    facts = spark.range(3000).select("id", key.alias("key"))
    dimension = spark.range(0, 40, 2).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    plain = rows(facts.join(dimension, "key", how))
    assert rows(join_dimension(facts, dimension, "key", how)) == plain
    monkeypatch.setattr("reviewlens.sizing.BROADCAST_ROWS", 5)
    assert rows(join_dimension(facts, dimension, "key", how)) == plain
    monkeypatch.setattr("reviewlens.sizing.BROADCAST_ROWS", 500)
    monkeypatch.setattr("reviewlens.sizing.BROADCAST_BYTES", 10)
    assert rows(join_dimension(facts, dimension, "key", how)) == plain


def test_hot_keys_are_those_beyond_an_even_share(spark, rows):
    facts = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS key")
    assert rows(hot_keys(facts, ["key"])) == [(-1,)]
    assert rows(hot_keys(facts.where("key >= 0"), ["key"])) == []


@pytest.mark.parametrize("parts", [1, 9])
def test_row_numbers_follow_the_order(spark, parts):
    given = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(parts)
    found = number_rows(given, F.desc("v")).collect()
    assert {r.v: r.row_index for r in found} == {v: 999 - v for v in range(1000)}


def test_synopsis_column(spark):
    given = spark.createDataFrame([("x",), ("",), (None,)], "s string")
    shown = [r[0] for r in given.select(synopsis_or_default(F.col("s"))).collect()]
    assert shown == ["x", "No synopsis.", "No synopsis."]

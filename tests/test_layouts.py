"""Written layouts: an index of titles, numbered pages, review buckets."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import title_index
from reviewlens.operators.catalog import join_reviews, review_counts, title_search
from reviewlens.operators.pages import write_pages
from reviewlens.operators.title_index import word_grams, write_title_index
from reviewlens.sources.buckets import write_review_buckets

MOVIES = "movie_id bigint, title string, year int, gram string"
TITLES = ["Red Wid", "The red widow", "wid", "r", "", None, "Ünder RED", "redred wid wid", "a b c", "100% red_wid"]
QUERIES = ["red wid", "RED", "r", "wi", "redr", "", "  ", "ünd", "%", "d_w", "zzz", "red zzz", "e d", "edwid", "widow red the"]


def movie_rows(n=300):
    draw = random.Random(4)
    kinds = ["red", "blue", "widget", "gear", "Ring", "dot"]
    rows = [(i, title, 2000 + i, "g") for i, title in enumerate(TITLES)]
    rows += [(100 + i, " ".join(draw.choices(kinds, k=draw.randrange(1, 5))), draw.randrange(1950, 1960), None) for i in range(n)]
    return rows + [(None, "red null id", None, None), rows[1], rows[1]]


def scanned(df):
    """Rows that the scans of a frame gave, by the file each read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(at).metrics().apply("numOutputRows").value() for at in range(leaves.size()))


@pytest.fixture
def plain_plans(spark):
    """Plans as first made, so their scans can be looked at."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_grams_of_words():
    assert word_grams("ab") == ["ab"] and word_grams("abc") == ["abc"] and word_grams("ababa") == ["aba", "bab"]


@pytest.mark.parametrize("literal_rows", [1000, 0])
def test_index_finds_what_a_scan_finds(spark, rows, tmp_path, monkeypatch, literal_rows):
    monkeypatch.setattr(title_index, "LITERAL_ROWS", literal_rows)
    movies = spark.createDataFrame(movie_rows(60), MOVIES).repartition(3)
    index = write_title_index(movies, str(tmp_path / "index"))
    for query in QUERIES:
        found = index.search(query)
        assert found.columns == movies.columns
        assert rows(found) == rows(title_search(movies, query)), query


def test_index_of_nothing(spark, tmp_path):
    index = write_title_index(spark.createDataFrame([], MOVIES), str(tmp_path / "index"))
    assert index.search("red").count() == 0 and index.search("").count() == 0


def test_index_reads_little(spark, tmp_path, plan_of, plain_plans):
    """Of 20,000 titles, a search reads the blocks of its grams and of its candidates."""
    movies = spark.range(20_000).selectExpr("id AS movie_id", "concat('title ', md5(string(id))) AS title").repartition(16)
    index = write_title_index(movies, str(tmp_path / "index"))
    word = index.spark.read.parquet(f"{index.path}/titles").where("movie_id = 77").head().title.split()[1][:12]
    found = index.search(word)
    plan = plan_of(found)
    assert "In(_row" in plan or "EqualTo(_row" in plan
    assert [r.movie_id for r in found.collect()] == [77]
    assert scanned(found) <= 20_000 / 4
    postings = index.spark.read.parquet(f"{index.path}/postings")
    gram = index.rarest(word)[0][0]
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram" in plan_of(postings.where(F.col("gram") == gram))
    assert scanned(postings.where(F.col("gram") == gram)) < postings.count() / 2


@pytest.mark.parametrize("size", [1, 7, 50])
def test_pages(spark, tmp_path, size):
    movies = spark.createDataFrame(movie_rows(120), MOVIES).repartition(5)
    order = [F.desc_nulls_last("year"), F.asc_nulls_last("movie_id"), "title"]
    pages = write_pages(movies, str(tmp_path / "list"), *order)
    want = list(map(tuple, movies.orderBy(*order).collect()))
    assert pages.rows() == len(want)
    got, number = [], 1
    for number in (*range(1, 4), len(want) // size, len(want) // size + 1, 10_000):
        found = list(map(tuple, pages.page(number, size).collect()))
        assert found == want[(number - 1) * size : number * size]
    assert pages.page(1).columns == movies.columns
    with pytest.raises(ValueError):
        pages.page(0)


def test_pages_of_nothing(spark, tmp_path):
    pages = write_pages(spark.createDataFrame([], MOVIES), str(tmp_path / "list"), "movie_id")
    assert pages.rows() == 0 and pages.page(1).count() == 0 and pages.page(3).columns == ["movie_id", "title", "year", "gram"]


def test_a_deep_page_reads_its_part_only(spark, tmp_path, plan_of, plain_plans):
    numbers = spark.range(100_000).withColumn("half", F.col("id") % 2)
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        pages = write_pages(numbers, str(tmp_path / "list"), "half", "id")
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
    found = pages.page(1500, 50)
    assert [r.id for r in found.collect()] == list(range(2 * (1499 * 50 - 50_000) + 1, 2 * (1500 * 50 - 50_000), 2))
    plan = plan_of(found)
    assert "TakeOrderedAndProject" not in plan and "Exchange" not in plan and "PartitionFilters: [" in plan
    assert scanned(found) <= 15_000


REVIEWS = "movie_id bigint, review_id int, quote string"


def review_rows(hot=500):
    rows = [(7, i, "hot") for i in range(hot)] + [(i % 40, 1000 + i, None) for i in range(200)]
    return rows + [(None, 1, "no movie"), (None, 2, None), (99, 1, "unknown movie")]


@pytest.fixture
def buckets(spark, tmp_path):
    movies = spark.createDataFrame([(i, f"m{i}") for i in range(60) if i != 13] + [(None, "null")], "movie_id bigint, title string")
    reviews = spark.createDataFrame(review_rows(), REVIEWS).repartition(6)
    laid = write_review_buckets(movies, reviews, "laid", str(tmp_path / "laid"), 8)
    yield movies, reviews, laid
    laid.drop()


def test_buckets_give_the_same_rows(buckets, rows):
    movies, reviews, laid = buckets
    columns = ["movie_id", "review_id", "quote", "title"]
    assert rows(laid.joined(), *columns) == rows(join_reviews(movies, reviews), *columns)
    assert Counter(map(tuple, laid.counts().collect())) == Counter(map(tuple, review_counts(reviews).collect()))
    assert {r.movie_id for r in laid.hot_reviews.select("movie_id").distinct().collect()} == {7, None}


def test_buckets_need_no_exchange(spark, buckets, plan_of):
    _, _, laid = buckets
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = plan_of(laid.joined())
        own = plan_of(laid.reviews.groupBy("movie_id").count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in joined and "hashpartitioning" not in joined
    assert joined.count("BroadcastExchange (") >= 1 and "Exchange" not in own


def test_buckets_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], REVIEWS)
    laid = write_review_buckets(empty.select("movie_id"), empty, "none", str(tmp_path / "none"), 4)
    try:
        assert laid.joined().count() == 0 and laid.counts().count() == 0
    finally:
        laid.drop()

import json
import re

from reviewlens.sources.payloads import parse_movies, parse_reviews, read_payloads
from reviewlens.sources.texts import documents_from_rows, read_documents, read_stop_words, read_text_corpus


def payloads(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "page int, value string")


def movie(id="1", title="T", year=1999, **more):
    return {"id": id, "title": title, "year": year, **more}


def test_movies_and_quarantine(spark, rows):
    given = payloads(
        spark,
        json.dumps({"total": 3, "movies": [movie(synopsis="S", cast=[1, 2]), movie(2, year="2001")]}),
        json.dumps({"movies": [movie("3", year=""), movie("4"), movie("5", year="abc")]}),
        json.dumps({"movies": [{"title": "T", "year": 1}, {"id": "6", "year": 1}, None]}),
        json.dumps({"movies": []}),
        json.dumps({"reviews": []}),
        "",
        "[]",
        '{"movies": [{"id": "7", "title": "T", "year": 1999}, {"id',
        None,
        json.dumps({"movies": None}),
        json.dumps({"movies": [{"id": "8", "title": "T"}]}),
    )
    good, bad = parse_movies(given)
    assert rows(good) == [(0, "1", 1999, "T", "S"), (0, "2", 2001, "T", None), (1, "4", 1999, "T", None)]
    found = {(r.page, r.element_no): r.reason for r in bad.collect()}
    assert found == {
        (1, 0): "no year",
        (1, 2): "no year",
        (2, 0): "no id",
        (2, 1): "no title",
        (2, 2): "not an object",
        (4, None): "no movies array",
        (5, None): "no movies array",
        (6, None): "no movies array",
        (7, None): "no movies array",
        (8, None): "no movies array",
        (9, None): "no movies array",
        (10, 0): "no year",
    }


def test_reviews_count_over_pages(spark, rows):
    page = [{"critic": f"c{i}", "quote": f"q{i}", "date": "x"} for i in range(2)]
    given = spark.createDataFrame(
        [("9", 1, json.dumps({"reviews": page})), ("9", 2, json.dumps({"reviews": [*page, {"critic": "x"}]}))],
        "movie_id string, page int, value string",
    )
    good, bad = parse_reviews(given)
    assert rows(good, "movie_id", "review_id", "critic", "quote") == sorted(
        [("9", 0, "c0", "q0"), ("9", 1, "c1", "q1"), ("9", 2, "c0", "q0"), ("9", 3, "c1", "q1")], key=repr
    )
    assert rows(bad, "page", "element_no", "reason") == [(2, 2, "no quote")]


def test_payload_files_keep_the_columns_of_their_folders(spark, tmp_path, rows):
    for movie_id, kind in (("771", "top_critic"), ("772", "all")):
        folder = tmp_path / f"movie_id={movie_id}" / f"review_type={kind}" / "country=us"
        folder.mkdir(parents=True)
        body = {"reviews": [{"critic": "c", "quote": f"two\nlines {movie_id}"}]}
        (folder / "page1.json").write_text(json.dumps(body, indent=1))
    good, bad = parse_reviews(read_payloads(spark, str(tmp_path)))
    assert rows(good, "movie_id", "review_type", "country", "review_id", "quote") == [
        (771, "top_critic", "us", 0, "two\nlines 771"),
        (772, "all", "us", 0, "two\nlines 772"),
    ]
    assert bad.count() == 0


def test_stop_words_are_split_and_distinct(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("would\nwould\n the  a\t\n\nof")
    found = read_stop_words(spark, str(tmp_path / "stop.txt"))
    assert sorted(r.term for r in found.collect()) == ["a", "of", "the", "would"]


def test_text_corpus_is_numbered_in_file_and_line_order(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Droll.\r\n\r\n Dull? Très. \r\n\r\n".encode())
    (tmp_path / "b.txt").write_bytes(b"\r\nLast.")
    found = read_text_corpus(spark, str(tmp_path))
    assert {r.doc_id: r.text for r in found.collect()} == {0: "Droll.", 1: "Dull? Très.", 2: "Last."}


def test_long_text_corpus(spark, tmp_path):
    lines = [f"review {i}" for i in range(5000)]
    (tmp_path / "a.txt").write_text("\r\n\r\n".join(lines))
    found = read_text_corpus(spark, str(tmp_path))
    assert {r.doc_id: r.text for r in found.collect()} == dict(enumerate(lines))


def test_rows_in_memory(spark, rows):
    assert rows(documents_from_rows(spark, ["a", "b"])) == [(0, "a"), (1, "b")]


def test_documents_are_laid_out_by_key_or_left_in_place(spark, plan_of):
    path = "/root/testdata/sf0.001/documents.parquet"
    assert "Arguments: hashpartitioning(doc_id" in plan_of(read_documents(spark, path, per_document=True))
    whole = read_documents(spark, path)
    assert sorted(whole.columns) == ["doc_id", "text"]
    assert whole.count() == spark.read.parquet(path).count()


def test_a_bad_element_costs_only_itself(spark, rows):
    given = payloads(
        spark,
        '{"movies":[1,{"id":"a","title":"T","year":1999.0},"text",[{"id":"x"}],null,{"id":{"b":1},"title":"U","year":"2000"}]}',
        '{"movies":[{"id":"c","title":"V","year":2001.5},{"id":"d","title":"W","year":"1999.00"}]}',
        '{"movies":7}',
    )
    good, bad = parse_movies(given)
    assert rows(good) == [(0, "a", 1999, "T", None), (0, '{"b":1}', 2000, "U", None), (1, "d", 1999, "W", None)]
    assert rows(bad, "page", "element_no", "reason") == sorted(
        [(0, i, "not an object") for i in (0, 2, 3, 4)] + [(1, 0, "no year"), (2, None, "no movies array")], key=repr
    )


def test_review_ids_never_collide(spark, rows):
    def page(n, first=0):
        return json.dumps({"reviews": [{"critic": "c", "quote": f"q{first + i}"} for i in range(n)]})

    given = [("a", 1, page(120)), ("a", 2, page(3, 500)), ("b", 2, page(2)), ("b", 1, "broken"), (None, 1, page(1))]
    frame = spark.createDataFrame(given, "movie_id string, page int, value string")
    good, _ = parse_reviews(frame)
    ids = sorted(r.review_id for r in good.where("movie_id = 'a'").collect())
    assert ids == list(range(123))
    assert good.where("movie_id = 'a' AND page = 2").agg({"review_id": "min"}).head()[0] == 120
    assert rows(good.where("movie_id IS NULL"), "review_id") == [(0,)]
    pageless = spark.createDataFrame([("a", page(4)), ("a", page(4, 9))], "movie_id string, value string")
    assert sorted(r.review_id for r in parse_reviews(pageless).rows.collect()) == list(range(8))


def test_benchmark_is_numbered_without_the_driver(spark, rows, monkeypatch, tmp_path):
    from pyspark.sql import DataFrame

    from reviewlens.checks.queries import rows_in_memory

    given = [(item, f"text {item}") for item in (7, 3, 5)]
    spark.createDataFrame(given, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    collect, sent = DataFrame.collect, []
    monkeypatch.setattr(DataFrame, "collect", lambda df: sent.extend(df.columns) or collect(df))
    found = rows_in_memory(spark, str(tmp_path))
    assert "text" not in sent
    assert rows(found) == [(0, "text 3"), (1, "text 5"), (2, "text 7")]


def test_payloads_are_parsed_once(spark, rows, plan_of):
    """Numbers, rows and quarantine are taken from one table: none of them reads a payload again."""
    value = '{"reviews":[{"critic":"c","quote":"q"},7,{"critic":"d"}]}'
    given = spark.createDataFrame([(1, 1, value), (1, 2, "broken"), (1, 3, value.replace("q\"}", "r\"}"))], "movie_id int, page int, value string")
    good, bad = parse_reviews(given)
    for part in (good, bad):
        assert "from_json" not in plan_of(part) and not re.search(r"\bvalue#", plan_of(part))
    assert rows(good, "page", "review_id", "quote") == [(1, 0, "q"), (3, 3, "r")]
    assert rows(bad, "page", "element_no", "reason", "raw") == sorted(
        [(2, None, "no reviews array", "broken")]
        + [(p, 1, "not an object", "7") for p in (1, 3)]
        + [(p, 2, "no quote", '{"critic":"d"}') for p in (1, 3)],
        key=repr,
    )

import json

import pytest

from reviewlens.plans.opinions import review_opinions
from reviewlens.streaming.opinions import finish, opinion_schema, read_opinions, read_review_stream, start_opinions

LEXICON = {"good": 1, "bad": -1}
SCHEMA = "movie_id bigint, review_id bigint, text string"
KEYS = ("movie_id", "review_id")
REVIEWS = [
    {"movie_id": i % 2, "review_id": i, "text": f"Rose{'abc'[i % 3]} is {'good' if i % 2 else 'bad'}. She sings."}
    for i in range(6)
]


def land(folder, name, reviews):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, reviews)))


def run(spark, tmp_path, **options):
    stream = read_review_stream(spark, str(tmp_path / "in"), SCHEMA, files_per_batch=1)
    query = start_opinions(
        stream, str(tmp_path / "out"), str(tmp_path / "progress"), LEXICON, keys=KEYS, **options
    )
    finish(query, 300)
    return query


def test_batches_give_the_batch_result_and_restarts_add_only_new_files(spark, tmp_path, rows):
    for i in range(2):
        land(tmp_path / "in", f"r{i}.json", REVIEWS[2 * i : 2 * i + 2])
    land(tmp_path / "in", "empty.json", [])
    run(spark, tmp_path)
    run(spark, tmp_path)
    columns = [*KEYS, "chain_key", "topic", "score", "sentence"]
    whole = spark.createDataFrame(REVIEWS, SCHEMA)
    first = rows(review_opinions(whole.where("review_id < 4"), LEXICON, keys=KEYS), *columns)
    assert rows(read_opinions(spark, str(tmp_path / "out")), *columns) == first
    land(tmp_path / "in", "r2.json", REVIEWS[4:])
    run(spark, tmp_path)
    found = read_opinions(spark, str(tmp_path / "out"))
    assert rows(found, *columns) == rows(review_opinions(whole, LEXICON, keys=KEYS), *columns)
    assert {r.movie_id for r in found.where("movie_id = 1").collect()} == {1}


def test_nested_records_by_movie(spark, tmp_path):
    land(tmp_path / "in", "r.json", [*REVIEWS, {"movie_id": 7, "review_id": 0, "text": ""}])
    run(spark, tmp_path, nested=True, partition_by=["movie_id"])
    found = {(r.movie_id, r.review_id): r for r in read_opinions(spark, str(tmp_path / "out")).collect()}
    assert len(found) == 7
    assert found[7, 0].sentiments == []
    assert found[1, 1].review == REVIEWS[1]["text"]
    assert (tmp_path / "out" / "batch_id=0" / "movie_id=7").is_dir()


def test_opinions_of_an_unbounded_frame_need_no_batches(spark, tmp_path, rows):
    """With short lists the analysis is a projection, so it streams as it is."""
    land(tmp_path / "in", "r.json", REVIEWS)
    arriving = read_review_stream(spark, str(tmp_path / "in"), SCHEMA)
    found = review_opinions(arriving, LEXICON, keys=KEYS)
    assert found.isStreaming
    writer = found.writeStream.option("checkpointLocation", str(tmp_path / "progress"))
    finish(writer.trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet"), 300)
    whole = review_opinions(spark.createDataFrame(REVIEWS, SCHEMA), LEXICON, keys=KEYS)
    assert rows(spark.read.parquet(str(tmp_path / "out")), *whole.columns) == rows(whole)


def test_waiting_stream_times_out(spark, tmp_path):
    land(tmp_path / "in", "r.json", REVIEWS)
    stream = read_review_stream(spark, str(tmp_path / "in"), SCHEMA)
    query = start_opinions(
        stream, str(tmp_path / "out"), str(tmp_path / "progress"), LEXICON, keys=KEYS, until_empty=False
    )
    with pytest.raises(TimeoutError):
        finish(query, 2)


def test_a_stream_that_brought_nothing_is_empty(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run(spark, tmp_path)
    found = read_opinions(spark, str(tmp_path / "out"), opinion_schema(KEYS))
    assert found.count() == 0 and found.columns == [*KEYS, "chain_key", "topic", "score", "sentence", "batch_id"]
    assert read_opinions(spark, str(tmp_path / "out")).count() == 0


@pytest.mark.parametrize("nested", [False, True])
def test_the_schema_is_what_is_written(spark, tmp_path, nested):
    land(tmp_path / "in", "r.json", REVIEWS)
    run(spark, tmp_path, nested=nested)
    written = read_opinions(spark, str(tmp_path / "out"))
    assert dict(written.dtypes) == {f.name: f.dataType.simpleString() for f in opinion_schema(KEYS, nested)}


def test_half_written_batches_are_not_read(spark, tmp_path, monkeypatch):
    """A batch that breaks off between its files and the manifest is unseen, and is replayed whole."""
    from reviewlens.streaming import opinions as module

    landed, out = tmp_path / "landed", str(tmp_path / "out")
    landed.mkdir()
    schema = "doc_id bigint, text string"
    (landed / "a.json").write_text('{"doc_id": 1, "text": "Ann Bell sings. She is good."}\n')

    def run():
        reviews = read_review_stream(spark, str(landed), schema, "json")
        finish(start_opinions(reviews, out, str(tmp_path / "progress"), {"good": 1}))

    run()
    first = sorted(map(tuple, read_opinions(spark, out).collect()))
    assert first and module.committed(spark, out) == [0]
    (landed / "b.json").write_text('{"doc_id": 2, "text": "Cy Dunn acts. He is good."}\n')
    commit = module._commit

    def broken(*_):
        raise OSError("killed")

    monkeypatch.setattr(module, "_commit", broken)
    with pytest.raises(Exception):
        run()
    assert (tmp_path / "out" / "batch_id=1").is_dir()
    assert sorted(map(tuple, read_opinions(spark, out).collect())) == first
    monkeypatch.setattr(module, "_commit", commit)
    run()
    found = read_opinions(spark, out)
    assert {r.batch_id for r in found.collect()} == {0, 1} and found.where("batch_id = 0").count() == len(first)


def test_a_whole_batch_is_not_written_again(spark, tmp_path):
    from reviewlens.streaming import opinions as module

    out = str(tmp_path / "out")
    module._commit(spark, out, 0)
    landed = tmp_path / "landed"
    landed.mkdir()
    (landed / "a.json").write_text('{"doc_id": 1, "text": "Ann Bell sings."}\n')
    finish(start_opinions(read_review_stream(spark, str(landed), "doc_id bigint, text string"), out, str(tmp_path / "p"), {}))
    assert not (tmp_path / "out" / "batch_id=0").exists()

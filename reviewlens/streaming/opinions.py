"""Opinions of reviews as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from reviewlens.operators.sentences import Lexicon
from reviewlens.operators.tokens import Terms
from reviewlens.plans.opinions import Scorer, review_opinions, review_records
from reviewlens.session import file_system
from reviewlens.wordlists import ENGLISH_STOP_WORDS, PRONOUNS


def read_review_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    format: str = "json",
    files_per_batch: int | None = None,
    names: str = "*",
) -> DataFrame:
    """Reviews from files that land in a folder, with an explicit schema."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", names)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(format).load(path)


def _manifest(sink: str) -> str:
    """The folder with a file for each batch that is whole; Spark passes over such names."""
    return f"{sink}/_committed"


def committed(spark: SparkSession, sink: str) -> list[int]:
    """The batches whose rows are all there, in order."""
    files, place = file_system(spark, _manifest(sink))
    names = [status.getPath().getName() for status in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(name) for name in names if name.isdigit())


def _commit(spark: SparkSession, sink: str, batch_id: int) -> None:
    files, place = file_system(spark, f"{_manifest(sink)}/{batch_id}")
    files.create(place, True).close()


def start_opinions(
    reviews: DataFrame,
    sink: str,
    checkpoint: str,
    lexicon: Lexicon | None = None,
    stopwords: Terms = ENGLISH_STOP_WORDS,
    pronouns: Sequence[str] = tuple(PRONOUNS),
    scorer: Scorer | None = None,
    keys: Sequence[str] = ("doc_id",),
    nested: bool = False,
    partition_by: Sequence[str] = (),
    until_empty: bool = True,
) -> StreamingQuery:
    """Score arriving reviews (keys, ``text``) and append their opinions to ``sink``.

    A review is one row, so each batch is analysed on its own and no state is
    kept. A batch writes its own folder and is then entered in a manifest of whole batches.
    One that broke off is overwritten when it is replayed, one that is in the manifest is
    left alone, so a restart repeats nothing and readers see whole batches only.
    ``until_empty`` ends after what has landed; otherwise the query keeps waiting for more.
    """
    analyse = review_records if nested else review_opinions

    def process(batch: DataFrame, batch_id: int) -> None:
        files, entry = file_system(batch.sparkSession, f"{_manifest(sink)}/{batch_id}")
        if files.exists(entry):
            return
        found = analyse(
            batch, lexicon, stopwords, pronouns=pronouns, scorer=scorer, keys=keys
        )
        writer = found.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{sink}/batch_id={batch_id}")
        _commit(batch.sparkSession, sink, batch_id)

    stream = reviews.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    if until_empty:
        stream = stream.trigger(availableNow=True)
    return stream.start()


def finish(query: StreamingQuery, timeout: float | None = None) -> None:
    """Wait for the end of the stream; a failed stream is an error.

    Without ``timeout`` (seconds) it waits however long what has landed takes; with one
    a stream that has not ended by then is stopped, which is an error too.
    """
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream did not end within {timeout} seconds")


def opinion_schema(
    keys: Sequence[str] = ("doc_id",), nested: bool = False, key_type: str = "bigint"
) -> StructType:
    """What :func:`start_opinions` writes, with the ``batch_id`` of its folders."""
    own = "".join(f"{key} {key_type}, " for key in keys)
    opinions = "chain_key string, topic string, score int, sentence string"
    if nested:
        opinion = "struct<score: int, sentence: string>"
        opinions = f"review string, sentiments array<struct<topic: string, opinions: array<{opinion}>>>"
    return StructType.fromDDL(f"{own}{opinions}, batch_id int")


def read_opinions(spark: SparkSession, sink: str, schema: StructType | None = None) -> DataFrame:
    """All opinions of whole batches so far, with the ``batch_id`` that brought them.

    Only the folders of batches in the manifest are read: what a batch leaves behind that
    broke off is not seen. Filter the result by the key of one movie to start over for that
    movie. A stream that has brought nothing yet is an empty frame of ``schema``, by
    default that of flat opinions by ``doc_id``.
    """
    batches = committed(spark, sink)
    if not batches:
        return spark.createDataFrame([], schema or opinion_schema())
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("basePath", sink).parquet(*(f"{sink}/batch_id={batch_id}" for batch_id in batches))

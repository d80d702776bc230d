"""JSON and table outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def record_json(records: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One JSON object per review: ``{review, sentiments[{topic, opinions[{score, sentence}]}]}``."""
    return records.select(*keys, F.to_json(F.struct("review", "sentiments")).alias("json"))


def write_record_json(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Review records as files of JSON lines."""
    records.select("review", "sentiments").write.mode(mode).json(path)


def write_topics(topics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The readable topic table as Parquet, in topic and rank order."""
    topics.orderBy("topic", "rank").write.mode(mode).parquet(path)

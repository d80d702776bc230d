"""Keys that hold most rows, and texts that are very long."""

import random
import time
from collections import Counter

import pytest
from awkward import words
from pyspark.sql import functions as F
from test_group_operators import PAGES, plain_captures, plain_lines
from test_text_operators import plain_hits

from reviewlens import sizing
from reviewlens.llm import decontaminate, line_dedup, sharding, token_counts, warc

HIT_COLUMNS = ("doc_id", "n_words", "n_hit", "item_ids")


def hits_of(spark, docs, items):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    hits = decontaminate.benchmark_hits(frame, spark.createDataFrame(items, "item_id bigint, text string"))
    return hits.select("doc_id", "n_words", decontaminate.hit_words(F.col("spans")), "item_ids")


@pytest.mark.parametrize("block", [1, 5, 64])
def test_windows_across_blocks(spark, monkeypatch, block):
    """Items of one to thirty words, laid over the edges of blocks, the first and the last words."""
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    items = [(n, words(n, n, 10_000)) for n in (1, 2, 3, 9, 10, 11, 30)]
    docs = [(at, " ".join([words(at, at), items[at % 7][1], words(at + 1, at % 3)]).strip()) for at in range(80)]
    docs += [(100, None), (101, ""), (102, items[6][1]), (103, items[0][1])]
    found = sorted(map(repr, map(tuple, hits_of(spark, docs, items).collect())))
    assert found == sorted(repr((d, *plain_hits(t, items))) for d, t in docs)


def test_a_document_of_many_words(spark):
    """A text of 400,000 words is looked up block by block; one of half the length takes no less than a third of its time."""
    item = words(5, 30, 10**6)
    half = words(1, 200_000, 10**6)
    seconds = []
    for text in (half, f"{half} {half}"):
        start = time.perf_counter()
        row, = hits_of(spark, [(1, f"{text} {item}")], [(7, item)]).collect()
        seconds.append(time.perf_counter() - start)
        assert row[1] == len(text.split()) + 30 and row[2] == 30 and row[3] == ["7"]
    assert seconds[1] < 3 * seconds[0] + 5


def test_a_text_without_blanks_is_encoded_once():
    """Chunks of such a text would have to be joined again and again; it goes in one piece."""
    asked = []

    def encode(text):
        asked.append(len(text))
        return [(at, at + 1, ord(c)) for at, c in enumerate(text)]

    text = "字" * 300_000
    assert sum(1 for _ in token_counts.encode_huge(text, encode)) == 300_000 and asked == [300_000]
    asked.clear()
    rare = " ".join("字" * n for n in (70_000, 5, 90_000, 1, 200_000, 3))
    assert sum(1 for _ in token_counts.encode_huge(rare, encode)) == len(rare) and sum(asked) < 3 * len(rare)


def test_an_id_that_most_rows_have(spark, monkeypatch):
    """Its rows are numbered in parts, to the same slots."""
    draw = random.Random(2)
    rows = [(7, words(i, 3)) for i in range(900)] + [(None, f"n{i}") for i in range(300)]
    rows += [(draw.randrange(1000), f"x{i}") for i in range(300)] + [(7, "same"), (7, "same"), (8, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    columns = ["doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"]
    want = sorted(map(repr, map(tuple, sharding.shard_documents(frame, 2).select(*columns).collect())))
    monkeypatch.setattr(sharding, "SLOT_ROWS", 20)
    found = sharding.shard_documents(frame, 2)
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_task = sharding.shard_documents(frame, 2).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in per_task) < 600


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_a_payload_that_most_pages_have(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", broadcast_rows)
    rows = [(i, f"http://h{i % 9}.org/{i}", None if i % 2 else "") for i in range(900)]
    rows += [(1000 + i, "http://x.org", f"page {i // 2}") for i in range(100)] + [(None, "u", "page 3"), (None, "u", "alone")]
    for least in (0, 1):
        found = warc.captures(spark.createDataFrame([(*r, "r", 1) for r in rows], PAGES).repartition(4), least_bytes=least)
        some = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert Counter(map(tuple, some.collect())) == plain_captures(rows, least)


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_a_half_that_most_lines_have(spark, monkeypatch, broadcast_rows):
    """Log lines: the first half is the same in all, some are one edit apart."""
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", broadcast_rows)
    draw = random.Random(6)
    head = "2024-01-01 INFO server started a request "
    rows = [(i, head + words(i // 2, 4) + ("" if i % 2 else draw.choice("xyz"))) for i in range(120)]
    rows += [(500 + i, words(i, 9)) for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = plain_lines(rows)
    found = sorted(map(tuple, line_dedup.dedup_lines(frame).collect()))
    assert found == sorted((d, *plain[(d, t)]) for d, t in rows)

"""Frames that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, shard int, "
    "fp bigint, row_a bigint, line string, words string, spans string, times bigint, key string, start int"
)
"""The columns of documents, and names that operators use inside."""


def words(seed: int, n: int, vocabulary: int = 300) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def awkward_rows() -> list[tuple]:
    prose = [words(seed, 60) for seed in range(6)]
    texts: list[tuple] = [(i, text, "xx", "b") for i, text in enumerate(prose)]
    texts += [
        (10, None, "xx", "b"),
        (11, "", None, None),
        (12, " \n\t ", "yy", ""),
        (13, prose[0], "xx", "b"),
        (13, prose[0], "xx", "b"),
        (14, prose[0].upper(), None, "a"),
        (None, prose[1], "xx", None),
        (None, None, None, None),
        (15, "ÄÖÜ élan naïve Straße ПРИВЕТ мир 日本語 \U0001f600", "yy", "é"),
        (16, "x" * 70_000, "yy", "a"),
        (17, words(99, 30_000, 5_000), "xx", "b"),
        (18, "12345 !!! ...", "yy", "a"),
        (-5, prose[2] + "\n" + prose[3], "xx", "a"),
    ]
    return [(*t, None, 1, 2, 3, 4, "l", "w", "s", 5, "k", 6) for t in texts]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

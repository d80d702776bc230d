"""Shards by jump consistent hashing.

A document's shard follows from its key and the number of shards alone: no table of
the ring, no state. With one shard more, a row either stays or moves to the new shard,
and only the share that the new shard needs moves. Everything is a column expression.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the published method.
MULTIPLIER = 2862933555777941757
SCALE = float(1 << 31)

HALF = (1 << 32) - 1
SLOT_ROWS = 2_000
SLOT_RANGES = 256
"""Slots are numbered within ranges of ids: so many rows at least, so many ranges at most."""

HOT_PARTS_BITS = 6
"""Rows of an id that fills a range by itself are numbered in so many parts, by the first bits of their CRC."""

BROADCAST_ROWS = 100_000
LEAST_ID = -(1 << 63)
"""Stands for a null id where rows are put in order."""


def _shift(value: Column, bits: int) -> Column:
    return F.shiftrightunsigned(value, bits)


def _advanced(high: Column, low: Column) -> tuple[Column, Column]:
    """The 64-bit state times the multiplier plus one, in halves that cannot overflow."""
    c_high, c_low = MULTIPLIER >> 32, MULTIPLIER & HALF
    upper = _shift(low, 16) * c_low
    lower = (low.bitwiseAND(0xFFFF) * c_low) + F.shiftleft(upper.bitwiseAND(0xFFFF), 16) + 1
    carry = _shift(lower, 32) + _shift(upper, 16)
    cross = (high.bitwiseAND(0xFFFF) * c_low) + F.shiftleft((_shift(high, 16) * c_low).bitwiseAND(0xFFFF), 16)
    new_high = carry + (low * c_high).bitwiseAND(HALF) + cross.bitwiseAND(HALF)
    return new_high.bitwiseAND(HALF), lower.bitwiseAND(HALF)


def jump_shards(key: Column, shards: int) -> Column:
    """A struct of ``shard`` among ``shards`` and ``grown`` among one more.

    ``key`` is a 64-bit integer; null is the key 0. The walk makes a jump for each shard
    it visits, about ``ln(shards)`` of them. It is given far more steps than that at
    first, and one step for each shard if they should not do.
    """
    if not 1 <= shards < (1 << 31) - 1:
        raise ValueError("shards is 1 or more, and fits an int")
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    last = F.lit(shards).cast("bigint")
    start = F.struct(
        _shift(key, 32).alias("high"),
        key.bitwiseAND(F.lit(HALF)).alias("low"),
        F.lit(-1).cast("bigint").alias("before"),
        F.lit(-1).cast("bigint").alias("at"),
        F.lit(0).cast("bigint").alias("to"),
    )

    def step(seen: Column, _: Column) -> Column:
        high, low = _advanced(seen["high"], seen["low"])
        to = F.floor((seen["to"] + 1).cast("double") * (F.lit(SCALE) / (_shift(high, 1) + 1).cast("double")))
        moved = F.struct(
            high.alias("high"),
            low.alias("low"),
            seen["at"].alias("before"),
            seen["to"].alias("at"),
            to.cast("bigint").alias("to"),
        )
        return F.when(seen["to"] > last, seen).otherwise(moved)

    def walk(steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)

    def answer(seen: Column) -> Column:
        return F.struct(
            F.when(seen["at"] == last, seen["before"]).otherwise(seen["at"]).cast("int").alias("shard"),
            seen["at"].cast("int").alias("grown"),
        )

    few = min(shards + 1, 64 + 16 * math.ceil(math.log(shards + 1)))
    if few == shards + 1:
        return F.aggregate(F.sequence(F.lit(1), F.lit(few)), start, step, answer)
    whole = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step, answer)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(few)), start, step, lambda s: F.when(s["to"] > last, answer(s)).otherwise(whole)
    )


def _range_of(value: Column, cuts: list[int]) -> Column:
    """How many cuts lie below the value, found by halving."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > F.lit(cuts[middle]), search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(cuts))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    ``size`` is the UTF-8 bytes of the text plus 16; a null text has none, and a CRC of 0.
    ``law`` is ``key``: ``doc_id`` and the number of shards decide, so equal ids share a
    shard, and a null id is placed as 0. ``slot`` numbers the rows of a shard from 0 by
    ``doc_id`` (null first), then CRC and size. No shard is numbered by one task: ranges
    of ids are numbered apart, after the counts of the ranges before, and the rows of an id
    that very many share in parts by their CRC. Every row is kept.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint"))
    place = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST_ID))
    ids = docs.select(place.alias("place"))
    total, = ids.agg(F.count(F.lit(1))).first()
    ranges = max(1, min(SLOT_RANGES, total // (shards * SLOT_ROWS)))
    cuts: list[int] = []
    hot: list[int] = []
    if ranges > 1:
        points = Counter(ids.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)])).first()[0])
        # An id that is several of the points fills ranges: it becomes a range of its own.
        hot = sorted(point for point, times in points.items() if times > 1)
        cuts = sorted({*points, *(point - 1 for point in hot if point > LEAST_ID)})
    placed = jump_shards(key, shards)
    crc = F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))
    part = _range_of(place, cuts)
    sub = F.when(place.isin(hot), _shift(crc, 32 - HOT_PARTS_BITS)).otherwise(0) if hot else F.lit(0)
    sub = sub.cast("int")
    id_rows = docs.select(placed["shard"].alias("shard"), part.alias("part"), sub.alias("sub"))
    counts = id_rows.groupBy("shard", "part", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    if shards * (len(cuts) + 1 + (len(hot) << HOT_PARTS_BITS)) <= BROADCAST_ROWS:
        starts = F.broadcast(starts)

    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        crc.alias("text_crc32"),
        placed.alias("placed"),
        part.alias("part"),
        sub.alias("sub"),
    )
    rows = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        "part",
        "sub",
        F.col("placed.shard").alias("shard"),
        F.col("placed.grown").alias("grown_shard"),
    )
    order = Window.partitionBy("shard", "part", "sub").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size")
    rows = rows.withColumn("place", F.row_number().over(order)).join(starts, ["shard", "part", "sub"])
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("place") - 1).cast("long").alias("slot"),
        "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """The documents as Parquet, one folder per shard."""
    placed = docs.withColumn("shard", jump_shards(F.col("doc_id"), shards)["shard"])
    placed.write.partitionBy("shard").parquet(path)

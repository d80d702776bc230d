"""Mixing sources to target weights by subset sums over exact lengths.

Each source has a budget of words. Whole passes over the source come first; what is left
of the budget is fitted from the histogram of document lengths: the proportional share
of each length, then single documents from the longest down, then a bounded knapsack over
the lengths for the last few words. The fit says how many documents of each length are
taken, and seeded places among the documents of a length say which.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.columns import BLANKS, pieces
from reviewlens.session import durable

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
"""Weights by source in order, budget as a share of all words, and passes at the most."""

SEED = 20240501
SPREAD = 1024
"""Documents of one source and length are numbered in so many parts."""

KNAPSACK = 1 << 16
"""The last words of a budget, fitted exactly, are at most so many or one longest document."""


def word_count(text: Column) -> Column:
    return F.size(pieces(text, BLANKS)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """``key``, ``source_size``, ``target`` from ``key``, ``source_size``.

    Sources are weighed in the order of their keys by the weights in turn. The budget is
    shared by weight; a source stops at ``most`` times its size and the excess is shared
    again. Taken by rising ``size / weight``, a source is full if its share of what the
    full ones before it leave is more than it can give; the first that is not sets the
    level for all that follow. Only these rows, one for each source, pass one task.
    """
    everything = Window.partitionBy(F.lit(0))
    turn = ((F.row_number().over(everything.orderBy("key")) - 1) % len(weights)).cast("int")
    weight = F.get(F.array(*map(F.lit, weights)), turn)
    by_need = everything.orderBy((F.col("source_size") / F.col("weight")).asc(), "key")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    words_left = share * F.sum("source_size").over(everything) - most * F.coalesce(
        F.sum("source_size").over(before), F.lit(0)
    )
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    cap = (most * F.col("source_size")).cast("double")
    open_level = F.when(F.col("level") * F.col("weight") < cap, F.col("level"))
    first_open = F.first(open_level, ignorenulls=True).over(
        by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    found = sizes.select("key", "source_size", weight.alias("weight"))
    found = found.withColumn("level", words_left / weight_left).withColumn("open", first_open)
    target = F.when(F.col("open").isNull(), cap).otherwise(F.least(cap, F.col("open") * F.col("weight")))
    return found.select("key", "source_size", target.alias("target"))


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length add up to the budget, or as near below as can be.

    ``lengths`` are distinct and positive. Proportional shares keep the mix of lengths
    and leave less than the sum of the distinct lengths; single documents from the
    longest down leave a few words, and the knapsack closes those.
    """
    total = sum(length * count for length, count in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    take = [count * budget // total for count in counts]
    rest = budget - sum(length * n for length, n in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    window = max(KNAPSACK, lengths[order[0]])
    while rest > window:
        for i in order:
            if rest > window and take[i] < counts[i]:
                take[i] += 1
                rest -= lengths[i]
    for i, n in _knapsack([(i, lengths[i], counts[i] - take[i]) for i in order], rest).items():
        take[i] += n
    return take


def _knapsack(items: list[tuple[int, int, int]], budget: int) -> dict[int, int]:
    """Counts of ``(key, length, available)`` whose lengths sum as near below the budget as can be.

    A bit set holds the sums that can be made. Each length is added in lots of 1, 2, 4
    and so on, so any number of it up to what there is can be chosen; the walk back finds
    the lots that made the best sum. No more lots are added once the budget can be made.
    """
    mask = (1 << (budget + 1)) - 1
    reach, lots = 1, []
    for key, length, available in items:
        left, lot = min(available, budget // length), 1
        while left > 0 and not reach >> budget & 1:
            lot = min(lot, left)
            grown = (reach | (reach << (lot * length))) & mask
            if grown != reach:
                lots.append((key, lot, lot * length, reach))
                reach = grown
            left -= lot
            lot *= 2
    chosen: dict[int, int] = {}
    at = reach.bit_length() - 1
    for key, lot, words, before in reversed(lots):
        if not before >> at & 1:
            at -= words
            chosen[key] = chosen.get(key, 0) + lot
    return chosen


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    """For each length of one source: whole passes, and how many documents go once more."""
    total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    passes = min(int(target // total), MOST) if total else 0
    rest = int(target) - passes * total
    some = group[group["size"] > 0]
    more: dict[int, int] = {}
    if rest > 0:
        lengths = some["size"].tolist()
        more = dict(zip(lengths, fit(lengths, some["n"].tolist(), rest), strict=True))
    return group.assign(passes=passes, more=[more.get(size, 0) for size in group["size"].tolist()]).drop(columns="n")


def _taken(sized: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """``sized`` with ``source_size``, ``target`` and ``times``, how often each row is taken."""
    parts = sized.groupBy("key", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    lengths = parts.groupBy("key", "size").agg(F.sum("n").alias("n"))
    sizes = lengths.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    histogram = lengths.join(source_targets(sizes, weights, share), "key")
    plans = histogram.groupBy("key").applyInPandas(
        _plan, "key string, size bigint, source_size bigint, target double, passes bigint, more bigint"
    )
    before = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("key", "size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    cuts = starts.join(plans, ["key", "size"])
    order = Window.partitionBy("key", "size", "part").orderBy("draw", "doc_id", "row_a", "row_b")
    placed = sized.withColumn("place", F.row_number().over(order)).join(cuts, ["key", "size", "part"])
    once_more = (F.col("start") + F.col("place") <= F.col("more")).cast("long")
    return placed.withColumn("times", F.col("passes") + once_more)


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    draw = F.xxhash64(F.lit(seed), "doc_id")
    return docs.select(
        "doc_id",
        _key().alias("key"),
        word_count(F.col("text")).alias("size"),
        draw.alias("draw"),
        F.pmod(draw, F.lit(SPREAD)).cast("int").alias("part"),
        *_row(),
    )


def _key() -> Column:
    """The source as text that is never null, and orders as code points with null last."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(">"))


def _row() -> list[Column]:
    """128 bits that equal rows share."""
    return [F.xxhash64(F.lit(salt), "doc_id", _key(), "text").alias(f"row_{salt}") for salt in "ab"]


def mixture(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED
) -> DataFrame:
    """One row per document row: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``.

    ``taken`` is the words that the mix takes of a document: its size no, one or two
    times. A null or blank text has size 0; a null source is a source and comes last. A
    source without words has target 0. The seed and the rows alone decide, so reruns
    agree; of rows that are alike in all of this, it does not matter which is taken.
    """
    sized = durable(_sized(docs, seed))
    return _taken(sized, weights, share).select(
        "doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, with their columns.

    A document of no words has no part in any target and is taken once for each whole
    pass over its source.
    """
    sized = durable(_sized(docs, seed))
    alike = Window.partitionBy("row_a", "row_b")
    taken = _taken(sized, weights, share).where(F.col("times") > 0).select("row_a", "row_b", "times")
    taken = taken.withColumn("copy", F.row_number().over(alike.orderBy(F.desc("times"))))
    taken = taken.select(F.col("row_a").alias("_a"), F.col("row_b").alias("_b"), F.col("copy").alias("_copy"), "times")
    row_a, row_b = _row()
    whole = docs.select(F.struct(*docs.columns).alias("row"), row_a, row_b)
    whole = whole.withColumn("copy", F.row_number().over(alike.orderBy("row_a")))
    found = whole.join(
        taken, (F.col("row_a") == F.col("_a")) & (F.col("row_b") == F.col("_b")) & (F.col("copy") == F.col("_copy"))
    )
    again = F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_")
    return found.select("row", again).select("row.*")

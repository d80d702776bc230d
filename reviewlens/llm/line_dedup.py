"""Line dedup with an edit bound of one, by a join of deletion neighbourhoods.

Two lines are one edit apart exactly if deleting one character from each, at the same
place, makes them equal, or deleting one from the longer makes it the shorter. So every
line emits hashes of all its variants with one character less, lines with equal variants
meet, the edit distance of those that met is verified, and the earliest stays.

A line of ``n`` characters has ``n`` variants, so two things keep that small. Lines an edit
apart share their first or their last half, so only lines that share a half with another
one go on. And a variant is hashed as what stands before a block, the block less one
character, and what follows; variants of a block are emitted only if another line is the
same before and after it, as a line an edit apart is around the edit.

A bucket of equal variants gives each line its earliest partner and never a pair of all.
Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.session import durable, stored
from reviewlens.sizing import join_dimension

LEAST = 20
"""Shorter lines are compared exactly only: an edit is too much of them."""

STEP = 16
BLOCK = 64
BROADCAST_LINES = 200_000
"""The places of so many lines, some 50 bytes each, are broadcast; more are joined by exchange."""


def _two(*values: Column) -> list[Column]:
    """128 bits of hash."""
    return [F.xxhash64(F.lit(salt), *values).alias(f"h{salt}") for salt in (1, 2)]


def _half(length: Column) -> Column:
    """Characters of a half, in steps: at most half of a line."""
    return F.floor(length / (2 * STEP)) * STEP


def _halves(line: Column, length: Column) -> Column:
    """Hashes of the halves of a line.

    A line an edit longer may stand at the next step, so a line whose length begins a step
    emits the halves of the step before as well.
    """

    def both(half: Column) -> list[Column]:
        half = F.greatest(half, F.lit(LEAST // 2)).cast("int")
        start = F.substring(line, F.lit(1), half)
        end = F.substring(line, (length - half + 1).cast("int"), half)
        return [F.xxhash64(F.lit("start"), half, start), F.xxhash64(F.lit("end"), half, end)]

    own, before = both(_half(length)), both(_half(length - 1))
    return F.when(_half(length) == _half(length - 1), F.array(*own)).otherwise(F.array(*own, *before))


def _occurrences(docs: DataFrame) -> DataFrame:
    """Lines that are not blank: ``doc_id``, ``row``, ``line_no`` from 1, hashes ``h1 h2``, ``halves``, ``line``."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.trim("line") != "").withColumn("line_no", F.col("line_no") + 1)


def _blocks(lines: DataFrame) -> DataFrame:
    """Blocks of lines outside of which another line is the same.

    ``at_line start block head tail whole_tail``: hashes of what stands before the block,
    and of what follows it, once with one character more in the block. Two lines an edit
    apart share, at the block of the edit, the head and a tail.
    """
    length = F.char_length("line")
    # One start past the end as well: there the longer of two lines may have its last character.
    starts = F.sequence(F.lit(0), F.floor(length / BLOCK).cast("int") * BLOCK, F.lit(BLOCK))
    blocks = lines.select("at_line", "line", F.explode(starts).alias("start"))
    rest = F.greatest(length - F.col("start"), F.lit(0))
    parts = blocks.select(
        "at_line",
        "start",
        F.xxhash64(F.substring("line", F.lit(1), F.col("start"))).alias("head"),
        F.substring("line", F.col("start") + 1, F.lit(BLOCK + 1)).alias("block"),
        F.xxhash64(F.substring("line", F.col("start") + BLOCK + 1, rest)).alias("whole_tail"),
        F.xxhash64(F.substring("line", F.col("start") + BLOCK + 2, rest)).alias("tail"),
    )
    frames = F.array_distinct(F.array(*(F.xxhash64("start", "head", tail) for tail in ("tail", "whole_tail"))))
    framed = parts.select("*", F.explode(frames).alias("frame"))
    shared = framed.groupBy("frame").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("frame")
    # A frame that very many lines share is spread over tasks.
    met = join_dimension(framed, stored(shared), "frame", "left_semi")
    return met.drop("frame").dropDuplicates(["at_line", "start"])


def _variants(lines: DataFrame) -> DataFrame:
    """``h1 h2 at at_line``: lines with one character less, and whole, block by block.

    ``at`` is the place of the deletion, null for the whole line.
    """
    # Places 1 to the block's length delete that character; 0 stands for the whole line.
    places = F.sequence(F.lit(0), F.least(F.char_length("block"), F.lit(BLOCK)))
    each = _blocks(lines).select("*", F.explode(places).alias("place"))
    less = F.concat(
        F.substring("block", F.lit(1), F.col("place") - 1),
        F.substring("block", F.col("place") + 1, F.lit(BLOCK + 1)),
    )
    whole = F.col("place") == 0
    middle = F.when(whole, F.substring("block", 1, BLOCK)).otherwise(less)
    tail = F.when(whole, F.col("whole_tail")).otherwise(F.col("tail"))
    return each.select(
        *_two(F.col("start"), F.col("head"), middle, tail),
        F.when(~whole, F.col("place")).alias("at"),
        "at_line",
    )


def _earliest_partners(lines: DataFrame) -> DataFrame:
    """``at_line`` and ``partner``, the earliest earlier line an edit apart; lines are ``at_line line``."""
    variants = _variants(lines)
    bucket = Window.partitionBy("h1", "h2")
    same_place = Window.partitionBy("h1", "h2", "at")
    is_whole = F.col("at").isNull()
    met = variants.select(
        "at_line",
        F.when(~is_whole, F.min("at_line").over(same_place)).alias("replaced"),
        F.when(~is_whole, F.min(F.when(is_whole, F.col("at_line"))).over(bucket))
        .otherwise(F.min(F.when(~is_whole, F.col("at_line"))).over(bucket))
        .alias("shifted"),
    )
    partner = F.least("replaced", "shifted")
    found = met.where(partner < F.col("at_line")).groupBy("at_line").agg(F.min(partner).alias("partner"))
    own = lines.select("at_line", "line")
    other = lines.select(F.col("at_line").alias("partner"), F.col("line").alias("partner_line"))
    checked = found.join(own, "at_line").join(other, "partner")
    return checked.where(F.levenshtein("line", "partner_line", 1).between(0, 1)).select("at_line", "partner")


def line_decisions(docs: DataFrame) -> DataFrame:
    """Dropped lines: ``doc_id``, ``row``, ``line_no``, ``near`` (an earlier line is one edit apart)."""
    lines = _occurrences(docs)
    length = F.char_length("line")
    halves = F.when(length >= LEAST, _halves(F.col("line"), length)).otherwise(F.array().cast("array<bigint>"))
    seen = durable(lines.select("doc_id", "row", "line_no", *_two(F.col("line")), halves.alias("halves")))

    at_line = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "row", "line_no")
    texts = seen.groupBy("h1", "h2").agg(
        F.min(at_line).alias("at_line"), F.count(F.lit(1)).alias("n"), F.first("halves").alias("halves")
    )
    texts = durable(texts)
    keyed = texts.select("at_line", F.explode("halves").alias("half"))
    shared = keyed.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("half")
    near_texts = join_dimension(keyed, stored(shared), "half", "left_semi").select("at_line").distinct()
    places = durable(near_texts.select("at_line.doc_id", "at_line.row", "at_line.line_no"))
    wanted = F.broadcast(places) if places.count() <= BROADCAST_LINES else places
    here = lines.alias("l").join(
        wanted.alias("w"),
        F.col("l.doc_id").eqNullSafe(F.col("w.doc_id"))
        & (F.col("l.row") == F.col("w.row"))
        & (F.col("l.line_no") == F.col("w.line_no")),
        "left_semi",
    )
    near_lines = durable(here.select(at_line.alias("at_line"), "line"))
    near = _earliest_partners(near_lines).join(near_lines, "at_line")
    near = near.select(*_two(F.col("line")), F.lit(True).alias("near"))
    exact = texts.where(F.col("n") > 1)
    exact = exact.select("h1", "h2", F.col("at_line").alias("first"), F.lit(False).alias("near"))
    both = exact.unionByName(near, allowMissingColumns=True)
    repeated = both.groupBy("h1", "h2").agg(F.max("near").alias("near"), F.max("first").alias("first"))
    # From a table both sides of this join are exchanged for it, so a very common line can be split.
    repeated = stored(repeated)
    met = seen.select("doc_id", "row", "line_no", "h1", "h2").join(repeated, ["h1", "h2"])
    dropped = F.col("near") | (F.col("first") != at_line)
    return met.where(dropped).select("doc_id", "row", "line_no", "near")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """One row per document row: ``doc_id``, kept ``text``, ``n_lines``, ``n_exact``, ``n_near``.

    Lines stand between ``\\n``. In the order of ``doc_id`` (null first), then of the rows
    that share it, then of the lines, a line is dropped if an earlier one, dropped or not,
    is equal or one edit apart. ``n_near`` are the dropped lines whose text first occurs
    after one that is an edit apart, ``n_exact`` the others. Edits are insertions,
    deletions and replacements of a character, and count for lines of at least 20
    characters. Blank lines stay and are not counted as dropped. Rows alike in id and text
    are one document, given back as often as it was. A null text stays null and has no
    lines; an empty one has one blank line.
    """
    dropped = line_decisions(docs)
    lists = dropped.groupBy("doc_id", "row").agg(
        F.collect_set("line_no").alias("gone"),
        F.size(F.collect_set(F.when(F.col("near"), F.col("line_no")))).cast("long").alias("n_near"),
    )
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "gone", "n_near")
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))
    joined = rows.join(lists, same, "left")
    held = joined.select("doc_id", "text", "gone", "n_near", F.split("text", "\n").alias("lines"))
    stay = F.array_except(F.sequence(F.lit(1), F.size("lines")), "gone")
    kept = F.transform(stay, lambda line_no: F.get("lines", line_no - 1))
    n_near = F.coalesce("n_near", F.lit(0)).cast("long")
    n_gone = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    return held.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("lines").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        (n_gone - n_near).alias("n_exact"),
        n_near.alias("n_near"),
    )

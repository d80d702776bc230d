"""Exact dedup by progressive refinement: length, then prefix, then the whole text.

Each step groups only what the step before left in a group of two or more. Lengths and
hashes of prefixes are written once and grouped there; the whole text is read and hashed
only where length and prefix are shared.

Which groups survive is told to the scan by a filter of a fixed size: one bit for each
hash of a repeated key, in at most ``WORDS`` words of 64 bits. A text whose bit is not set
has no copy; one whose bit is set for another key's sake is hashed, and found alone, in
the next step. So no text is moved to be judged, whatever the number of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.session import durable, stored
from reviewlens.sizing import join_dimension

PREFIX = 64
"""Characters of the prefix."""

WORDS = 1 << 18
"""Words of a filter at most; it is broadcast, at some 40 bytes a word."""


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _length() -> Column:
    return F.octet_length(_text()).cast("bigint")


def _prefix() -> Column:
    return F.xxhash64(F.substring(_text(), 1, PREFIX))


def _word(*key: str) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(*key), 6), F.lit(WORDS))


def _bit(*key: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.xxhash64(*key).bitwiseAND(63).cast("int"))


def _repeated(rows: DataFrame, *key: str) -> DataFrame:
    """The filter of the keys that two rows or more have: ``_word``, ``_bits``."""
    shared = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    bits = shared.groupBy(_word(*key).alias("_word")).agg(F.bit_or(_bit(*key)).alias("_bits"))
    return durable(bits)


def _marked(rows: DataFrame, bits: DataFrame, *key: str) -> DataFrame:
    """``rows`` with ``_shared``: false if no other row has the key."""
    met = rows.withColumn("_word", _word(*key)).join(F.broadcast(bits), "_word", "left")
    shared = F.coalesce(F.col("_bits").bitwiseAND(_bit(*key)) != 0, F.lit(False))
    return met.withColumn("_shared", shared).drop("_word", "_bits")


def _survivors(docs: DataFrame) -> DataFrame:
    """The filter of the pairs of length and prefix that two texts or more share."""
    rows = durable(docs.select(_length().alias("_length"), _prefix().alias("_prefix")))
    same_length = _marked(rows, _repeated(rows, "_length"), "_length").where("_shared")
    return _repeated(same_length, "_length", "_prefix")


def _judged(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns, ``_length``, ``_prefix`` and ``_shared`` of each document, in one scan."""
    rows = docs.select(*columns, _length().alias("_length"), _prefix().alias("_prefix"))
    return _marked(rows, _survivors(docs), "_length", "_prefix")


def exact_copies(docs: DataFrame, digests: bool = False) -> DataFrame:
    """One row per document row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Documents whose texts are identical, nothing being changed, are a group; a null text
    is an empty one. Of each group the row with the largest ``doc_id`` stays (null ids are
    the smallest); of rows that share that id as well, one. ``keep_id`` is its id, null in
    a group of null ids only. ``text_sha256`` is given where the whole text was read, or
    with ``digests`` for every row. Other columns are left aside.
    """
    rows = _judged(docs, F.col("doc_id"), _text().alias("_text"))
    read = F.when(F.col("_shared") | F.lit(digests), F.unhex(F.sha2("_text", 256)))
    rows = rows.select("doc_id", "_length", "_shared", read.alias("_digest"))
    # Numbers of rows hold once they are written.
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    key = F.when(F.col("_shared"), F.col("_digest"))
    rows = stored(rows.select("doc_id", "_length", "_row", "_digest", key.alias("_key")))
    order = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "_row")
    groups = rows.where(F.col("_key").isNotNull()).groupBy("_key", "_length")
    groups = groups.agg(F.count(F.lit(1)).alias("_n"), F.max(order).alias("_last")).where(F.col("_n") > 1)
    groups = stored(groups.select("_key", "_length", "_n", "_last"))
    found = join_dimension(rows, groups, ["_key", "_length"], "left")
    alone = F.col("_n").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_last.doc_id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("_row") == F.col("_last._row"))).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of identical texts, with the columns it came with.

    The one that :func:`exact_copies` keeps; among rows that share its id the one with the
    greatest hash of all columns, and of rows alike in all columns one. Texts that share
    neither length and prefix with another are passed on by the scan; the others are moved once.
    """
    whole = [F.xxhash64(F.lit(salt), *docs.columns).alias(f"_row_{salt}") for salt in "ab"]
    rows = _judged(docs, F.struct(*docs.columns).alias("_doc"), *whole)
    digest = F.unhex(F.sha2(F.coalesce("_doc.text", F.lit("")), 256))
    id_ = F.col("_doc.doc_id")
    order = F.struct(id_.isNotNull().alias("named"), id_.alias("doc_id"), "_row_a", "_row_b")
    shared = rows.where("_shared")
    groups = shared.select("_length", digest.alias("_digest"), order.alias("_order")).groupBy("_length", "_digest")
    kept = durable(groups.agg(F.max("_order").alias("_last")).select("_last._row_a", "_last._row_b"))
    same = shared.select("_doc", "_row_a", "_row_b").join(kept, ["_row_a", "_row_b"], "left_semi")
    one = same.dropDuplicates(["_row_a", "_row_b"])
    return rows.where(~F.col("_shared")).select("_doc.*").unionByName(one.select("_doc.*"))

"""Numbering, top-k per group and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.session import stored

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below this bit

CUT_BY_SPARK = 1_000
"""Up to this rank Spark cuts groups inside each task by itself."""


def number_rows(df: DataFrame, *order: Column | str, index: str = "row_index") -> DataFrame:
    """Number all rows from 0 in a total order, without one task seeing them all.

    Sort by range, note each row's place in its sorted partition, write that
    as a table so the places can never change, then add the sizes of the partitions
    before. Only the partition sizes, one row each, are ever brought together.
    """
    placed = stored(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.select(
        *df.columns,
        F.shiftright("_place", _ROW_BITS).alias("_part"),
        F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
    )
    numbered = placed.join(F.broadcast(starts), "_part")
    return numbered.select(*df.columns, (F.col("_start") + F.col("_row")).alias(index))


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group, ranked from 1.

    Each group is cut to ``k`` rows before its exchange. Up to a rank of 1,000 Spark does
    so inside every task, and a hot group reaches its task as at most ``k`` rows per input
    task. Beyond, the rows of each input task are ranked apart first.
    """
    columns = df.columns
    if k > CUT_BY_SPARK:
        parts = df.withColumn("_part", F.spark_partition_id())
        apart = Window.partitionBy(*group, "_part").orderBy(*order)
        df = parts.withColumn("_ahead", F.row_number().over(apart)).where(F.col("_ahead") <= k).select(*columns)
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def after(
    df: DataFrame, place: Sequence[object], *columns: str, descending: Sequence[str] = (), size: int = 50
) -> DataFrame:
    """The ``size`` rows that follow ``place``, the values of ``columns`` in the last row seen.

    A page deep in a long list costs no more than the first one: rows before it are
    filtered in the scan, and no task keeps more than ``size``. Columns run upwards, or
    down if named in ``descending``; NULLs come last, and the last column is never NULL.
    """
    follows, same = F.lit(False), F.lit(True)
    for name, value in zip(columns, place, strict=True):
        column = F.col(name)
        if value is None:
            beyond, equal = F.lit(False), column.isNull()
        else:
            further = column < F.lit(value) if name in descending else column > F.lit(value)
            beyond, equal = further | column.isNull(), column == F.lit(value)
        follows, same = follows | (same & beyond), same & equal
    order = [F.desc_nulls_last(c) if c in descending else F.asc_nulls_last(c) for c in columns]
    return df.where(F.coalesce(follows, F.lit(False))).orderBy(*order).limit(size)


def page(df: DataFrame, *order: Column | str, number: int = 1, size: int = 50) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows in the given order."""
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)

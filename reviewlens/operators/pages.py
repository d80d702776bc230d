"""Numbered pages of a long list, read without what stands before them.

The list is sorted by range once and written, a folder for each sorted part, beside a table
of how many rows the parts have. A page is a range of places, so the counts say which
parts hold it, and only their folders are read, and of those only the blocks with its rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below this bit


@dataclass
class Pages:
    """A written list, and the columns of its rows."""

    spark: SparkSession
    path: str
    schema: StructType

    def _starts(self) -> DataFrame:
        counts = self.spark.read.parquet(f"{self.path}/counts")
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))

    def rows(self) -> int:
        return self.spark.read.parquet(f"{self.path}/counts").agg(F.sum("n")).first()[0] or 0

    def page(self, number: int, size: int = 50) -> DataFrame:
        """Page ``number`` (from 1) of ``size`` rows, in the order of the list.

        A page beyond the end is empty. The driver learns of the parts that hold the page,
        which are no more than the page has rows.
        """
        if number < 1 or size < 1:
            raise ValueError("page number and size start at 1")
        first, end = (number - 1) * size, number * size
        holds = (F.col("start") < end) & (F.col("start") + F.col("n") > first)
        parts = self._starts().where(holds).collect()
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        held = self.spark.read.parquet(f"{self.path}/rows")

        def of_page(part) -> Column:
            row = F.col("_row")
            return (F.col("_part") == part.part) & (row >= first - part.start) & (row < end - part.start)

        wanted = reduce(Column.__or__, map(of_page, parts), F.lit(False))
        few = held.where(wanted).coalesce(1).sortWithinPartitions("_part", "_row")
        return few.select(*self.schema.names)


def write_pages(df: DataFrame, path: str, *order: Column | str) -> Pages:
    """Write ``df`` in a total order as a list that is read by page.

    Rows are sorted by range, so no task sees all of them, and numbered within their part
    while they are written. An empty frame is a list without pages.
    """
    spark = df.sparkSession
    placed = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row")
    part = F.shiftright("_place", _ROW_BITS).cast("int").alias("_part")
    placed = placed.select(*df.columns, row, part)
    placed.write.partitionBy("_part").parquet(f"{path}/rows")
    kept = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    counts = kept.groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    counts.coalesce(1).write.parquet(f"{path}/counts")
    return Pages(spark, path, df.schema)

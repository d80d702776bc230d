"""How data is laid out: partitioning of scans, bounded lookups, skew-proof joins.

Nothing here broadcasts or collects without counting first, and every bounded
path has an exact unbounded one next to it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from reviewlens.session import durable, stored

INLINE_ROWS = 10_000
"""Lookups up to this many rows become literals of the plan."""

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 64 << 20
"""Tables up to this many rows and bytes may be broadcast."""


def _wanted_partitions(df: DataFrame) -> int:
    return 2 * df.sparkSession.sparkContext.defaultParallelism


def cluster_by(df: DataFrame, *keys: str, at_least: int = 1) -> DataFrame:
    """Hash-partition a scanned table once by its document key.

    Every later window, grouping and join on the key (or on the key and more)
    then runs without another exchange. Skip it for tables bucketed by the key.
    ``spark.sql.shuffle.partitions`` is the cluster's measure of how many parts, of which
    ``at_least`` asks for more.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, _wanted_partitions(df), at_least), *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Leave a scan alone unless it has too few splits to keep the cores busy."""
    want = _wanted_partitions(df)
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want, *keys)


def bounded_rows(df: DataFrame, limit: int = INLINE_ROWS) -> list[Row] | None:
    """All rows of ``df`` if there are at most ``limit``, otherwise ``None``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def _weight(df: DataFrame) -> Column:
    """Bytes of a row: texts and binaries by length, nested values by their JSON."""
    width = F.lit(0)
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = F.octet_length(name)
        elif kind.startswith(("array", "map", "struct", "vector", "matrix", "variant")):
            size = 2 * F.octet_length(F.to_json(F.struct(name)))
        else:
            size = F.lit(0)
        width = width + 16 + F.coalesce(size, F.lit(0))
    return width.cast("bigint")


def fits_broadcast(df: DataFrame) -> bool:
    """Whether ``df`` is counted and weighed to be small enough for every executor.

    No more rows are weighed than it takes to know.
    """
    widths = df.limit(BROADCAST_ROWS + 1).select(_weight(df).alias("width"))
    rows, size = widths.agg(F.count("width"), F.coalesce(F.sum("width"), F.lit(0))).head()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def inline_terms(terms: DataFrame | Iterable[str]) -> list[str] | None:
    """The terms as a list if few enough for a literal, otherwise ``None``."""
    if isinstance(terms, DataFrame):
        rows = bounded_rows(terms.select(terms.columns[0]).distinct())
        return None if rows is None else sorted(r[0] for r in rows if r[0] is not None)
    values = sorted(set(terms))
    return values if len(values) <= INLINE_ROWS else None


def term_frame(spark: SparkSession, terms: DataFrame | Iterable[str], name: str) -> DataFrame:
    """The terms as a distinct one-column frame called ``name``."""
    if isinstance(terms, DataFrame):
        return terms.select(F.col(terms.columns[0]).alias(name)).distinct()
    return spark.createDataFrame([(t,) for t in sorted(set(terms))], f"{name} string")


def _key_counts(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows each key has. The facts are read once; the counts are kept."""
    return stored(facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")))


def _hot(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    spark = counts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = _rows_of(counts)
    hot = counts.where(F.col("_rows") > total / tasks).select(*keys)
    return spark.createDataFrame(hot.collect(), hot.schema)


def hot_keys(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than an even task's share of the rows: fewer than there are tasks.

    The facts are read once; their counts are added up from what that wrote.
    """
    return _hot(_key_counts(facts, keys), keys)


def _frequent(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The most frequent keys, at most ``BROADCAST_ROWS``, and their rows; equal counts in order of the keys."""
    return stored(counts.orderBy(F.desc("_rows"), *keys).limit(BROADCAST_ROWS).select(*keys, "_rows"))


def _rows_of(counts: DataFrame) -> int:
    return counts.agg(F.sum("_rows")).head()[0] or 0


def join_dimension(
    facts: DataFrame, dimension: DataFrame, keys: str | Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join facts to a dimension with unique keys when one key may hold much of the facts.

    A dimension checked to be small is broadcast. Otherwise the rows of each key are
    counted, in one pass over the facts, and the dimension is written once. Where the most
    frequent keys have half of the facts or more, these meet a broadcast of just those keys'
    rows of the dimension, and only the others are exchanged. Otherwise, or where these rows
    are too wide, the facts are read once to join: those of a hot key are spread over as many
    parts as there are tasks, and its row of the dimension is repeated for each part.
    Facts with a NULL key, which match nothing, are spread too.
    ``how``: inner, left, left_semi or left_anti.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    dimension = durable(dimension)
    if fits_broadcast(dimension):
        return facts.join(F.broadcast(dimension), keys, how)
    counts = _key_counts(facts, keys)
    most = _frequent(counts, keys)
    if 2 * _rows_of(most) < _rows_of(counts):
        return _spread_join(facts, dimension, keys, how, _hot(counts, keys))
    frequent = most.select(*keys)
    head = stored(dimension.join(F.broadcast(frequent), keys, "left_semi"))
    if fits_broadcast(head) and fits_broadcast(frequent):
        known = F.broadcast(frequent.withColumn("_near", F.lit(True)))
        marked = facts.join(known, keys, "left")
        is_near = F.col("_near").isNotNull()
        missing = reduce(or_, (F.col(key).isNull() for key in keys))
        near = marked.where(is_near | missing).drop("_near").join(F.broadcast(head), keys, how)
        far = marked.where(~is_near & ~missing).drop("_near").join(dimension, keys, how)
        return near.unionByName(far)
    return _spread_join(facts, dimension, keys, how, _hot(counts, keys))


def _spread_join(facts: DataFrame, dimension: DataFrame, keys: list[str], how: str, hot: DataFrame) -> DataFrame:
    spread_over = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot.withColumn("_hot", F.lit(True))
    is_hot = F.coalesce("_hot", F.lit(False))
    for key in keys:
        is_hot = is_hot | F.col(key).isNull()
    part = F.pmod(F.monotonically_increasing_id(), F.lit(spread_over))
    first, last = F.lit(0).cast("bigint"), F.lit(spread_over - 1).cast("bigint")
    placed = facts.join(F.broadcast(hot), keys, "left")
    placed = placed.withColumn("_part", F.when(is_hot, part).otherwise(first)).drop("_hot")
    each = F.when(F.col("_hot"), F.sequence(first, last)).otherwise(F.array(first))
    repeated = dimension.join(F.broadcast(hot), keys, "left")
    repeated = repeated.withColumn("_part", F.explode(each)).drop("_hot")
    return placed.join(repeated, [*keys, "_part"], how).drop("_part")

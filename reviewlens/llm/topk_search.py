"""Exact top-k search by inner product with a ball tree for each shard.

Vectors are dealt to shards by a hash of their id. Each shard builds a ball tree; a ball
bounds the inner product of all it holds by that of its centre plus its radius times the
length of the query. A query descends into the ball with the highest bound first and
leaves out every ball whose bound is below its current k-th score.

That score is shared between shards: each query is first answered by one home shard, and
goes to the others with the k-th score found there, so that they start out with it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.session import durable

SHARD_ROWS = 20_000
LEAST_SHARDS = 32
LEAF = 128
EXACT = float(1 << 53)
"""Rows of a shard on average, shards at least, rows of a leaf, and what a double holds exactly."""

LONG = (1 << 63) - 1
FOUND = "query_id bigint, vec_id bigint, score bigint"


def whole_parts(embedding: Column) -> Column:
    """Each component ``x`` as ``floor(1024 * x)``."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * 1024))


def usable(embedding: Column) -> Column:
    """Neither null nor with a component that is null or not a finite number."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False))


class BallTree:
    """Rows in the order of the tree; a node is a range of them with a centre and a radius.

    A node is split at the median along the line between two far rows. Rows that are all
    alike have radius 0 and are split by place, so depth stays the logarithm of the rows.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        real = rows.astype(float)
        self.nodes: list[tuple[int, int, int, int]] = []
        centres, radii = [], []

        def build(begin: int, end: int) -> int:
            here = order[begin:end]
            points = real[here]
            centre = points.mean(0)
            away = np.sqrt(((points - centre) ** 2).sum(1))
            place = len(self.nodes)
            self.nodes.append((begin, end, -1, -1))
            centres.append(centre)
            radii.append(float(away.max()))
            if end - begin > leaf:
                far = points[away.argmax()]
                other = points[((points - far) ** 2).sum(1).argmax()]
                side = np.argsort(points @ (other - far), kind="stable")
                order[begin:end] = here[side]
                middle = (begin + end) // 2
                self.nodes[place] = (begin, end, build(begin, middle), build(middle, end))
            return place

        if len(ids):
            build(0, len(ids))
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.ids, self.rows, self.real = ids[order], rows[order], real[order]
        self.lengths = np.sqrt((self.real**2).sum(1)).max() if len(ids) else 0.0

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The best ``(score, id)`` of ``k`` other ids, each with its best row, as far as they reach ``floor``.

        Equal scores go to the smaller id. Balls whose bound equals the k-th score are
        read, since they may hold such a tie.
        """
        if not len(self.ids):
            return []
        real = query.astype(float)
        length = float(np.sqrt((real**2).sum()))
        slack = 1e-9 * (1.0 + length * float(self.lengths))  # what rounding can take from a bound
        bounds = np.clip(self.centres @ real + self.radii * length + slack, -float(LONG), float(LONG))
        best: list[tuple[int, int]] = []  # a heap of (score, -id), each id once
        held: dict[int, int] = {}  # the score of each id in the heap
        queue = [(-bounds[0], 0)]
        least = floor
        while queue:
            bound, node = heapq.heappop(queue)
            if least is not None and -bound < least:
                break
            begin, end, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if least is None or bounds[child] >= least:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            scores = self._scores(query, real, begin, end, length)
            names = self.ids[begin:end]
            keep = names != own
            if least is not None:
                keep &= scores >= least
            for at in np.flatnonzero(keep):
                name = int(names[at])
                entry = (int(scores[at]), -name)
                if name in held:
                    if entry[0] > held[name]:
                        best[best.index((held[name], -name))] = entry
                        heapq.heapify(best)
                        held[name] = entry[0]
                elif len(best) < k:
                    heapq.heappush(best, entry)
                    held[name] = entry[0]
                elif entry > best[0]:
                    del held[-heapq.heapreplace(best, entry)[1]]
                    held[name] = entry[0]
            if len(best) == k:
                least = best[0][0] if least is None else max(least, best[0][0])
        return [(score, -name) for score, name in sorted(best, reverse=True)]

    def _scores(self, query: np.ndarray, real: np.ndarray, begin: int, end: int, length: float) -> np.ndarray:
        """Exact inner products: in doubles where every partial sum is exact, else in whole numbers."""
        if length * float(self.lengths) * len(query) < EXACT:
            return self.real[begin:end] @ real
        return np.clip(self.rows[begin:end].astype(object) @ query.astype(object), -LONG - 1, LONG)


def _searched(k: int):
    """A task reads its shards one after the other: first a shard's rows, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, rows, tree = None, [], [], None
        for batch in batches:
            names, kinds = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            keys, floors = batch.column(2).to_numpy(zero_copy_only=False), batch.column(4).to_pylist()
            vectors = batch.column(3)
            out: list[tuple[int, int, int]] = []
            for at, name in enumerate(names):
                if name != shard:
                    shard, ids, rows, tree = name, [], [], None
                vector = vectors[at].values.to_numpy(zero_copy_only=False)
                if kinds[at] == 0:
                    ids.append(keys[at])
                    rows.append(vector)
                    continue
                if tree is None:
                    width = len(vector)
                    tree = BallTree(np.array(ids, np.int64), np.array(rows, np.int64).reshape(len(ids), width))
                    ids, rows = [], []
                own = int(keys[at])
                out += [(own, vec_id, score) for score, vec_id in tree.search(vector, own, k, floors[at])]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, pa.int64()) for column in columns], names=["query_id", "vec_id", "score"]
            )

    return run


def _in_shards(rows: DataFrame, queries: DataFrame, shards: int, k: int) -> DataFrame:
    """The best of each query in each shard it is sent to; ``queries`` has ``shard`` and ``floor``.

    A shard's rows are held by its task, its queries pass through in batches.
    """
    kinds = ["shard", "kind", "id", "vector", "floor"]
    # A vector meets those of its own length; the shard of its name says which.
    name = F.concat_ws(":", F.size("vector"), "shard")
    shard, row, query = name.alias("shard"), F.lit(0).alias("kind"), F.lit(1).alias("kind")
    no_floor = F.lit(None).cast("long").alias("floor")
    held = rows.select(shard, row, F.col("vec_id").alias("id"), "vector", no_floor)
    asked = queries.select(shard, query, F.col("query_id").alias("id"), "vector", "floor")
    laid = held.unionByName(asked).select(*kinds).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "id")
    return laid.mapInArrow(_searched(k), FOUND)


def top_k(
    vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` best rows for each query.

    ``vectors`` has ``vec_id`` and ``embedding``; ``queries`` is a part of them, by default
    the rows whose id is divisible by 100. Rows are compared as whole numbers, see
    :func:`whole_parts`. Rows with a null id or an unusable vector take no part; rows alike
    in id and vector are one row, and an id with several vectors counts with the best of
    them; a query is not compared with rows of its own id, nor with vectors of another
    length. Queries with fewer candidates have fewer rows, those
    with none have none. Scores beyond a long count as the nearest long.
    """

    def clean(frame: DataFrame) -> DataFrame:
        kept = frame.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        vector = whole_parts(F.col("embedding")).alias("vector")
        return kept.select(F.col("vec_id").cast("long").alias("vec_id"), vector)

    if queries is None:
        queries = vectors.where(F.col("vec_id") % 100 == 0)
    rows = clean(vectors).distinct()
    asked = clean(queries).distinct().withColumnRenamed("vec_id", "query_id")
    shards = max(LEAST_SHARDS, -(-vectors.count() // shard_rows))

    def shard_of(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(shards)).cast("int")

    rows = durable(rows.withColumn("shard", shard_of("vec_id")))
    asked = asked.withColumn("home", shard_of("query_id"))
    at_home = asked.withColumn("shard", F.col("home")).withColumn("floor", F.lit(None).cast("long"))
    first = durable(_in_shards(rows, at_home, shards, k))
    # The k-th score of the home shard bounds that of all shards from below.
    reached = first.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n"), F.min("score").alias("least"))
    reached = reached.select("query_id", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    elsewhere = asked.join(reached, "query_id", "left").withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    rest = _in_shards(rows, elsewhere.where(F.col("shard") != F.col("home")), shards, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = first.unionByName(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

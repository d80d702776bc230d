"""Ranked lexical search, term at a time, with a limit on accumulators that loses nothing.

The texts are read once: each document's counts of the terms that items ask for, and its
number of terms, are written as an index, and the statistics are sums over it. The index
is read in blocks of documents, and a block's postings are laid out by term.

An item's terms go rarest first. A document gets an accumulator when one of its terms
comes by, until the most that the terms to come can add, by the highest addition of each in
the block, is less than the k-th partial score: whatever has no accumulator then cannot be
among the ``k`` best. From there on the rest of the postings only adds to accumulators that
are there, so their scores are exact. The k-th score of earlier blocks of the task counts as a
partial score, so later blocks stop sooner.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.columns import ascii_lower, pieces
from reviewlens.session import durable

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PLAIN = bytes(c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256)).lower()
"""What each byte of a text becomes: separators a blank, A-Z in lower case."""

BLOCK_POSTINGS = 2_000_000
BLOCK_DOCUMENTS = 65_536
TASK_POSTINGS = 20_000_000
"""Postings and documents of a block, and postings of a task, on average."""

ITEM_BYTES = 16 << 20
"""Items are sent to tasks in parts of this size; the index is made and read once for each."""

MERGE_PARTS = 64
LONG = (1 << 63) - 1


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _counted(known: dict[bytes, int]):
    """For each document its number of terms, and which known terms it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, times = [], [], []
            for value in batch.column(1):
                words = (value.as_py() or "").encode().translate(PLAIN).split()
                held = [(known[word], n) for word, n in Counter(words).items() if word in known]
                sizes.append(len(words))
                terms.append([term for term, _ in held])
                times.append([n for _, n in held])
            columns = [pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))]
            names = ["doc_id", "size", "terms", "times"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return run


class Block:
    """The postings of some documents, by term."""

    def __init__(self, sizes: np.ndarray, docs: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, n_docs: int, total: int):
        if 90 * int(sizes.max(initial=0)) * n_docs <= LONG:
            share = (90 * n_docs * sizes) // total
        else:
            share = np.array([90 * int(size) * n_docs // total for size in sizes], np.int64)
        times = times.astype(np.int64)
        gain = (1_000_000_000 * times) // (1000 * times + 8 * (10 + share[docs])) * weights[terms]
        order = np.argsort(terms, kind="stable")
        self.docs, self.gains, self.n = docs[order], gain[order], len(sizes)
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.bounds = np.zeros(len(weights), np.int64)
        held = np.flatnonzero(np.diff(self.starts))
        if len(held):
            self.bounds[held] = np.maximum.reduceat(self.gains, self.starts[held])

    def best(self, terms: list[int], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """``docs``, ``scores`` of at least those among the ``k`` best that score ``floor`` or more.

        ``terms`` come rarest first. Ties of the k-th score are all given.
        """
        sums = np.zeros(self.n, np.int64)
        made = np.zeros(self.n, bool)
        left = np.cumsum(self.bounds[terms][::-1])[::-1]  # what a term and all after it can add
        open_, top = True, np.zeros(0, np.int64)
        for place, term in enumerate(terms):
            some = slice(self.starts[term], self.starts[term + 1])
            docs, gains = self.docs[some], self.gains[some]
            if open_ and left[place] < floor:
                open_ = False
            if not open_:
                known = made[docs]
                sums[docs[known]] += gains[known]
                continue
            sums[docs] += gains
            made[docs] = True
            # Only what has just been added to can have come among the best.
            near = np.union1d(top, docs)
            if len(near) > k:
                near = near[np.argpartition(sums[near], len(near) - k)[-k:]]
            top = near
            if len(top) == k:
                floor = max(floor, int(sums[top].min()))
        found = np.flatnonzero(made & (sums >= max(floor, 1)))
        if len(found) > k:
            least = np.partition(sums[found], len(found) - k)[-k]
            found = found[sums[found] >= least]
        return found, sums[found]


def _searched(items: list[list[int]], weights: np.ndarray, n_docs: int, total: int, k: int):
    """A task's best documents for each item, block after block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]  # (-score, id is null, id)
        held: list[tuple] = []

        def flush() -> None:
            ids = [doc_id for part in held for doc_id in part[0]]
            sizes, counts, terms, times = (np.concatenate([part[at] for part in held]) for at in range(1, 5))
            docs = np.repeat(np.arange(len(sizes)), counts)
            block = Block(sizes, docs, terms, times, weights, n_docs, total)
            for at, wanted in enumerate(items):
                own = best[at]
                places, scores = block.best(wanted, k, -own[-1][0] if len(own) == k else 0)
                for place, score in zip(places.tolist(), scores.tolist(), strict=True):
                    own.append((-score, ids[place] is None, ids[place] or 0))
                own.sort()
                del own[k:]
            held.clear()

        for batch in batches:
            at = 0
            counts = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            ends = np.cumsum(counts)
            while at < batch.num_rows:
                # Postings go by blocks as well as documents do; one document is never split.
                full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_POSTINGS, "right"))
                upto = min(batch.num_rows, max(at + 1, min(full, at + BLOCK_DOCUMENTS)))
                part = batch.slice(at, upto - at)
                held.append(
                    (
                        part.column(0).to_pylist(),
                        part.column(1).to_numpy(),
                        counts[at:upto],
                        part.column(2).flatten().to_numpy(),
                        part.column(3).flatten().to_numpy(),
                    )
                )
                at = upto
                if sum(len(h[0]) for h in held) >= BLOCK_DOCUMENTS or sum(len(h[3]) for h in held) >= BLOCK_POSTINGS:
                    flush()
        if held:
            flush()
        rows = [(item, None if none else doc_id, -score) for item, own in enumerate(best) for score, none, doc_id in own]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["at", "doc_id", "score"])

    return run


def _asked(items: DataFrame) -> DataFrame:
    """``item_id``, ``words``: the distinct terms of each distinct item that has any."""
    words = F.array_sort(F.array_distinct(pieces(ascii_lower(F.col("text")), SEPARATOR)))
    return items.select("item_id", words.alias("words")).where(F.size("words") > 0).distinct()


def _ranked_part(docs: DataFrame, rows: list, kind: str, k: int) -> DataFrame:
    """The ``k`` best of all documents for the items in ``rows``, which are on the driver."""
    spark = docs.sparkSession
    names = sorted({word for row in rows for word in row.words})
    known = {name.encode(): at for at, name in enumerate(names)}
    index = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _counted(known), "doc_id bigint, size bigint, terms array<int>, times array<int>"
    )
    index = durable(index.where("size > 0"))
    n_docs, total, postings = index.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))
    ).first()
    counts = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = dict.fromkeys(range(len(names)), 0) | {row.term: row.df for row in counts.collect()}
    weights = np.array([weight(n_docs, df[term]) for term in range(len(names))], np.int64)
    # A term that no document holds has nothing to add; names are in order, so ties go by term.
    wanted = [sorted((known[w.encode()] for w in row.words if df[known[w.encode()]]), key=lambda t: (df[t], t)) for row in rows]
    tasks = max(spark.sparkContext.defaultParallelism, -(-postings // TASK_POSTINGS))
    found = index.coalesce(tasks).mapInArrow(
        _searched(wanted, weights, n_docs, total, k), "at bigint, doc_id bigint, score bigint"
    )
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]

    def first(frame: DataFrame, *by: str) -> DataFrame:
        ranked = frame.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        return ranked.where(F.col("rank") <= k)

    parted = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)))
    merged = first(first(parted, "at", "part").drop("rank"), "at")
    asked = spark.createDataFrame([(at, row.item_id) for at, row in enumerate(rows)], f"at bigint, item_id {kind}")
    return merged.join(F.broadcast(asked), "at").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best documents for each item.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lowered. With
    ``N`` documents that have a term, ``L`` terms in all, ``n`` in a document, ``df`` documents
    that hold a term and ``tf`` times it stands in one, an item's score of a document is the
    sum over its distinct terms of ``w * (10^9 tf div (1000 tf + 8 m))``, in whole numbers,
    where ``w`` is ``floor(1000 ln((2N + 2) / (2 df + 1)))`` and ``m`` is
    ``10 + 90 n N div L``. Only scores above 0 count. Equal scores go to the smaller
    ``doc_id``, null last; ranks go from 1. Each row of ``docs`` is a document, also where
    rows repeat; ids are whole numbers. Null and empty texts have no terms and are found by nothing;
    items without terms find nothing. Items alike in id and terms are one, others that
    share an id are ranked each for itself. All documents are read for each part of the
    items; a part is at most ``ITEM_BYTES``, so what is sent to tasks does not grow.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    asked = durable(_asked(items))
    size = F.octet_length(F.concat_ws(" ", "words")) + 64 * F.size("words") + 64
    parts = max(1, -(-(asked.agg(F.sum(size)).first()[0] or 0) // ITEM_BYTES))
    part = F.pmod(F.xxhash64("item_id", "words"), F.lit(parts))
    found = [
        _ranked_part(docs, sorted(asked.where(part == at).collect(), key=lambda row: row.words), kind, k)
        for at in range(parts)
    ]
    return reduce(DataFrame.unionByName, found)

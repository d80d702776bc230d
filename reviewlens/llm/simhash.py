"""SimHash near-duplicates with candidates pruned by chains of segments on a ring.

A fingerprint's 64 bits are cut into seven segments that form a ring. If two fingerprints
differ in at most two bits, then from some segment on every chain of ``l`` consecutive
segments holds at most ``2 l / 7`` differences: none in the first three, one in up to six.
So candidates agree in three consecutive segments, and a chain that overruns its budget on
the way is dropped before all bits are compared.

Work is on distinct fingerprints, so exact copies meet as one. A bucket of fingerprints
yields the edges of a spanning forest, never its pairs, and components of the forest are
found by stars that contract. A crowded bucket is split by a second ring over the bits that
its chain leaves free; what agrees in both has 22 free bits, so no bucket in a task holds
more than 2^22 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.session import durable

SHINGLE = 3
SEED = 42
BITS = 64
DISTANCE = 2
SEGMENTS = 7
CHUNK = 1 << 16
"""Shingles whose bits are counted at a time."""

PROBE = 4_096
CROWDED = 1 << 16
"""In a bucket of more fingerprints neighbours are looked up instead of compared; one of
still more is split by a second ring."""

BROADCAST_ROWS = 100_000
"""So many crowded buckets are broadcast, at 30 bytes each; more are joined by exchange."""


def segments(count: int = SEGMENTS) -> list[tuple[int, int]]:
    """``(shift, width)`` of each segment; the widths differ by one at most."""
    edges = [BITS * at // count for at in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def free_chain(distance: int = DISTANCE, count: int = SEGMENTS) -> int:
    """How many segments from a good start on must be equal."""
    return (count - 1) // distance if distance else count


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as an unsigned number; without words it is zero."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    counts = np.zeros(BITS, np.int64)
    for begin in range(0, n, CHUNK):
        end = min(begin + CHUNK, n)
        pairs = zip(starts[begin:end].tolist(), ends[begin + width - 1 : end + width - 1].tolist(), strict=True)
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in pairs), np.uint64, end - begin)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return sum(1 << bit for bit in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame, *extra: Column) -> DataFrame:
    """``doc_id``, the extra columns, and ``fp``: the fingerprint as a signed long."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py()) for text in batch.column("text")]
            signed = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            kept = [at for at, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(at) for at in kept), signed], names=[*(batch.schema.names[at] for at in kept), "fp"]
            )

    needed = docs.select("doc_id", *extra, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in needed.schema if f.name != "text")
    return needed.mapInArrow(computed, f"{fields}, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _mask(start: int, length: int) -> int:
    """The bits of ``length`` segments from ``start`` on around the ring."""
    ring = segments()
    mask = 0
    for at in range(start, start + length):
        shift, width = ring[at % SEGMENTS]
        mask |= ((1 << width) - 1) << shift
    return mask


def _second_masks(start: int) -> list[int]:
    """The chains of a ring over the bits that the chain from ``start`` leaves free."""
    chain = _mask(start, free_chain())
    free = [bit for bit in range(BITS) if not chain >> bit & 1]
    edges = [len(free) * at // SEGMENTS for at in range(SEGMENTS + 1)]
    parts = [sum(1 << bit for bit in free[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(parts[(at + step) % SEGMENTS] for step in range(free_chain())) for at in range(SEGMENTS)]


def _forest(values: np.ndarray, start: int) -> Iterator[tuple[int, int]]:
    """Edges that connect what is linked in a bucket whose chain begins at ``start``."""
    if len(values) > PROBE:
        yield from _probed(values, start)
        return
    ring, fixed = segments(), free_chain()
    chain = []  # bits of the chain up to here, and what they may differ by
    for length in range(fixed + 1, SEGMENTS):
        chain.append((np.uint64(_mask(start + fixed, length - fixed)), DISTANCE * length // len(ring)))
    left = values
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            here = queue.pop()
            different = left ^ here
            alive = np.arange(len(left))
            for bits, budget in chain:
                alive = alive[np.bitwise_count(different[alive] & bits) <= budget]
            alive = alive[np.bitwise_count(different[alive]) <= DISTANCE]
            # A pair that overruns this chain is within budget in the chain of another start.
            found = left[alive]
            for other in found:
                yield int(here), int(other)
            queue.extend(found)
            left = np.delete(left, alive)


def _probed(values: np.ndarray, start: int) -> Iterator[tuple[int, int]]:
    """The same for a large bucket: each fingerprint looks up what one or two flips make of it."""
    values = np.sort(values)
    chain = _mask(start, free_chain())
    free = [1 << bit for bit in range(BITS) if not chain >> bit & 1]
    flips = [*free, *(a | b for at, a in enumerate(free) for b in free[at + 1 :])]
    parent = np.arange(len(values))

    def root(at: int) -> int:
        while parent[at] != at:
            parent[at] = at = parent[parent[at]]
        return at

    for flip in flips:
        wanted = values ^ np.uint64(flip)
        place = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
        for a in np.flatnonzero((values[place] == wanted) & (values < wanted)):
            one, other = root(int(a)), root(int(place[a]))
            if one != other:
                parent[other] = one
                yield int(values[a]), int(values[place[a]])


def _buckets(distinct: DataFrame) -> DataFrame:
    """``start``, ``fps``: fingerprints that agree in the chain from ``start``, two at least.

    Buckets of more than ``CROWDED`` are split so that what is linked still meets in one.
    """

    def chain(start: int) -> Column:
        agreed = F.col("fp").bitwiseAND(F.lit(_signed(_mask(start, free_chain()))))
        return F.struct(F.lit(start).alias("start"), agreed.alias("chain"))

    keyed = distinct.select("fp", F.inline(F.array(*map(chain, range(SEGMENTS)))))
    sizes = keyed.groupBy("start", "chain").agg(F.count(F.lit(1)).alias("n"))
    crowded = durable(sizes.where(F.col("n") > CROWDED).select("start", "chain", F.lit(True).alias("crowded")))
    n_crowded = crowded.count()
    by = ["start", "chain"]
    if n_crowded:
        masks = F.array(
            *(F.array(*(F.lit(_signed(mask)) for mask in _second_masks(start))) for start in range(SEGMENTS))
        )

        def second(mask: Column, at: Column) -> Column:
            return F.struct(at.alias("second"), F.col("fp").bitwiseAND(mask).alias("part"))

        split = F.transform(F.get(masks, F.col("start")), second)
        whole = F.array(F.struct(F.lit(-1).alias("second"), F.lit(0).cast("long").alias("part")))
        few = F.broadcast(crowded) if n_crowded <= BROADCAST_ROWS else crowded
        marked = keyed.join(few, by, "left")
        keyed = marked.select(*by, "fp", F.inline(F.when(F.col("crowded"), split).otherwise(whole)))
        by = [*by, "second", "part"]
    buckets = keyed.groupBy(*by).agg(F.collect_list("fp").alias("fps"))
    return buckets.where(F.size("fps") > 1).select("start", "fps")


def links(distinct: DataFrame) -> DataFrame:
    """``a``, ``b``: enough links between distinct fingerprints ``fp`` to connect all that are linked."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for start, fps in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = fps.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                found += _forest(values, start)
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return _buckets(distinct).mapInArrow(linked, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of the edges ``a``, ``b``; the root is the smallest node.

    Large and small stars take turns until nothing changes. A node's smallest neighbour is
    found by a sum within tasks first, so a star of any size is no group in one task.
    """

    def smaller_first(frame: DataFrame) -> DataFrame:
        low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        return frame.where(F.col("a") != F.col("b")).select(low, high).distinct()

    def with_least(pairs: DataFrame) -> DataFrame:
        """Pairs ``u``, ``v`` with ``m``, the smallest of ``u`` and what it is paired with."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(least, "u").withColumn("m", F.least("u", "m"))

    def round_of(frame: DataFrame) -> DataFrame:
        both = frame.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(frame.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = with_least(both).where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
        down = smaller_first(large).select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = with_least(down)
        ends = F.explode(F.array("u", "v")).alias("b")
        return smaller_first(small.select(F.col("m").alias("a"), ends))

    def state(frame: DataFrame) -> tuple:
        mark = F.xxhash64("a", "b").cast("decimal(38,0)")
        return tuple(frame.agg(F.count(F.lit(1)), F.sum(mark)).first())

    edges = durable(smaller_first(edges))
    seen = state(edges)
    while seen[0]:
        edges = durable(round_of(edges))
        now = state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _grouped(prints: DataFrame) -> DataFrame:
    """``fp``, ``root``: the component of each distinct fingerprint."""
    distinct = durable(prints.select("fp").distinct())
    found = components(links(distinct)).withColumnRenamed("node", "fp")
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document row: ``doc_id``, ``fingerprint`` (hex), ``component_id``.

    Documents are linked if their fingerprints differ in two bits or less, and
    ``component_id`` is the smallest id that links reach, the document's own included.
    A null, empty or blank text has fingerprint zero and is linked like any other. Null
    ids are left out of the smallest; a component of only null ids has a null id.
    """
    prints = durable(fingerprints(docs))
    groups = durable(_grouped(prints))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(groups, "fp")
    ids = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = groups.join(ids, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fp").select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns it came with.

    The smallest ``doc_id`` stays, null last; among rows that share it the one with the
    smallest hash of all columns, and of rows alike in all columns one.
    """
    row = [F.xxhash64(F.lit(salt), *docs.columns).alias(f"_row_{salt}") for salt in "ab"]
    prints = durable(fingerprints(docs, *row))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row_a", "_row_b")
    firsts = prints.groupBy("fp").agg(F.min(order).alias("first")).join(_grouped(prints), "fp")
    kept = firsts.groupBy("root").agg(F.min("first").alias("first")).select("first._row_a", "first._row_b")
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), *row)
    one = rows.join(kept, ["_row_a", "_row_b"], "left_semi").dropDuplicates(["_row_a", "_row_b"])
    return one.select("_doc.*")

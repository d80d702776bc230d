"""Benchmark decontamination: windows of benchmark words found in training texts.

The distinct windows of the benchmark are a hash set keyed by their first words.
Every position of every document is looked up in it, a hit is verified word by
word, and the hit positions of a document are merged into spans. All of it is
built-in expressions: one exchange of the hits, and one pass over the texts for each part
of the set that is small enough to broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.columns import ascii_lower, pieces

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
"""The same words before A-Z are lowered."""

WINDOW = 10
ANCHOR = 3
BLOCK = 64
"""Words are looked up in blocks of so many, each with the words that a window may add."""

BROADCAST_BYTES = 64 << 20
"""The window set is broadcast in parts of this size; the texts are read once for each."""


def normal_words(text: Column) -> Column:
    return pieces(ascii_lower(text), SEPARATOR)


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``window`` (words), ``item_ids``: each distinct window and the items that hold it.

    An item with fewer words than a window is one window; one without words has none.
    """
    words = items.select(F.col("item_id").cast("string").alias("item_id"), normal_words(F.col("text")).alias("words"))
    words = words.where((F.size("words") > 0) & F.col("item_id").isNotNull())
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))
    each = F.transform(starts, lambda start: F.slice("words", start, window))
    windows = words.select("item_id", F.explode(F.array_distinct(each)).alias("window"))
    return windows.groupBy("window").agg(F.collect_set("item_id").alias("item_ids"))


def _anchor(words: Column, first: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), first, *(F.get(words, at + step) for step in range(1, length)))


def _bytes(windows: DataFrame) -> tuple[int, list[int]]:
    """Bytes of the window set, and the lengths of its anchors."""
    size = F.octet_length(F.concat_ws(" ", "window")) + F.octet_length(F.concat_ws(" ", "item_ids"))
    size = size + 16 * (F.size("window") + F.size("item_ids")) + 64
    found = windows.agg(F.sum(size), F.collect_set(F.least(F.lit(ANCHOR), F.size("window")))).first()
    return found[0] or 0, sorted(found[1])


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: ``doc_id``, ``text_key``, ``n_words``, ``spans``, ``item_ids``.

    ``spans`` are the merged word ranges ``(first, end)`` that windows cover, from 0,
    end exclusive, in order; ``item_ids`` the items with an occurring window, sorted as
    strings. ``text_key`` tells apart rows that share a ``doc_id``; equal rows come
    back as often as they were. A null or empty text has no words and no spans; a null
    ``doc_id`` is a value like any other; items without id or words take no part; with
    no items nothing is hit.
    """
    windows = benchmark_windows(items, window)
    size, lengths = _bytes(windows)
    lengths = lengths or [ANCHOR]
    anchor = F.coalesce(
        *(
            F.when(
                F.least(F.lit(ANCHOR), F.size("window")) == length,
                _anchor(F.col("window"), F.get("window", F.lit(0)), F.lit(0), length),
            )
            for length in lengths
        )
    )
    parts = max(1, -(-size // BROADCAST_BYTES))
    keyed = windows.select(
        anchor.alias("anchor"), "window", "item_ids", F.pmod(F.xxhash64("window"), F.lit(parts)).alias("part")
    )
    words = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        normal_words(F.col("text")).alias("all_words"),
    )
    # A row of the look-up carries a block, never a text, so work is linear in a text.
    firsts = F.sequence(F.lit(0), F.greatest(F.size("all_words") - 1, F.lit(0)), F.lit(BLOCK))
    blocks = F.transform(
        firsts, lambda at: F.struct(at.alias("start"), F.slice("all_words", at + 1, BLOCK + window - 1).alias("words"))
    )
    words = words.select("doc_id", "text_key", F.size("all_words").alias("n"), F.inline(blocks))

    def anchors(length: int) -> Column:
        def entry(word: Column, at: Column) -> Column:
            return F.struct(at.alias("at"), _anchor(F.col("words"), word, at, length).alias("anchor"))

        return F.transform(F.slice("words", 1, BLOCK), entry)

    # The element without a place stands for the document itself, then come its positions,
    # once for each length of anchor.
    itself = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("bigint").alias("anchor")))
    none = F.filter(itself, lambda _: F.lit(False))
    lookup = F.concat(F.when(F.col("start") == 0, itself).otherwise(none), *(anchors(length) for length in lengths))
    places = words.select("doc_id", "text_key", "n", "start", "words", F.inline(lookup))
    is_document = F.col("at") < 0
    first = (F.col("start") + F.col("at")).cast("int")
    here = F.slice("words", F.greatest(F.col("at"), F.lit(0)) + 1, F.size("window"))
    is_hit = ~is_document & F.col("window").isNotNull() & (here == F.col("window"))

    def met_by(part: int) -> DataFrame:
        found = places.join(F.broadcast(keyed.where(F.col("part") == part)), "anchor", "left")
        return found.where((is_document | is_hit) if part == 0 else is_hit)

    met = reduce(DataFrame.unionByName, map(met_by, range(parts)))
    span = F.when(~is_document, F.struct(first.alias("first"), (first + F.size("window")).alias("end")))
    rows = met.select(
        "doc_id",
        "text_key",
        F.when(is_document, F.col("n")).cast("long").alias("n_words"),
        span.alias("span"),
        F.when(~is_document, F.col("item_ids")).alias("item_ids"),
    )
    grouped = rows.groupBy("doc_id", "text_key").agg(
        F.count("n_words").cast("int").alias("copies"),
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set("span")).alias("found"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    hit = grouped.select("doc_id", "text_key", "n_words", "item_ids", _covered("found").alias("hit"), again.alias("_"))
    return hit.select("doc_id", "text_key", "n_words", _runs("hit").alias("spans"), "item_ids")


def _covered(found: str) -> Column:
    """The positions that sorted ranges cover, ascending, each once.

    A range leaves what the next one covers as well to that one.
    """

    def own(span: Column, at: Column) -> Column:
        after = F.get(found, at + 1)
        end = F.when(after["end"] >= span["end"], F.least(after["first"], span["end"])).otherwise(span["end"])
        return F.when(end > span["first"], F.sequence(span["first"], end - 1)).otherwise(F.array().cast("array<int>"))

    return F.sort_array(F.array_distinct(F.flatten(F.transform(found, own))))


def _runs(hit: str) -> Column:
    """Ascending positions as ranges of neighbours."""
    firsts = F.filter(hit, lambda p, at: F.coalesce(F.get(hit, at - 1) < p - 1, F.lit(True)))
    lasts = F.filter(hit, lambda p, at: F.coalesce(F.get(hit, at + 1) > p + 1, F.lit(True)))
    return F.zip_with(
        firsts, lasts, lambda f, l: F.named_struct(F.lit("first"), f, F.lit("end"), l + 1)
    )


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["first"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, cut: str = "documents") -> DataFrame:
    """The documents without benchmark text, with the columns they came with.

    ``cut="documents"`` drops every row with a hit. ``cut="spans"`` keeps the rows and
    takes the hit words out of their text; what stood between words stays. Rows with a
    null or empty text are kept as they are.
    """
    if cut not in ("documents", "spans"):
        raise ValueError("cut is 'documents' or 'spans'")
    hits = benchmark_hits(docs, items, window).where(F.size("spans") > 0)
    hits = hits.select(
        F.col("doc_id").alias("_hit_id"), F.col("text_key").alias("_hit_key"), F.col("spans").alias("_hit_spans")
    ).dropDuplicates(["_hit_id", "_hit_key"])
    same = docs["doc_id"].eqNullSafe(hits["_hit_id"]) & (F.xxhash64(docs["text"]) == hits["_hit_key"])
    if cut == "documents":
        return docs.join(hits, same, "left_anti")
    joined = docs.join(hits, same, "left")
    held, left, words = _without(F.col("text"), F.col("_hit_spans"))
    parts = joined.select(
        F.struct(*(docs[name] for name in docs.columns)).alias("_doc"),
        "_hit_spans",
        held.alias("_held"),
        left.alias("_left"),
        words.alias("_words"),
    )
    old = F.col("_doc.text")
    text = F.when(F.col("_hit_spans").isNull(), old).otherwise(_woven("_held", "_left", "_words"))
    return parts.select(
        *(text.alias(name) if name == "text" else F.col("_doc")[name].alias(name) for name in docs.columns)
    )


def _without(text: Column, spans: Column) -> tuple[Column, Column, Column]:
    """What stands between the words, with places; places of the words to keep; the words."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    between = F.split(text, WORD)
    dropped = F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["end"] - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size(words) - 1), dropped)
    held = F.transform(between, lambda piece, at: F.struct((2 * at).alias("at"), piece.alias("piece")))
    return held, left, words


def _woven(held: str, left: str, words: str) -> Column:
    """What stood between words, and the words that are left, in their order."""
    some = F.transform(left, lambda at: F.struct((2 * at + 1).alias("at"), F.get(words, at).alias("piece")))
    return F.array_join(F.transform(F.sort_array(F.concat(held, some)), lambda part: part["piece"]), "")

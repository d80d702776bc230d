"""Token counts of whole texts, the huge ones by overlapping chunks.

A huge document is encoded in chunks that overlap, each with the offsets of its tokens.
Two chunks are spliced where both have a token boundary at the same character, agree on
the tokens around it, and the text proves the place stable: white space stands before
it. The tokenizer drops white space, no word it forms and no special string holds any,
and its normal form joins no characters across it, so what follows such a place is
encoded alike whatever came before. An overlap reaches back to such a place; where the
chunks do not agree there it is doubled.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
CHUNK = 1 << 15
OVERLAP = 256
AGREE = 4
"""Characters in a chunk and in the first overlap; tokens that must agree after a splice."""

KNOWN_PIECES = 200_000
"""Counts of frequent pieces kept by a task; the memory they take is bounded by it."""

LIMIT = 2048
STABLE = " \n\t\r"
PIECE = re.compile(r"[^ \n\t\r]+")

Token = tuple[int, int, int]
Encode = Callable[[str], list[Token]]


def tokens_of(tokenizer) -> Encode:
    """A function from a text to its tokens ``(start, end, id)``."""

    def encode(text: str) -> list[Token]:
        found = tokenizer.encode(text, add_special_tokens=False)
        return [(start, end, token) for token, (start, end) in zip(found.ids, found.offsets, strict=True)]

    return encode


def splice(text: str, left: list[Token], right: list[Token], begin: int, end: int, agree: int = AGREE) -> int | None:
    """The first proven place in ``[begin, end)`` at which ``right`` can take over.

    Both lists carry offsets in the whole text. The place must be stable in the text,
    start a token in both lists, and be followed by the same tokens in both, ``agree`` of
    them or as many as ``left`` still has.
    """
    starts = {start: place for place, (start, _, _) in reversed(list(enumerate(right)))}
    for place, (start, _, _) in enumerate(left):
        if not begin < start < end or text[start - 1] not in STABLE or start not in starts:
            continue
        other = starts[start]
        some = left[place : place + agree]
        if some == right[other : other + len(some)]:
            return start
    return None


def encode_huge(text: str, encode: Encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[Token]:
    """The tokens of a text, encoded chunk by chunk.

    At any time two chunks are held. A chunk is made long enough beforehand to hold a
    stable place, so a text without any is encoded once, as a single chunk, which is what
    an exact count of it needs.
    """

    def encoded(begin: int, end: int) -> list[Token]:
        return [(begin + a, begin + b, token) for a, b, token in encode(text[begin:end])]

    def last_stable(begin: int, end: int) -> int:
        """The last place inside a chunk that white space stands before; 0 if there is none."""
        return 1 + max(text.rfind(blank, begin, end - 1) for blank in STABLE)

    def reach(begin: int, end: int) -> int:
        """Where a chunk ends that is to end there, or later so that it holds a stable place."""
        end = min(end, len(text))
        while end < len(text) and not last_stable(begin, end):
            end = min(begin + 2 * (end - begin), len(text))
        return end

    begin, end = 0, reach(0, chunk)
    held = encoded(begin, end)
    taken = 0
    while end < len(text):
        place = last_stable(begin, end)
        width = max(overlap, end - place + 1)
        while True:
            start = max(begin, end - width)
            if start == begin:  # the overlap is the whole chunk: make a longer chunk of both
                end = reach(begin, begin + 2 * (end - begin))
                held = encoded(begin, end)
                break
            upto = reach(place, start + chunk + width)
            following = encoded(start, upto)
            at = splice(text, held, following, start, end)
            if at is not None:
                yield from (t for t in held if taken <= t[0] < at)
                taken, begin, end = at, at, upto
                held = [t for t in following if t[0] >= at]
                break
            width *= 2
    yield from (t for t in held if t[0] >= taken)


class Counter:
    """Counts the tokens of texts with one tokenizer."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has its own cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.known: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) > self.chunk:
            return sum(1 for _ in encode_huge(text, tokens_of(self.tokenizer), self.chunk, self.overlap))
        return self._pieces(text)

    def _pieces(self, text: str) -> int:
        """The sum over what stands between stable places, each distinct piece encoded once."""
        pieces = PIECE.findall(text)
        new = list({piece for piece in pieces if piece not in self.known})
        if len(self.known) + len(new) > KNOWN_PIECES:
            self.known, new = {}, list(set(pieces))
        for piece, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[piece] = len(found)
        return sum(map(self.known.__getitem__, pieces))


def token_counts(
    docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """One row per document row: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``path`` names the vocabulary file. Tokens are those of the whole text, without added
    ones. A null text counts as empty: no bytes and no tokens. Rows that repeat come back
    as often as they were, and other columns are left aside.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if not (overlap >= 1 and chunk > overlap):
        raise ValueError("a chunk is longer than its overlap, which is 1 or more")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, chunk, overlap)
        for batch in batches:
            counts = pa.array([counter.count(value.as_py()) for value in batch.column(2)], pa.int64())
            columns = [batch.column(0), batch.column(1), counts]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_tokens bigint"
    found = docs.select("doc_id", n_bytes, "text").mapInArrow(counted, schema)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)

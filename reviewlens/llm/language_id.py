"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit of it a binary classifier over hashed
character n-grams tells the languages with a 1 from those with a 0. A text is read by
all classifiers, and the codeword with the least loss wins, where each bit's loss is
weighted by how well its classifier does. If two codewords come close, the answer is
marked ambiguous.

The classifiers are Bayesian log ratios of n-gram shares, so all they need of the corpus
is how often each n-gram occurs in each language. Spark adds that up over every labelled
row; the driver holds one number for each language and n-gram bucket and no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAMS = (1, 2, 3)
BUCKETS = 1 << 14
"""Lengths of n-grams in bytes, and hash buckets for all of them."""

MAX_LANGUAGES = 4_000
"""The model is at most so many languages by ``BUCKETS`` numbers; more raise an error."""

SMOOTHING = 0.5
SLICE = 1 << 20
"""Bytes of a text turned into n-grams at a time."""

SPREAD = 8.0
AMBIGUOUS = 0.55
"""How sharply losses become a score, and the score below which an answer is ambiguous."""

UNKNOWN = "und"


def grams(text: str) -> np.ndarray:
    """How often each bucket occurs in the lower-case text."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    longest = max(GRAMS)
    for begin in range(0, len(data), SLICE):
        part = data[begin : begin + SLICE + longest - 1].astype(np.uint32)
        for n in GRAMS:
            stop = min(SLICE, len(data) - begin - n + 1)
            if stop <= 0:
                continue
            code = np.full(stop, n, np.uint32)
            for at in range(n):
                code = code * np.uint32(257) + part[at : at + stop]
            code *= np.uint32(2654435761)
            counts += np.bincount(code >> np.uint32(33 - BUCKETS.bit_length()), minlength=BUCKETS)
    return counts


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A row of bits for each class, rows far apart.

    Up to seven classes all ways to part them are used, which keeps any two rows apart
    in more than half of the bits. Beyond that, rows are drawn: of several drawings the
    one whose closest rows are farthest apart is kept.
    """
    if classes <= 1:
        return np.ones((classes, 1), np.int8)
    if classes <= 7:
        bits = [[(part >> row) & 1 for part in range(1, 2 ** (classes - 1))] for row in range(classes - 1)]
        return np.array([*bits, [0] * (2 ** (classes - 1) - 1)], np.int8)
    draw, best, apart = np.random.default_rng(seed), None, -1
    length = int(np.ceil(10 * np.log2(classes)))
    for _ in range(20):
        code = draw.integers(0, 2, (classes, length)).astype(np.int8)
        mixed = code.sum(0)
        code[0, mixed == 0] = 1
        code[0, mixed == classes] = 0
        signs = 2.0 * code - 1
        close = int(((length - (signs @ signs.T)) / 2 + length * np.eye(classes)).min())
        if close > apart:
            best, apart = code, close
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    ratios: np.ndarray  # buckets x bits: log of the share among 1-languages over that among 0-languages
    trust: np.ndarray  # of each bit

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, a score from 0 to 1, and whether another comes close."""
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        counts = grams(text)
        used = np.flatnonzero(counts)
        margins = (counts[used] @ self.ratios[used]) / counts[used].sum()
        signs = 2.0 * self.code - 1
        loss = (np.log1p(np.exp(-np.clip(SPREAD * signs * margins, -50, 50))) * self.trust).sum(1) / self.trust.sum()
        odds = np.exp(-SPREAD * (loss - loss.min()))
        score = float(odds.max() / odds.sum())
        return self.languages[int(loss.argmin())], score, score < AMBIGUOUS


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``lang``, ``bucket``, ``n`` over all rows; each task sends a language's buckets once."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}

        def rows():
            for lang, counts in found.items():
                used = np.flatnonzero(counts)
                columns = [[lang] * len(used), used, counts[used]]
                kinds = [pa.string(), pa.int32(), pa.int64()]
                arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "bucket", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                counts = grams(text.as_py())
                name = lang.as_py()
                found[name] = found[name] + counts if name in found else counts
            if len(found) > 64:
                yield from rows()
                found = {}
        yield from rows()

    useful = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    found = useful.mapInArrow(counted, "lang string, bucket int, n bigint")
    return found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame) -> Model:
    """Learn from ``text`` and ``lang`` of all rows that have both.

    Without any such row the model knows no language and answers ``und``; with a single
    language it answers that one.
    """
    both = (F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("n"))
    counts = gram_counts(labelled).groupBy("lang").agg(*both)
    rows = counts.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = tuple(row.lang for row in rows)
    seen = np.zeros((len(rows), BUCKETS))
    for place, row in enumerate(rows):
        seen[place, row.buckets] = row.n
    shares = (seen + SMOOTHING) / (seen + SMOOTHING).sum(1, keepdims=True)
    code = codewords(len(languages))
    ratios = np.zeros((BUCKETS, code.shape[1]), np.float32)
    trust = np.ones(code.shape[1])
    for bit in range(code.shape[1]):
        one, zero = code[:, bit] == 1, code[:, bit] == 0
        if one.any() and zero.any():
            ratios[:, bit] = np.log(shares[one].mean(0)) - np.log(shares[zero].mean(0))
            # How far the classifier sets the closest language of either side apart.
            margins = shares @ ratios[:, bit].astype(float)
            trust[bit] = max(1e-3, float(np.minimum(np.where(one, margins, -margins), 1.0).mean()))
    return Model(languages, code, ratios, trust)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document row: ``doc_id``, ``lang_pred``, ``score``, ``ambiguous``.

    Only the text is read. A null text, or one without a letter, is ``und`` with score 0.
    """

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[2] for x in found], pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "ambiguous"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        answered, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean"
    )


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is known, with the columns they came with."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([not rejected(model, text.as_py()) for text in texts], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def rejected(model: Model, text: str | None) -> bool:
    return model.predict(text)[0] == UNKNOWN


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training, by the CRC of its id (a null id: of no bytes)."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1

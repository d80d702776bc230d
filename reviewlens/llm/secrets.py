"""Secret scans: a keyword automaton, anchored patterns near its hits, checksums.

One pass of an Aho-Corasick automaton over a text finds where a secret could start.
Only there is the pattern of that kind tried, anchored at the hit. Tokens that carry a
checksum are kept only if it holds. Hexadecimal runs have no keyword; every run long
enough must cover one of evenly spaced places, so only the runs around those are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "forge", "registry", "card")
"""In the order in which spans that start together are listed."""

# The patterns of the three base kinds.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

# Prefixes of tokens whose last six characters are the base-62 CRC-32 of
# the thirty before, and the alphabet of that checksum.
FORGE_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
REGISTRY_PREFIXES = ("npm_",)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CHECKED = re.compile(r"[a-z]+_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
CARD_WORDS = ("card", "visa", "mastercard")
CARD = re.compile(
    r"(?:card|visa|mastercard)[^0-9\n]{0,20}([0-9](?:[ -]?[0-9]){12,18})(?![0-9])", re.IGNORECASE | re.ASCII
)

Span = tuple[int, int, str]


def checksum62(body: str) -> str:
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits.rjust(6, "0")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _automaton() -> ahocorasick.Automaton:
    words = {
        "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
        "access": ("akia",),
        "forge": FORGE_PREFIXES,
        "registry": REGISTRY_PREFIXES,
        "card": CARD_WORDS,
    }
    found = ahocorasick.Automaton()
    for kind, some in words.items():
        for word in some:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _lowered(text: str) -> str:
    """Lower case with every character in its place; what the automaton reads."""
    return text.replace("İ", "i").lower()


def _hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of at least ``HEX_LENGTH`` digits: each covers a multiple of it."""
    end = 0
    for at in range(HEX_LENGTH - 1, len(text), HEX_LENGTH):
        if at < end or text[at] not in "0123456789abcdef":
            continue
        start = at
        while start > end and text[start - 1] in "0123456789abcdef":
            start -= 1
        end = HEX.match(text, start).end()
        if end - start >= HEX_LENGTH:
            yield start, end


def scan(text: str, automaton: ahocorasick.Automaton) -> list[Span]:
    """All spans ``(start, end, kind)`` of a text, by start, then kind."""
    found: list[Span] = [(start, end, "hex") for start, end in _hex_runs(text)]
    free = dict.fromkeys(KINDS, 0)
    hits = sorted((last - length + 1, kind) for last, (kind, length) in automaton.iter(_lowered(text)))
    for start, kind in hits:
        if start < free[kind]:
            continue
        if kind == "assign":
            match = ASSIGN.match(text, start)
            good = match and len(match[2]) >= ASSIGN_VALUE
        elif kind == "access":
            match = ACCESS.match(text, start)
            good = match and match.end() - start >= ACCESS_LENGTH
        elif kind == "card":
            match = CARD.match(text, start)
            good = match and luhn(re.sub("[ -]", "", match[1]))
        else:
            match = CHECKED.match(text, start)
            good = match and checksum62(match[1]) == match[2]
        if match:
            free[kind] = match.end()
        if good:
            found.append((start, match.end(), kind))
    return sorted(found, key=lambda span: (span[0], KINDS.index(span[2]), span[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document row: ``doc_id``, counts of the base kinds, ``base_sha256``, ``spans``.

    Places count code points, ends are exclusive, and spans of one kind do not overlap.
    ``spans`` also lists tokens with a valid checksum (``forge``, ``registry``) and card
    numbers named as such with a valid check digit (``card``). A null or empty text has no
    span and so the digest of nothing. Rows that repeat come back as often as they were.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            found = [scan(text, automaton) if text else [] for text in _texts(batch.column(1))]
            base = [[span for span in spans if span[2] in BASE_KINDS] for spans in found]
            counts = [[sum(span[2] == kind for span in spans) for spans in base] for kind in BASE_KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(count, pa.int64()) for count in counts),
                    pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string()),
                    pa.array([joined(spans) for spans in found], pa.string()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scanned, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    )


def _texts(column: pa.Array) -> Iterator[str | None]:
    """The texts of a batch, one at a time."""
    return (value.as_py() for value in column)

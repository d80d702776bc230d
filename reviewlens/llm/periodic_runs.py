"""Periodic runs of words, found with a run-length grammar built by recompression.

A text is compressed in rounds that take turns: a round of blocks replaces each maximal
repetition of a symbol by a new symbol, a round of pairs splits the symbols into opening
and closing ones and replaces each opening symbol with the closing one after it. The
rounds are the levels of a grammar. Equal stretches are compressed alike but for a symbol
at each edge, so how far two places of the text agree is found by climbing the levels as
long as what follows both is equal and going down again where it first differs: some
steps on each level, and no suffix array.

Candidates stand on a harmonic grid. A run of period ``q`` and at least ``n`` words holds
``n - q`` places ``i`` with ``i + q`` in the run, so one of every ``n - q`` places is tried
for each ``q``. Agreement after and before ``i`` and ``i + q`` gives the run exactly.

Texts of a task are joined to one sequence, with a mark of its own after each, and worked
on together; a text longer than a sequence is one by itself. All of it takes memory in
proportion to the sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.columns import BLANKS, pieces

LEAST = 6
EXPONENT = 4
"""A run has so many words at least, and so many times its period."""

SEQUENCE = 1 << 18
CANDIDATES = 1 << 20
"""Words of a sequence from which on it is worked on; places tried at a time."""

RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


@dataclass
class Round:
    """One round: the symbols it found, and how they fall into those it made.

    ``up`` is the place among the new symbols, ``down`` the first place that a new symbol
    stands for, with the end after the last. ``opening`` and ``closing`` say in a round of
    pairs what each symbol may be; a round of blocks has neither.
    """

    symbols: np.ndarray
    up: np.ndarray
    down: np.ndarray
    opening: np.ndarray | None = None
    closing: np.ndarray | None = None

    def mirrored(self) -> Round:
        """The round of the text read backwards."""
        n, made = len(self.symbols), len(self.down) - 1
        swapped = (None, None) if self.opening is None else (self.closing[::-1], self.opening[::-1])
        return Round(self.symbols[::-1], made - 1 - self.up[::-1], n - self.down[::-1], *swapped)


def _coin(symbols: np.ndarray, turn: int) -> np.ndarray:
    """A bit for each symbol, another each turn."""
    mixed = (symbols.astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(40)) & np.uint64(1) == 1


def _parted(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``up`` and ``down`` of a round whose new symbols begin at the marked places."""
    up = np.cumsum(starts, dtype=np.int64) - 1
    return up, np.append(np.flatnonzero(starts), len(symbols))


def _named(symbols: np.ndarray, down: np.ndarray, first: np.ndarray, second: np.ndarray, free: int) -> tuple[np.ndarray, int]:
    """The new symbols: those of one place keep their name, others are named by what they are made of."""
    made = symbols[down[:-1]].copy()
    if len(first):
        _, names = np.unique((symbols[down[first]] << 32) | second, return_inverse=True)
        made[first] = free + names
        free += int(names.max()) + 1
    return made, free


def compress(symbols: np.ndarray, marks: np.ndarray) -> list[Round]:
    """The rounds over symbols from 0 on, until each text between marks is one symbol.

    ``marks`` are the places of symbols that stand nowhere else and are never joined.
    """
    free = int(symbols.max()) + 1 if len(symbols) else 0
    is_mark = np.zeros(len(symbols), bool)
    is_mark[marks] = True
    texts = int(np.count_nonzero(~is_mark[:-1] & is_mark[1:]))  # those with a word
    rounds: list[Round] = []
    turn = 0
    while len(symbols) > texts + len(marks):
        starts = np.ones(len(symbols), bool)
        np.not_equal(symbols[1:], symbols[:-1], out=starts[1:])
        if not starts.all():
            up, down = _parted(symbols, starts)
            width = np.diff(down)
            many = np.flatnonzero(width > 1)
            made, free = _named(symbols, down, many, width[many], free)
            rounds.append(Round(symbols, up, down))
            symbols, is_mark = made, is_mark[down[:-1]]
        coin = _coin(symbols, turn)
        turn += 1
        opening, closing = coin & ~is_mark, ~coin & ~is_mark
        starts = np.ones(len(symbols), bool)
        np.logical_not(opening[:-1] & closing[1:], out=starts[1:])
        if starts.all():
            continue
        up, down = _parted(symbols, starts)
        pairs = np.flatnonzero(np.diff(down) > 1)
        made, free = _named(symbols, down, pairs, symbols[down[pairs] + 1], free)
        rounds.append(Round(symbols, up, down, opening, closing))
        symbols, is_mark = made, is_mark[down[:-1]]
    rounds.append(Round(symbols, np.arange(len(symbols)), np.arange(len(symbols) + 1)))
    return rounds


def agreement(rounds: list[Round], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols the first level has alike from ``i`` and ``j`` on.

    ``i`` and ``j`` differ and a symbol that stands nowhere else follows both.
    """
    a, b = i.astype(np.int64), j.astype(np.int64)
    parted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # on each level: who differs, and where
    who = np.arange(len(a))
    for level in rounds:
        same = level.symbols[a] == level.symbols[b]
        gone = [(who[~same], a[~same], b[~same])]
        who, a, b = who[same], a[same], b[same]
        if level.closing is not None:
            # What opens begins a new symbol on both sides; after what closes one begins.
            step = level.closing[a]
            a, b = a + step, b + step
        else:
            left, right = level.down[level.up[a] + 1] - a, level.down[level.up[b] + 1] - b
            step = np.minimum(left, right)
            a, b = a + step, b + step
            ended = left != right
            gone.append((who[ended], a[ended], b[ended]))
            who, a, b = who[~ended], a[~ended], b[~ended]
        parted.append(tuple(np.concatenate(part) for part in zip(*gone, strict=True)))
        a, b = level.up[a], level.up[b]
    who, a, b = parted[-1]
    for level, (own, x, y) in zip(reversed(rounds[:-1]), reversed(parted[:-1]), strict=True):
        a, b = level.down[a], level.down[b]
        same = level.symbols[a] == level.symbols[b]
        if level.closing is not None:
            step = same.astype(np.int64)
        else:
            left, right = level.down[level.up[a] + 1] - a, level.down[level.up[b] + 1] - b
            step = np.where(same, np.minimum(left, right), 0)
        who, a, b = np.concatenate((who, own)), np.concatenate((a + step, x)), np.concatenate((b + step, y))
    found = np.zeros(len(i), np.int64)
    found[who] = a - i[who]
    return found


def _grid(begins: np.ndarray, sizes: np.ndarray, least: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods to try in texts that begin there and have so many words."""
    longest = np.where(sizes >= least, sizes // exponent, 0)
    text = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(len(text)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    step = np.maximum(least, exponent * period) - period
    count = (sizes[text] - period + step - 1) // step
    ends = np.cumsum(count)
    at = 0
    while at < len(text):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] - count[at] + CANDIDATES)))
        some = slice(at, upto)
        n = count[some]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(begins[text[some]], n) + nth * np.repeat(step[some], n), np.repeat(period[some], n)
        at = upto


def find_runs(
    symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT
) -> np.ndarray:
    """Rows ``start``, ``end``, ``period`` of all runs, by start, then period.

    ``symbols`` holds texts of the given sizes, with a symbol that stands nowhere else
    before the first and after each. A stretch counts with its smallest period only.
    """
    marks = np.concatenate((begins - 1, [len(symbols) - 1]))
    places = [(i[same], q[same]) for i, q in _grid(begins, sizes, least, exponent) for same in [symbols[i] == symbols[i + q]]]
    none = np.zeros((0, 3), np.int64)
    if not any(len(i) for i, _ in places):
        return none
    rounds = compress(symbols, marks)
    backwards, last = [level.mirrored() for level in rounds], len(symbols) - 1
    found = []
    for i, q in places:
        end = i + q + agreement(rounds, i, i + q)
        start = i - agreement(backwards, last - (i - 1), last - (i + q - 1))
        long = end - start >= np.maximum(least, exponent * q)
        found.append(np.column_stack((start[long], end[long], q[long])))
    runs = np.concatenate([none, *found])
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)  # of one stretch the smallest period comes first
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[fresh]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of_texts(
    texts: list[list[bytes]], least: int = LEAST, exponent: int = EXPONENT
) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text its runs ``(start, length, period)`` and its words without their repetition."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + 1) - sizes  # a mark stands before the first and after each
    known: dict[bytes, int] = {}
    symbols = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    for begin, words in zip(begins.tolist(), texts, strict=True):
        symbols[begin : begin + len(words)] = [known.setdefault(word, len(known)) for word in words]
    marks = np.concatenate((begins - 1, [len(symbols) - 1]))
    symbols[marks] = len(known) + np.arange(len(marks))
    runs = find_runs(symbols, begins, sizes, least, exponent)
    # A word goes if a run holds it after the run's first period.
    depth = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    stays = np.cumsum(depth)[:-1] == 0
    cuts = np.searchsorted(runs[:, 0], np.append(begins, len(symbols)))
    for at, (begin, words) in enumerate(zip(begins.tolist(), texts, strict=True)):
        own = runs[cuts[at] : cuts[at + 1]]
        if not len(own):
            yield [], b" ".join(words)
            continue
        kept = np.flatnonzero(stays[begin : begin + len(words)]).tolist()
        rows = np.column_stack((own[:, 0] - begin, own[:, 1] - own[:, 0], own[:, 2]))
        yield list(map(tuple, rows.tolist())), b" ".join([words[place] for place in kept])


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row per document row: ``doc_id``, ``n_words``, ``runs``, ``collapsed``.

    Words are what stands between ASCII white space. A run is a stretch of consecutive
    words with smallest period ``q`` (words ``q`` apart are identical) and at least
    ``least`` words and ``exponent`` times ``q``, that no neighbouring word extends keeping
    the period. ``runs`` holds all of them, ``start`` (from 0), ``length``, ``period``, by
    start, then period. ``collapsed`` is the text, joined by one space, without the words
    that a run holds after its first ``q``; without runs it is all words. A null or empty
    text has no words and no runs. Rows that repeat come back as often as they were, and
    other columns are left aside. Each whole text is searched.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has two words and two periods at least")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                texts, end, n = [], begin, 0
                while end < batch.num_rows and n < SEQUENCE:
                    texts.append((batch.column(1)[end].as_py() or "").encode().split())
                    n += len(texts[-1])
                    end += 1
                found = list(runs_of_texts(texts, least, exponent))
                runs = [[dict(zip(("start", "length", "period"), run, strict=True)) for run in own] for own, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin),
                        pa.array(list(map(len, texts)), pa.int64()),
                        pa.array(runs, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))),
                        pa.array([text for _, text in found], pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )
                begin = end

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, runs {RUN}, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(searched, schema)


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """The documents, a tenth of them with a periodic tail, by the CRC of their id.

    Where ``h``, the CRC-32 of the id in decimal, is divisible by 10, and there are
    words, word ``i`` from ``a`` on becomes word ``a + (i - a) % p``, with ``g = h div 10``,
    ``a = g % n`` and ``p = 1 + (n - a) div (3 + g % 8)``. A null id leaves its text alone.
    """
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.col("_words")
    n = F.size(words).cast("bigint")
    g = F.floor(F.col("_h") / 10).cast("bigint")
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), h.alias("_h"))
    chosen = F.col("_h") % 10 == 0
    rows = rows.withColumn("_words", F.when(chosen, pieces(F.col("_doc.text"), BLANKS)))
    a = F.when(n > 0, F.pmod(g, n))
    rows = rows.withColumn("_a", a.cast("int"))
    rows = rows.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.pmod(g, F.lit(8))))).cast("int"))
    tail = F.transform(
        F.sequence(F.lit(0), F.size(words) - 1 - F.col("_a")),
        lambda i: F.get(words, (F.col("_a") + F.pmod(i, F.col("_p"))).cast("int")),
    )
    text = F.array_join(F.concat(F.slice(words, F.lit(1), F.col("_a")), tail), " ")
    planted = F.when(F.col("_a").isNotNull(), text).otherwise(F.col("_doc.text"))
    return rows.select(*(planted.alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns))


def longest(runs: Column) -> Column:
    """The run of the greatest length; ties: smallest start, then period. Null if there is none."""
    by = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    least = F.array_min(by)
    return F.when(F.size(runs) > 0, F.struct(least["s"].alias("start"), (-least["l"]).alias("length"), least["p"].alias("period")))

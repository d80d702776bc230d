"""Column expressions over one text: sentences, words, capitalised runs.

All of them are built-in expressions on the row, so they stay in the scan stage.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define sentences, words and mentions here.
SENTENCE = r"[^.!?\r\n]+[.!?]*"
WORD = r"\p{L}+"
WORD_OR_SYMBOLS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
NAME = r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*"
MENTION = NAME + r"|\p{L}+"
CAPITALISED = r"^\p{Lu}\p{L}"
BLANKS = " \t"


def matches(text: Column | str, pattern: str) -> Column:
    """Every match of ``pattern`` in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def sentence_array(text: Column | str) -> Column:
    """The sentences of a text: a run up to its closing marks or a line end.

    Blanks around a sentence are cut and empty ones dropped.
    """
    trimmed = F.transform(matches(text, SENTENCE), lambda s: F.btrim(s, F.lit(BLANKS)))
    return F.filter(trimmed, lambda s: s != "")


def word_array(text: Column | str, lowercase: bool = True, symbols: bool = False) -> Column:
    """The words of a text; with ``symbols`` also numbers and punctuation runs."""
    source = F.lower(text) if lowercase else text
    return matches(source, WORD_OR_SYMBOLS if symbols else WORD)


def last_word(run: Column | str) -> Column:
    """The lower-case last word of a run of words."""
    return F.lower(F.substring_index(run, " ", -1))


def valence_sum(words: Column, lexicon: Mapping[str, int]) -> Column:
    """Sum of the valences of the words found in a small lexicon."""
    if not lexicon:
        return F.lit(0)
    levels: dict[int, list[str]] = {}
    for term, valence in sorted(lexicon.items()):
        levels.setdefault(valence, []).append(term)

    def valence_of(word: Column) -> Column:
        value = F.lit(0)
        for valence, terms in sorted(levels.items()):
            value = F.when(word.isin(terms), F.lit(valence)).otherwise(value)
        return value

    hits = F.filter(words, lambda w: w.isin(sorted(lexicon)))
    return F.aggregate(hits, F.lit(0), lambda total, w: total + valence_of(w))


def contains_all(text: Column, words: Iterable[str]) -> Column:
    """Whether every word occurs in the text, in any letter case."""
    found = F.lit(True)
    for word in words:
        found = found & F.contains(F.lower(text), F.lit(word.lower()))
    return found

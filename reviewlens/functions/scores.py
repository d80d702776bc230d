"""Column expressions over sentiment classes 0 to 4."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, by class from 0 (worst) to 4 (best).
LABELS = ["very_negative", "negative", "neutral", "positive", "very_positive"]
THUMBS = ["down down", "down", "up down", "up", "up up"]
SEVERITIES = ["danger", "warning", "default", "success", "primary"]


def _by_class(score: Column, values: list[str]) -> Column:
    """The value of a class; NULL outside 0 to 4."""
    return F.get(F.array(*[F.lit(v) for v in values]), score)


def sentiment_class(valence: Column) -> Column:
    """Valence sum to class: two or more either way is an extreme, zero is 2."""
    return (F.greatest(F.lit(-2), F.least(F.lit(2), valence)) + 2).cast("int")


def _unexpected(score: Column) -> Column:
    return F.concat(F.lit("Unexpected score: "), score.cast("string"))


def score_label(score: Column) -> Column:
    """Readable name of a class; other scores are named as unexpected."""
    return F.coalesce(_by_class(score, LABELS), _unexpected(score))


def score_thumbs(score: Column) -> Column:
    """The thumbs shown for a class; other scores are named as unexpected."""
    return F.coalesce(_by_class(score, THUMBS), _unexpected(score))


def score_severity(score: Column) -> Column:
    """Severity of a class; NULL outside 0 to 4."""
    return _by_class(score, SEVERITIES)

"""Working on arrays inside a row: evaluate once, cut into groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    A plain projection may be merged into the expressions that use it, and
    filters on those pushed below it, which would repeat costly text work.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def record(**fields: Column) -> Column:
    """A struct with the given field names, inside lambdas too."""
    return F.named_struct(*(part for name, value in fields.items() for part in (F.lit(name), value)))


def places(array: str, starts_group: Callable[[Column, Column], Column]) -> Column:
    """Positions, from 0, of the elements that start a group."""
    marked = F.transform(array, lambda x, i: F.when(starts_group(x, i), i))
    return F.array_compact(marked)


def group_end(array: str, at: str, number: Column) -> Column:
    """Where group ``number`` ends: the next starting place or the end of the array."""
    return F.coalesce(F.get(at, number + 1), F.size(array))


def group(array: str, at: str, place: Column, number: Column) -> Column:
    """The elements of group ``number``, which starts at ``place``."""
    return F.slice(array, place + 1, group_end(array, at, number) - place)

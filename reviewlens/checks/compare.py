"""Order-free comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pandas as pd


def duck_tables(con, folder: str) -> None:
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE OR REPLACE VIEW {path.stem} AS SELECT * FROM '{path}'")


def _kind(values: pd.Series) -> str:
    return values.dtype.kind if values.notna().all() else "?"


def _rows(frame: pd.DataFrame) -> Counter:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return Counter(map(tuple, frame.itertuples(index=False, name=None)))


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """What differs between two results, or ``None``."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} and {sorted(right.columns)}"
    for column in left.columns:
        kinds = _kind(left[column]), _kind(right[column])
        if len(left) and "?" not in kinds and kinds[0] != kinds[1]:
            return f"types of {column}: {left[column].dtype} and {right[column].dtype}"
        if len(left) and "?" not in kinds and left[column].dtype != right[column].dtype:
            if kinds[0] in "if":
                return f"types of {column}: {left[column].dtype} and {right[column].dtype}"
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows"
    a, b = _rows(left), _rows(right)
    if a == b:
        return None
    return f"only left {list((a - b).items())[:2]}; only right {list((b - a).items())[:2]}"

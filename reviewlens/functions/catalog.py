"""Column expressions over movies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what is shown for a movie without a synopsis.
NO_SYNOPSIS = "No synopsis."


def synopsis_or_default(synopsis: Column) -> Column:
    return F.coalesce(F.nullif(synopsis, F.lit("")), F.lit(NO_SYNOPSIS))

"""Column expressions and checks that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
"""What separates words where a contract says words are ``[^\\x20\\x09-\\x0D]+``."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    mapped = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(plain, F.lower(text)).otherwise(mapped)


def pieces(text: Column, separator: str) -> Column:
    """What stands between the separators; a null text has no piece."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")

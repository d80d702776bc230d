"""The entry module: what it needs, and what it does without."""

import os
import subprocess
import sys

import pytest

from reviewlens.checks.queries import QUERIES
from reviewlens.session import durable, drop_table, release, scratch_tables, shared_folder, stored, written_table

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["xxhash", "reviewlens.llm"])
def test_queries_without_a_library_of_the_operators(missing):
    """What only the training-data operators need may be absent; all other queries stay."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(*e.queries(), *e.oracle_sql())"
    found = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    names = set(found.stdout.split())
    assert set(QUERIES) <= names and not any(name.startswith("op1") for name in names) and "pipeline" not in names


def files(path):
    from urllib.parse import urlparse

    return set(os.listdir(urlparse(path).path))


def test_scratch_tables_are_removed_and_outer_ones_stay(spark):
    folder = shared_folder(spark)
    outer = written_table(spark.range(3))
    checkpoints = spark.sparkContext.getCheckpointDir()
    before, cut = files(folder), files(checkpoints)
    with scratch_tables(spark):
        assert stored(spark.range(5)).count() == 5 and durable(spark.range(7)).count() == 7
        assert files(folder) > before and files(checkpoints) > cut
    assert files(folder) == before and files(checkpoints) == cut
    assert spark.read.parquet(outer).count() == 3
    drop_table(spark, outer)
    assert os.path.basename(outer) not in files(folder)
    assert release(spark) >= 0

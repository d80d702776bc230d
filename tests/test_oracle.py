"""Every registered query with SQL gives the same rows as DuckDB."""

import duckdb
import pytest

from __spark_entry__ import entry
from reviewlens.checks.compare import difference, duck_tables
from reviewlens.checks.oracles import ORACLES
from reviewlens.checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    duck_tables(con, FOLDER)
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    assert difference(found, con.sql(ORACLES[name]).df()) is None


def test_only_models_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {"learned_scores", "lda_topics"}
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    found = entry(spark)
    assert found.columns == ["doc_id", "chain_key", "topic", "score", "sentence"]
    assert found.count() > 0


def test_learned_scores(spark):
    found = QUERIES["learned_scores"](spark, FOLDER)
    assert found.columns == ["doc_id", "sent_no", "score"]
    assert {r.score for r in found.select("score").distinct().collect()} <= {0, 1}
    assert found.count() == QUERIES["sentences"](spark, FOLDER).count()

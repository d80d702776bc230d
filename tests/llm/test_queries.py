"""The registered queries, against SQL or what they must hold, and the pipeline."""

import os
from urllib.parse import urlparse

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from reviewlens.checks.compare import difference, duck_tables
from reviewlens.llm import decontaminate, language_id, mixing, sharding, simhash
from reviewlens.llm.oracles import ORACLES
from reviewlens.llm.queries import QUERIES
from reviewlens.session import release, shared_folder

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    duck_tables(con, FOLDER)
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER).toPandas(), con.sql(ORACLES[name]).df()) is None


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(ORACLES) <= set(oracle_sql()) and "pipeline" not in oracle_sql()
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_a_row_for_each_document(spark, name):
    found = QUERIES[name](spark, FOLDER)
    ids = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id")
    assert found.count() == ids.count() and found.select("doc_id").exceptAll(ids).count() == 0


def test_pipeline(spark):
    """Each stage against its own rule, on what the stage before kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = stage(spark, docs, FOLDER).cache()
        if name != "sharding":
            assert kept[name].columns == docs.columns
        before, docs = docs, kept[name]
        if name == "language_id":
            answers = language_id.identify(before, language_id.train(before))
            want = answers.where(F.col("lang_pred") != "und").select("doc_id")
        elif name == "near_dedup":
            want = simhash.near_duplicates(before).select(F.col("component_id").alias("doc_id")).distinct()
        elif name == "decontaminate":
            want = decontaminate.benchmark_hits(before, benchmark).where(F.size("spans") == 0).select("doc_id")
        elif name == "mixing":
            taken = mixing.mixture(before).where("taken > 0")
            want = taken.select("doc_id", F.explode(F.array_repeat(F.lit(0), (F.col("taken") / F.col("size")).cast("int"))))
            want = want.select("doc_id")
        else:
            want = before.select("doc_id")
        some = docs.select("doc_id")
        if name == "mixing":
            some = docs.where(mixing.word_count(F.col("text")) > 0).select("doc_id")
        assert some.exceptAll(want).count() == 0 and want.exceptAll(some).count() == 0, name
    assert kept["near_dedup"].count() < kept["language_id"].count()
    assert kept["decontaminate"].count() < kept["near_dedup"].count()


def _left(spark):
    """What is in the shared folder and in the folder of checkpoints."""
    places = [shared_folder(spark), spark.sparkContext.getCheckpointDir()]
    return {f"{place}/{name}" for place in places for name in os.listdir(urlparse(place).path)}


def test_pipeline_run(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None
    release(spark)
    before = _left(spark)
    found = corpus_pipeline.run(spark, FOLDER)
    new = _left(spark) - before
    assert len(new) == 1 and "/pipeline-" in new.pop()  # what stages wrote on their way is gone
    assert found.columns == sharding.shard_documents(spark.read.parquet(f"{FOLDER}/documents.parquet")).columns
    assert found.count() > 0


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

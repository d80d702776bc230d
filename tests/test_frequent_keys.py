"""Joins to a large dimension exchange only the facts of its less frequent keys; documents are dealt by size."""

import pytest
from pyspark.sql import functions as F

from reviewlens import sizing
from reviewlens.operators import mentions as of_mentions
from reviewlens.operators import sentences as of_sentences
from reviewlens.operators import terms as of_terms
from reviewlens.operators.local_terms import count_document_terms
from reviewlens.operators.tokens import tokens
from reviewlens.plans import opinions
from reviewlens.sources import texts as of_texts


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_frequent_keys_are_not_exchanged(spark, monkeypatch, rows, how):
    """Three keys are broadcast, though the dimension is not: those of nine rows in ten."""
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 3)
    keys = [k for k in "abc" for _ in range(30)] + ["x", "y", "z", "q", None, None]
    facts = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, i int")
    dimension = spark.createDataFrame([(k, k * 2) for k in "abxyzw"], "key string, value string")
    plain = rows(facts.join(dimension, "key", how))
    spread = []
    monkeypatch.setattr(sizing, "_spread_join", lambda *a: spread.append(a))
    found = sizing.join_dimension(facts, dimension, "key", how)
    assert not spread and found.columns == facts.join(dimension, "key", how).columns
    assert rows(found) == plain


def test_a_lexicon_table_is_read_once(spark, texts, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(of_sentences, "bounded_rows", lambda df: None)
    words = spark.createDataFrame([("fine", 2), ("bad", -2)], "term string, valence int")
    lexicon = words.mapInArrow(counted, "term string, valence int")
    lines = of_sentences.sentences(texts("All fine. All bad! All."))
    found = of_sentences.sentence_scores(lines, lexicon).select("sent_no", "score").collect()
    assert {r.sent_no: r.score for r in found} == {1: 4, 2: 0, 3: 2} and seen.value == 2


def test_large_tables_of_documents_are_dealt_in_more_parts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "documents.parquet")
    spark.range(2000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).write.parquet(path)
    few = of_texts.read_documents(spark, path, per_document=True).rdd.getNumPartitions()
    monkeypatch.setattr(of_texts, "PART_BYTES", 1000)
    assert of_texts.read_documents(spark, path, per_document=True).rdd.getNumPartitions() > 4 * few


def test_rare_terms_are_looked_up_without_counting_them(texts, rows, monkeypatch):
    """The vocabulary's order says that they are infrequent; a long term among the first is counted."""
    docs = texts(*["velm dorrit hask", "quill velm hask", "brone osken quill velm", "tamper velm"] * 3)
    counted = count_document_terms(docs)
    ranked = of_terms.vocabulary(of_terms.term_counts(tokens(docs)))
    plain = rows(of_terms.bag_of_words(counted, ranked))
    called = []
    monkeypatch.setattr(of_terms, "join_dimension", lambda *a: called.append(a) or sizing.join_dimension(*a))
    assert rows(of_terms.bag_of_words(counted, ranked, head_terms=2)) == plain and not called
    monkeypatch.setattr(of_terms, "HEAD_TERM_BYTES", 4)
    assert rows(of_terms.bag_of_words(counted, ranked, head_terms=3)) == plain and called


def test_strict_opinions_exchange_only_unknown_names(texts, rows, monkeypatch):
    docs = texts("Velm sat. Hask saw Dorrit Bram. He ran. The X Quill.", "Dorrit ate. aVelm Hask, iT fell. it Hask.", None, "", "velm Velm. Quill it.")
    wanted = rows(opinions.review_opinions(docs.union(docs), {"ran": 2}, strict_initial=True, by_mention=True))
    known = docs.selectExpr("'Quill' AS name")
    given = rows(opinions.review_opinions(docs, {"ran": 2}, strict_initial=True, known_names=known, by_mention=True))
    loose = rows(opinions.review_opinions(docs, {"ran": 2}, by_mention=True))

    def refused(*_, **__):
        raise AssertionError("mentions are exchanged")

    monkeypatch.setattr(opinions, "_by_mention", refused)
    assert wanted and rows(opinions.review_opinions(docs.union(docs), {"ran": 2}, strict_initial=True)) == wanted
    assert given != loose and rows(opinions.review_opinions(docs, {"ran": 2}, strict_initial=True, known_names=known)) == given
    assert rows(opinions.review_opinions(docs, {"ran": 2})) == loose


def test_a_long_lexicon_exchanges_sums_of_sentences(spark, texts, rows, plan_of, monkeypatch):
    """One row for a sentence, not its words, whatever is given twice; mentions stay in their row."""
    lexicon = {"fine": 2, "bad": -2, "dull": -1, "": 9, "so": 0}
    docs = texts("Velm is fine, fine. Hask is bad and dull! So so.", None, "", "Bad. Dorrit bad fine. It fell.")
    docs = docs.union(docs).union(texts("Velm is dull."))
    wanted = rows(opinions.review_opinions(docs, lexicon))
    lines = of_sentences.sentences(docs.distinct().where("doc_id <> 0"))
    short = rows(of_sentences.sentence_scores(lines, lexicon))
    monkeypatch.setattr(of_sentences, "INLINE_ROWS", 1)

    def refused(*_, **__):
        raise AssertionError("mentions are exchanged")

    monkeypatch.setattr(opinions, "_by_mention", refused)
    assert wanted and rows(opinions.review_opinions(docs, lexicon)) == wanted
    assert rows(of_sentences.sentence_scores(lines.union(lines), lexicon)) == sorted(short * 2, key=repr)
    plan = plan_of(of_sentences.scores_found(lines, lexicon, ["doc_id"]))
    assert "partial_sum" in plan and "collect_set" not in plan


def test_many_names_are_looked_up_from_what_was_written(spark, texts, rows, monkeypatch):
    """Names beyond a broadcast: texts are not analysed again to count and to look up what is asked."""
    docs = texts("Velm sat. Hask saw Dorrit Bram. He ran. The X Quill.", "Dorrit ate. Bram fell. It, Hask.", None)
    lines = of_sentences.sentences(docs)
    plain = rows(of_mentions.mentions(lines, strict_initial=True))
    asked, real = [], of_mentions.join_dimension
    monkeypatch.setattr(of_mentions, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(of_mentions, "join_dimension", lambda facts, *a, **b: asked.append(facts) or real(facts, *a, **b))
    assert rows(of_mentions.mentions(lines, strict_initial=True)) == plain
    assert asked[0].inputFiles() and "regexp_extract_all" not in asked[0]._jdf.queryExecution().toString()

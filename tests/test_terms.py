import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import terms
from reviewlens.operators.tokens import drop_terms, term_arrays, tokens
from reviewlens.sizing import INLINE_ROWS


def words(df):
    return [r.term for r in df.orderBy("doc_id", "pos").collect()]


def test_tokens_are_long_enough_lower_case_runs_of_letters(texts):
    docs = texts("The Mall-Cop 2 is a très droll film!", "", "?!", None)
    assert words(tokens(docs)) == ["mall", "cop", "très", "droll", "film"]


def test_tokens_can_keep_case_numbers_and_punctuation(texts):
    docs = texts("Speed 22 -- a Bus.")
    assert words(tokens(docs, lowercase=False, symbols=True)) == ["Speed", "22", "--", "Bus"]


def test_stop_words_are_compared_as_written(texts):
    found = tokens(texts("The the cat"), stopwords=["the"], lowercase=False)
    assert words(found) == ["The", "cat"]


def test_all_copies_of_a_stop_word_go_and_all_others_stay(texts):
    assert words(tokens(texts("cat dog cat the the"), ["the"])) == ["cat", "dog", "cat"]


def test_no_stop_words(texts):
    assert words(tokens(texts("the cat"), [])) == ["the", "cat"]


def test_long_stop_lists_are_joined(spark, texts):
    listed = [f"w{i}" for i in range(INLINE_ROWS + 1)] + ["cat"]
    docs = texts("cat dog cat", "bird cat")
    docs = docs.select("doc_id", F.explode(F.split("text", " ")).alias("term"))
    assert sorted(r.term for r in drop_terms(docs, listed).collect()) == ["bird", "dog"]
    as_frame = spark.createDataFrame([(t,) for t in listed], "term string")
    assert sorted(r.term for r in drop_terms(docs, as_frame).collect()) == ["bird", "dog"]


def test_lemmas_come_before_the_other_filters(spark, texts):
    lemmas = spark.createDataFrame(
        [("was", "be"), ("jokes", "joke"), ("xs", "x"), ("jokes", "zzz")],
        "form string, lemma string",
    )
    docs = texts("jokes was xs droll")
    assert words(tokens(docs, ["be"], lemmas)) == ["joke", "droll"]


def test_term_arrays_keep_documents_without_terms(spark, texts, rows):
    docs = texts("cat the cat", "", "a", None)
    expected = [(0, ["cat", "cat"]), (1, []), (2, []), (3, [])]
    assert rows(term_arrays(docs, ["the"])) == expected
    lemmas = spark.createDataFrame([("dogs", "dog")], "form string, lemma string")
    assert rows(term_arrays(docs, ["the"], lemmas)) == expected


def counts_of(spark, texts, *values):
    docs = texts(*values)
    doc_terms = terms.document_term_counts(tokens(docs, []))
    return docs, doc_terms, terms.total_counts(doc_terms)


def test_vocabulary_orders_by_count_then_term(spark, texts):
    _, _, counts = counts_of(spark, texts, "bb aa cc cc", "dd bb cc ee")
    expected = [("cc", 3, 0), ("bb", 2, 1), ("aa", 1, 2), ("dd", 1, 3), ("ee", 1, 4)]
    for size in (None, 3):
        found = terms.vocabulary(counts, size).orderBy("term_index").collect()
        assert [(r.term, r.n, r.term_index) for r in found] == expected[:size]


def test_corpus_counts_are_sums_of_document_counts(spark, texts, rows):
    docs, _, counts = counts_of(spark, texts, "bb aa cc cc", "dd bb cc ee", "")
    assert rows(counts) == rows(terms.term_counts(tokens(docs, [])))


@pytest.mark.parametrize("head", [0, 2, 100])
def test_bag_of_words_is_whole_with_any_head(spark, texts, rows, head):
    _, doc_terms, counts = counts_of(spark, texts, "bb aa cc cc", "dd bb cc ee")
    ranked = terms.vocabulary(counts)
    found = rows(terms.bag_of_words(doc_terms, ranked, head_terms=head))
    assert found == sorted(
        [(0, 0, 2.0), (0, 1, 1.0), (0, 2, 1.0), (1, 0, 1.0), (1, 1, 1.0), (1, 3, 1.0), (1, 4, 1.0)],
        key=repr,
    )


def test_bag_of_words_drops_terms_outside_a_capped_vocabulary(spark, texts, rows):
    _, doc_terms, counts = counts_of(spark, texts, "bb aa cc cc", "dd bb cc ee")
    ranked = terms.vocabulary(counts, 1)
    assert rows(terms.bag_of_words(doc_terms, ranked)) == [(0, 0, 2.0), (1, 0, 1.0)]


def test_vectors_are_sparse_sorted_and_there_for_empty_documents(spark, texts):
    docs, doc_terms, counts = counts_of(spark, texts, "bb aa cc cc", "", "dd bb cc ee")
    found = terms.count_vectors(docs, doc_terms, terms.vocabulary(counts))
    by_doc = {r.doc_id: r.features for r in found.collect()}
    assert {k: dict(zip(v.indices.tolist(), v.values.tolist())) for k, v in by_doc.items()} == {
        0: {0: 2.0, 1: 1.0, 2: 1.0},
        1: {},
        2: {0: 1.0, 1: 1.0, 3: 1.0, 4: 1.0},
    }
    assert {v.size for v in by_doc.values()} == {5}


def test_top_terms_break_ties_by_term(spark, texts, rows):
    _, doc_terms, _ = counts_of(spark, texts, "bb aa cc cc", "dd")
    found = terms.top_document_terms(doc_terms, 2)
    assert rows(found, "doc_id", "rank", "term") == [(0, 1, "cc"), (0, 2, "aa"), (1, 1, "dd")]


def test_counts_do_not_depend_on_the_layout(spark, texts, rows):
    values = [" ".join("ab cd ef".split()[: i % 4]) for i in range(50)]
    docs = texts(*values)
    want = Counter(w for v in values for w in v.split())
    for n in (1, 7):
        found = terms.term_counts(tokens(docs.repartition(n), []))
        assert {r.term: r.n for r in found.collect()} == want


def test_a_term_that_is_a_third_of_all_rows(spark):
    """A hot term meets the broadcast head, and its counts are whole."""
    words = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 997))
    found = spark.range(30_000).select((F.col("id") % 500).alias("doc_id"), words.alias("term"))
    doc_terms = terms.document_term_counts(found)
    ranked = terms.vocabulary(terms.total_counts(doc_terms))
    assert ranked.where("term_index = 0").head().term == "hot"
    bags = terms.bag_of_words(doc_terms, ranked, head_terms=10)
    assert bags.agg(F.sum("value")).head()[0] == 30_000
    assert bags.where("term_index = 0").agg(F.sum("value")).head()[0] == 10_000
    assert math.isclose(bags.count(), doc_terms.count())


def test_tables_are_released(spark, texts):
    import os

    from reviewlens.session import _WRITTEN, release, scratch_tables, stored

    with scratch_tables(spark):
        kept = stored(texts("a", "b"))
        path = _WRITTEN[spark.sparkContext.applicationId][0]
        assert kept.count() == 2 and os.path.exists(path)
    assert not os.path.exists(path)
    stored(texts("a"))
    assert release(spark) >= 1 and release(spark) == 0


def test_long_frequent_terms_are_looked_up(spark, rows):
    """Terms too long to be broadcast, one of them in a third of all rows."""
    word = F.when(F.col("id") % 3 == 0, F.lit("x" * 200)).otherwise(F.concat(F.lit("w"), F.col("id") % 97))
    found = spark.range(3_000).select((F.col("id") % 50).alias("doc_id"), word.alias("term"))
    doc_terms = terms.document_term_counts(found)
    ranked = terms.vocabulary(terms.total_counts(doc_terms))
    bags = terms.bag_of_words(doc_terms, ranked)
    want = doc_terms.join(ranked.drop("n"), "term").selectExpr("doc_id", "term_index", "CAST(n AS DOUBLE) AS value")
    assert rows(bags) == rows(want)

"""What the plans do, which is what decides whether they hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import catalog, terms
from reviewlens.operators.local_terms import count_document_terms, top_terms
from reviewlens.operators.mentions import chain_topics, chains, distinct_mentions, mentions, mentions_by_length
from reviewlens.operators.sentences import sentence_scores, sentences
from reviewlens.operators.tokens import tokens
from reviewlens.operators.local_opinions import chained_mentions
from reviewlens.plans.opinions import review_opinions, review_records
from reviewlens.checks.queries import QUERIES, _movies, _reviews
from reviewlens.sizing import INLINE_ROWS, cluster_by, fits_broadcast, join_dimension
from reviewlens.wordlists import ENGLISH_STOP_WORDS as STOP
from reviewlens.wordlists import PRONOUNS

FOLDER = "/root/testdata/sf0.001"
LEXICON = {"er": 1, "ha": -1}
FITS = {"lda_topics", "lda_facts", "learned_scores", "learned_classes"}
FITS |= {"learned_confusion", "lda_default_facts", "topic_table_facts", "topic_quality"}


def exchanges(plan: str) -> int:
    """Shuffles in the tree of a formatted plan."""
    tree = plan.split("\n\n")[0]
    return len(re.findall(r"[ -]Exchange \(", tree))


@pytest.fixture
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITS))
def test_no_query_leaves_the_engine_or_pairs_all_rows(spark, plan_of, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    for operator in ("CartesianProduct", "NestedLoop", "EvalPython", "InPandas", "InArrow"):
        assert operator not in plan


@pytest.mark.parametrize(
    "build",
    [
        lambda d: review_opinions(d, LEXICON),
        lambda d: review_records(d, LEXICON),
        lambda d: count_document_terms(d),
        lambda d: top_terms(d),
        lambda d: sentence_scores(sentences(d), LEXICON),
        lambda d: mentions(sentences(d)),
        lambda d: tokens(d),
    ],
)
def test_work_inside_documents_has_no_exchange(docs, plan_of, build):
    assert exchanges(plan_of(build(docs))) == 0


def test_results_can_be_filtered_without_repeating_the_analysis(docs, plan_of):
    found = review_records(docs, LEXICON).where("size(sentiments) > 1")
    plan = plan_of(found)
    assert plan.count("regexp_extract_all") == plan_of(review_records(docs, LEXICON)).count(
        "regexp_extract_all"
    )


def test_one_layout_serves_the_operators_on_mentions(docs, plan_of):
    placed = cluster_by(docs, "doc_id")
    linked = chains(mentions(sentence_scores(sentences(placed), LEXICON)))
    assert exchanges(plan_of(linked)) == 1
    counted = terms.document_term_counts(tokens(placed))
    assert exchanges(plan_of(terms.top_document_terms(counted))) == 1


def text_is_exchanged(plan: str) -> bool:
    """Whether an exchange hands on a text or sentence column."""
    for part in plan.split("\n\n"):
        if re.match(r"\(\d+\) (Exchange|BroadcastExchange)", part):
            if re.search(r"Input \[\d+\]: .*\b(text|sentence|review|said|_sentences)#", part):
                return True
    return False


@pytest.mark.parametrize(
    "build",
    [
        lambda d: terms.document_term_counts(tokens(d)),
        lambda d: terms.total_counts(count_document_terms(d)),
        lambda d: terms.top_document_terms(terms.document_term_counts(tokens(d))),
        lambda d: chained_mentions(d, STOP, PRONOUNS),
        lambda d: distinct_mentions(chained_mentions(d, STOP, PRONOUNS), chained_mentions(d, [], PRONOUNS)),
        lambda d: chain_topics(chained_mentions(d, STOP, PRONOUNS)),
        lambda d: mentions_by_length(chained_mentions(d, STOP, PRONOUNS)),
        lambda d: chained_mentions(d, STOP, PRONOUNS, lexicon=LEXICON),
        lambda d: review_opinions(d, LEXICON),
        lambda d: review_records(d, LEXICON),
        lambda d: chains(mentions(sentence_scores(sentences(d), LEXICON))),
    ],
)
def test_no_text_is_exchanged(docs, plan_of, build):
    assert not text_is_exchanged(plan_of(build(docs)))


@pytest.mark.parametrize("long", ["lexicon", "stop words", "strict"])
def test_long_lists_meet_the_text_in_one_exchange(spark, docs, plan_of, monkeypatch, long):
    lexicon, stopwords = dict(LEXICON), list(STOP)
    if long == "lexicon":
        lexicon |= {f"unseen{i}": 1 for i in range(INLINE_ROWS)}
    if long == "stop words":
        stopwords += [f"unseen{i}" for i in range(INLINE_ROWS)]
    plan = plan_of(review_opinions(docs, lexicon, stopwords, strict_initial=long == "strict"))
    texts = [
        part
        for part in plan.split("\n\n")
        if re.match(r"\(\d+\) Exchange", part) and re.search(r"Input \[\d+\]: .*\b(_?text|sentence|max)#", part)
    ]
    whole = [part for part in texts if "max" in part]
    assert len(whole) == 1
    assert not any("sentence#" in part for part in texts)


def scans(plan: str) -> int:
    """Reads of documents in the tree of a formatted plan."""
    return len(re.findall(r"Scan parquet", plan.split("\n\n")[0]))


def test_a_large_dimension_reads_the_facts_once_to_join(spark, docs, plan_of, monkeypatch):
    monkeypatch.setattr("reviewlens.sizing.BROADCAST_ROWS", 1)
    dimension = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("one"))
    found = join_dimension(docs, dimension, "doc_id")
    assert scans(plan_of(found)) == 1
    assert found.count() == 100


def test_nested_values_are_weighed(spark, monkeypatch):
    wide = spark.range(10).select("id", F.array_repeat(F.lit("x" * 100), 1_000).alias("names"))
    assert fits_broadcast(wide)
    monkeypatch.setattr("reviewlens.sizing.BROADCAST_BYTES", 1_500_000)
    assert not fits_broadcast(wide)
    assert fits_broadcast(wide.limit(1))


def test_groups_of_any_rank_are_cut_before_their_exchange(spark, plan_of):
    reviews = _reviews(spark, FOLDER)
    for k in (50, 1_000, 1_001, 50_000):
        plan = plan_of(catalog.first_reviews(reviews, k))
        assert plan.count("WindowGroupLimit") >= 2 or exchanges(plan) == 2
    found = catalog.first_reviews(reviews.repartition(7), 1_001).drop("rank")
    assert found.exceptAll(reviews).count() == 0 and found.count() == reviews.count()


def test_corpus_counts_combine_before_their_exchange(docs, plan_of):
    plan = plan_of(terms.term_counts(tokens(docs)))
    assert exchanges(plan) == 1
    assert "partial_count" in plan


def test_reviews_of_a_movie_are_filtered_in_the_scan(spark, plan_of):
    found = catalog.reviews_of_movie(_reviews(spark, FOLDER), 7, review_type="user")
    plan = plan_of(found)
    assert "EqualTo(conv_id,7)" in plan and "EqualTo(role,user)" in plan
    assert exchanges(plan_of(catalog.review_page(found))) <= 1


def test_only_used_columns_are_read(spark, plan_of):
    plan = plan_of(catalog.review_counts(_reviews(spark, FOLDER)))
    assert "ReadSchema: struct<conv_id:bigint>" in plan
    plan = plan_of(catalog.title_search(_movies(spark, FOLDER), "red").select("movie_id"))
    assert "p_retailprice" not in plan and "p_brand" not in plan


def test_groups_are_cut_before_the_exchange(spark, plan_of):
    plan = plan_of(catalog.first_reviews(_reviews(spark, FOLDER)))
    assert plan.count("WindowGroupLimit") >= 2
    assert exchanges(plan) == 1

import pytest
from pyspark.sql import functions as F

from reviewlens.functions.scores import score_label, score_severity, score_thumbs, sentiment_class
from reviewlens.operators.mentions import (
    chain_topics,
    chains,
    distinct_mentions,
    mention_scores,
    mentions,
    mentions_by_length,
    non_pronouns,
)
from reviewlens.operators.local_opinions import chained_mentions
from reviewlens.operators.local_terms import count_document_terms, top_terms
from reviewlens.operators.sentences import sentence_scores, sentences
from reviewlens.operators.tokens import term_arrays
from reviewlens.plans.learned import fit_scorer, learned_scores
from reviewlens.plans.opinions import review_opinions, review_records
from reviewlens.sizing import INLINE_ROWS
from reviewlens.wordlists import PRONOUNS
from reviewlens.sources.sinks import record_json, write_record_json

LEXICON = {"great": 2, "good": 1, "bad": -1, "awful": -2}


def split(docs):
    return [r.sentence for r in sentences(docs).orderBy("doc_id", "sent_no").collect()]


def test_sentences_end_at_marks_and_lines(texts):
    docs = texts("One. Two?! Three...\nFour\r\n\r\n \tFive ", "", "...", None)
    assert split(docs) == ["One.", "Two?!", "Three...", "Four", "Five"]


def test_sentences_are_numbered_from_one_without_the_empty(texts, rows):
    docs = texts(" \n One. \n\n Two.", "Three.")
    assert rows(sentences(docs), "doc_id", "sent_no") == [(0, 1), (0, 2), (1, 1)]


def test_outer_sentences_keep_every_document(texts, rows):
    found = sentences(texts("One.", "", None), outer=True)
    assert rows(found) == [(0, 1, "One."), (1, None, None), (2, None, None)]


SENTENCES = {
    "awful awful": 0,
    "Awful": 0,
    "bad": 1,
    "plain": 2,
    "good bad": 2,
    "good": 3,
    "great": 4,
    "great great good": 4,
    "goodness": 2,
}


@pytest.mark.parametrize("long_lexicon", [False, True])
def test_scores(spark, texts, long_lexicon):
    lexicon = dict(LEXICON)
    if long_lexicon:
        lexicon |= {f"unseen{i}": 1 for i in range(INLINE_ROWS)}
        lexicon = spark.createDataFrame(list(lexicon.items()), "term string, valence int")
    found = sentence_scores(sentences(texts(*SENTENCES)), lexicon)
    assert {r.sentence: r.score for r in found.collect()} == SENTENCES


def test_a_lexicon_frame_adds_up_repeated_terms(spark, texts):
    lexicon = spark.createDataFrame([("ok", 1), ("OK", 1)], "term string, valence int")
    assert sentence_scores(sentences(texts("ok")), lexicon).head().score == 4


def test_an_empty_lexicon_is_neutral(texts):
    assert sentence_scores(sentences(texts("good")), {}).head().score == 2


def test_names_of_scores(spark):
    scores = spark.createDataFrame([(s,) for s in (-1, 0, 1, 2, 3, 4, 5, None)], "score int")
    s = F.col("score")
    found = scores.select("score", score_label(s), score_thumbs(s), score_severity(s)).collect()
    assert [tuple(r) for r in found] == [
        (-1, "Unexpected score: -1", "Unexpected score: -1", None),
        (0, "very_negative", "down down", "danger"),
        (1, "negative", "down", "warning"),
        (2, "neutral", "up down", "default"),
        (3, "positive", "up", "success"),
        (4, "very_positive", "up up", "primary"),
        (5, "Unexpected score: 5", "Unexpected score: 5", None),
        (None, None, None, None),
    ]


def test_classes(spark):
    sums = spark.createDataFrame([(v,) for v in range(-3, 4)], "v int")
    assert [r[0] for r in sums.select(sentiment_class(F.col("v"))).collect()] == [0, 0, 1, 2, 3, 4, 4]


def found_mentions(docs, **options):
    found = mentions(sentences(docs), **options).orderBy("doc_id", "sent_no", "pos").collect()
    return [(r.mention, r.is_pronoun) for r in found]


def test_mentions_are_capitalised_runs_and_pronouns(texts):
    docs = texts("The Kevin James film with McClane and NASA; he likes Éloi, I do.")
    assert found_mentions(docs) == [
        ("The Kevin James", False),
        ("McClane", False),
        ("NASA", False),
        ("he", True),
        ("Éloi", False),
    ]


def test_a_capital_stop_word_is_no_name(texts):
    assert found_mentions(texts("The film. And yet James.")) == [("James", False)]


def test_no_mentions(texts):
    assert found_mentions(texts("nothing here", "", "?!", None)) == []


def test_strict_initial_names_must_be_known(spark, texts):
    docs = texts("Funny film by James. James is back. Kevin James left.", "Kevin sings.")
    strict = found_mentions(docs, strict_initial=True)
    assert strict == [("James", False), ("James", False), ("Kevin James", False)]
    known = spark.createDataFrame([("Funny",)], "name string")
    named = found_mentions(docs, strict_initial=True, known_names=known)
    assert named == [("Funny", False), ("James", False), ("Kevin James", False)]


def test_strict_initial_with_names_too_many_to_broadcast(monkeypatch, texts):
    docs = texts("Funny film by James. James is back. Kevin James left.", "Kevin sings.")
    few = found_mentions(docs, strict_initial=True)
    monkeypatch.setattr("reviewlens.sizing.BROADCAST_ROWS", 0)
    assert found_mentions(docs, strict_initial=True) == few


def test_long_stop_lists_for_mentions(texts):
    docs = texts("The film. And yet James. He sings.")
    listed = [f"w{i}" for i in range(INLINE_ROWS)] + ["the", "and", "he"]
    assert found_mentions(docs, stopwords=listed) == [("James", False), ("He", True)]


def keys_of(docs):
    found = chains(mentions(sentences(docs))).orderBy("doc_id", "sent_no", "pos").collect()
    return [(r.doc_id, r.mention, r.chain_key) for r in found]


def test_pronouns_follow_the_nearest_earlier_name(texts):
    docs = texts("He waits. Kevin James sings. He dances. Rose came. It ended. She left.", "She.")
    assert keys_of(docs) == [
        (0, "Kevin James", "james"),
        (0, "He", "james"),
        (0, "Rose", "rose"),
        (0, "It", "rose"),
        (0, "She", "rose"),
    ]


def test_full_and_last_name_share_a_chain(texts, rows):
    found = chain_topics(chains(mentions(sentences(texts("Kevin James sings. James stops.")))))
    assert rows(found) == [(0, "james", "James", 2, 2)]


def chain_frame(spark, *mentions_):
    rows = [(0, key, m, p, i + 1, 0) for i, (key, m, p) in enumerate(mentions_)]
    schema = "doc_id bigint, chain_key string, mention string, is_pronoun boolean, sent_no int, pos int"
    return spark.createDataFrame(rows, schema)


def test_topic_is_the_shortest_name_and_ties_go_by_order(spark, rows):
    given = chain_frame(
        spark, ("a", "Bob", False), ("a", "Abe", False), ("a", "he", True), ("p", "it", True), ("s", "Solo", False)
    )
    assert rows(chain_topics(given)) == [(0, "a", "Abe", 3, 2), (0, "s", "Solo", 1, 1)]
    assert rows(mentions_by_length(given), "chain_key", "names") == [("a", ["Abe", "Bob"]), ("s", ["Solo"])]
    assert non_pronouns(given).count() == 3


def test_union_of_mention_sets(spark):
    given = chain_frame(spark, ("a", "Bob", False), ("a", "he", True))
    assert distinct_mentions(given, given, non_pronouns(given)).count() == 2


def test_mentions_look_up_their_sentence(texts, rows):
    split_up = sentences(texts("Good James. Bad Rose."))
    found = mention_scores(
        chains(mentions(split_up, ["good", "bad"])), sentence_scores(split_up, LEXICON)
    )
    assert rows(found, "sent_no", "sentence", "score") == [(1, "Good James.", 3), (2, "Bad Rose.", 1)]


REVIEW = "James and James are good. He is bad. James and James are good. Rose is awful."


def test_opinions_are_distinct_and_pronouns_count(texts, rows):
    assert rows(review_opinions(texts(REVIEW, "", "it rains"), LEXICON)) == [
        (0, "james", "James", 1, "He is bad."),
        (0, "james", "James", 3, "James and James are good."),
        (0, "rose", "Rose", 0, "Rose is awful."),
    ]


def test_records_nest_the_same_opinions_and_keep_every_review(texts):
    docs = texts(REVIEW, "", "it rains", None)
    found = {r.doc_id: r for r in review_records(docs, LEXICON).collect()}
    assert [found[i].review for i in range(4)] == [REVIEW, "", "it rains", None]
    assert [found[i].sentiments for i in (1, 2, 3)] == [[], [], []]
    nested = [
        (s.topic, o.score, o.sentence) for s in found[0].sentiments for o in s.opinions
    ]
    assert nested == [
        ("James", 1, "He is bad."),
        ("James", 3, "James and James are good."),
        ("Rose", 0, "Rose is awful."),
    ]


def test_record_json(spark, texts, tmp_path):
    records = review_records(texts("Rose is awful."), LEXICON)
    expected = (
        '{"review":"Rose is awful.","sentiments":[{"topic":"Rose",'
        '"opinions":[{"score":0,"sentence":"Rose is awful."}]}]}'
    )
    assert record_json(records).head().json == expected
    write_record_json(records, str(tmp_path / "records"))
    assert [r.value for r in spark.read.text(str(tmp_path / "records")).collect()] == [expected]


def test_several_key_columns_and_layouts(spark, texts, rows):
    docs = texts(*[REVIEW] * 20).withColumn("movie_id", F.col("doc_id") % 3)
    keys = ("movie_id", "doc_id")
    found = [rows(review_opinions(docs.repartition(n), LEXICON, keys=keys)) for n in (1, 7)]
    assert found[0] == found[1]
    assert len(found[0]) == 60


def test_scorer_in_place_of_a_lexicon(spark, texts, rows):
    labelled = spark.createDataFrame(
        [("good great fun", 1), ("fine good", 1), ("bad awful", 0), ("awful mess", 0)] * 5,
        "sentence string, score int",
    )
    model = fit_scorer(labelled, features=1 << 10)
    found = review_opinions(
        texts("Rose is awful. James is good."), scorer=lambda df: learned_scores(model, df)
    )
    assert rows(found, "topic", "score") == [("James", 1), ("Rose", 0)]


def test_lexicon_or_scorer(texts):
    with pytest.raises(ValueError):
        review_opinions(texts("x"))


def test_every_topic_is_a_name_of_its_chain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = review_opinions(docs, LEXICON)
    names = non_pronouns(chains(mentions(sentences(docs)))).select(
        "doc_id", "chain_key", F.col("mention").alias("topic")
    )
    assert found.join(names, ["doc_id", "chain_key", "topic"], "left_anti").count() == 0
    assert found.where("score NOT BETWEEN 0 AND 4").count() == 0


AWKWARD = [
    (1, "Tom is good. He is bad. Tom is good."),
    (1, "Rose is GREAT. It is awful."),
    (1, "Rose is GREAT. It is awful."),
    (None, "Ann is odd. Ann is Good."),
    (None, None),
    (2, None),
    (2, ""),
    (3, "no names here"),
    (4, "The Tom Rose\nTom Rose good bad. She great. It. He odd awful!"),
]
ODD_LEXICON = [("Good", 1), ("good", 1), ("bad", -1), ("odd", None), (None, 3), ("AWFUL", -2), ("great", 2)]


def awkward_lists(spark, long):
    """A lexicon as frame and as dictionary, and stop words, just within the bound or beyond it."""
    more = INLINE_ROWS if long else INLINE_ROWS - 10
    filler = [f"unseen{i}" for i in range(more)]
    frame = spark.createDataFrame(ODD_LEXICON + [(w, 1) for w in filler], "term string, valence int")
    mapping = {t: v for t, v in ODD_LEXICON} | dict.fromkeys(filler, 1)
    return frame, mapping, ["the", "no", "she", *filler]


@pytest.mark.parametrize("which", ["frame", "mapping", "stop words"])
def test_lists_on_either_side_of_the_bound_agree(spark, rows, which):
    docs = spark.createDataFrame(AWKWARD, "doc_id bigint, text string")
    found = []
    for long in (False, True):
        frame, mapping, stop = awkward_lists(spark, long)
        lexicon = {"frame": frame, "mapping": mapping}.get(which, dict(LEXICON))
        listed = stop if which == "stop words" else ["the", "no", "she"]
        records = review_records(docs, lexicon, listed)
        found.append(
            (
                rows(review_opinions(docs, lexicon, listed)),
                rows(records),
                rows(sentence_scores(sentences(docs), lexicon)),
                rows(count_document_terms(docs, listed)),
                rows(top_terms(docs, 2, listed)),
                rows(term_arrays(docs, listed)),
            )
        )
    assert found[0] == found[1]
    assert len(found[0][1]) == len(AWKWARD)
    assert rows(review_opinions(docs, LEXICON, by_mention=True)) == rows(review_opinions(docs, LEXICON))
    assert rows(review_records(docs, LEXICON, by_mention=True)) == rows(review_records(docs, LEXICON))


def long_text():
    """Two million characters without a mark: one sentence of 200,000 names."""
    return " ".join(f"Aa{chr(97 + i % 20)}xyz xx" for i in range(200_000))


@pytest.mark.parametrize("by_mention", [False, True])
def test_a_long_sentence_of_many_names(texts, by_mention):
    docs = texts(long_text())
    found = review_opinions(docs, LEXICON, by_mention=by_mention)
    assert sorted(r.topic for r in found.select("topic").collect()) == sorted(f"Aa{chr(97 + i)}xyz" for i in range(20))
    record = review_records(docs, LEXICON, by_mention=by_mention).select(F.size("sentiments")).head()
    assert record[0] == 20
    assert chained_mentions(docs, [], PRONOUNS).count() == 200_000

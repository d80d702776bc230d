"""Registered queries: each runs one or more operators over whole given tables.

Roles of the tables: ``documents`` is the corpus of texts, ``conversations`` are
reviews (``conv_id`` the movie, ``turn`` the review, ``role`` critic and review
type, ``text`` the quote), ``part`` is the catalogue of movies, ``events`` holds
JSON text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.functions.catalog import synopsis_or_default
from reviewlens.functions.scores import score_label, score_severity, score_thumbs
from reviewlens.operators import catalog, terms
from reviewlens.operators.local_terms import count_document_terms, top_terms
from reviewlens.operators.local_opinions import chained_mentions
from reviewlens.operators.mentions import (
    chain_topics,
    distinct_mentions,
    mention_scores,
    mentions,
    mentions_by_length,
)
from reviewlens.operators.pages import write_pages
from reviewlens.operators.ranking import number_rows, page
from reviewlens.operators.sentences import sentence_scores, sentences
from reviewlens.operators.title_index import write_title_index
from reviewlens.operators.tokens import tokens
from reviewlens.plans import learned, opinions, search, topic_table, topics
from reviewlens.session import shared_folder, stored
from reviewlens.sources.buckets import write_review_buckets
from reviewlens.sources.payloads import PAGE_SIZE, parse_movies, parse_reviews
from reviewlens.sources.sinks import record_json, write_topics
from reviewlens.sources.texts import (
    clean_lines,
    documents_from_rows,
    read_documents,
    read_stop_words,
    read_text_corpus,
)
from reviewlens.streaming.opinions import (
    finish,
    read_opinions,
    read_review_stream,
    start_opinions,
)
from reviewlens.wordlists import ENGLISH_STOP_WORDS, PRONOUNS

# Parameters shared with the SQL.
LEXICON = {"er": 1, "es": 1, "ha": -1, "en": -1, "rewh": -2, "orre": 2, "worthless": -2}
SEARCH = "Red wid"
MOVIE = 7
REVIEWER = "assistant"
REVIEWS_PER_MOVIE = 2
TOP_TERMS = 5
CAPPED_VOCABULARY = 1000
SEARCHES = ["Red wid", " \t", "blue", "no such title"]
LAST_SEEN, NEAR_THE_END = (1975, 300), (1951, 0)
TRAINING_SENTENCES = 20_000
AGREEMENT = 0.8
SENTENCES_PER_CLASS = 4_000
BALANCED_ACCURACY = 0.45
QUALITY_PASSES, QUALITY_STEPS = 10, 6
STREAM_FILES = 4
INDEXED_SEARCHES = ["Red wid", "b", "BLUE red", "dget", "ed", "xyzzy red", " "]
DEEP_PAGE = 3

Query = Callable[[SparkSession, str], DataFrame]


def _corpus(spark: SparkSession, sf: str, per_document: bool = False) -> DataFrame:
    return read_documents(spark, f"{sf}/documents.parquet", per_document=per_document)


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _movies(spark: SparkSession, sf: str) -> DataFrame:
    synopsis = (
        F.when(F.col("p_type") == "SMALL", F.lit(None))
        .when(F.col("p_type") == "ECONOMY", F.lit(""))
        .otherwise(F.concat_ws(" ", "p_brand", "p_type"))
    )
    return spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_partkey").alias("movie_id"),
        (F.col("p_size") + 1950).alias("year"),
        F.col("p_name").alias("title"),
        synopsis.alias("synopsis"),
    )


def _reviews(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet").select(
        F.col("conv_id").alias("movie_id"),
        F.col("turn").alias("review_id"),
        F.col("role").alias("critic"),
        F.col("text").alias("quote"),
        F.col("role").alias("review_type"),
        F.when(F.col("turn") % 3 == 2, "ca").otherwise("us").alias("country"),
    )


def _movie_payloads(spark: SparkSession, sf: str, year) -> DataFrame:
    """The catalogue as landed answers of at most a page of movies each."""
    element = F.struct(
        F.col("movie_id").cast("string").alias("id"), "title", year.alias("year"), "synopsis"
    )
    pages = _movies(spark, sf).withColumn("page", F.floor(F.col("movie_id") / PAGE_SIZE))
    grouped = pages.groupBy("page").agg(
        F.sort_array(F.collect_list(F.struct("movie_id", element.alias("element"))))
        .getField("element")
        .alias("movies")
    )
    return grouped.select("page", F.to_json(F.struct("movies")).alias("value"))


def _years_with_faults():
    return F.when(F.col("synopsis").isNull(), F.lit("")).otherwise(F.col("year").cast("string"))


# Terms


def corpus_term_counts(spark, sf):
    return terms.term_counts(tokens(_corpus(spark, sf)))


def symbol_term_counts(spark, sf):
    return terms.term_counts(tokens(_corpus(spark, sf), lowercase=False, symbols=True))


def lemma_term_counts(spark, sf):
    corpus = _corpus(spark, sf)
    words = tokens(corpus).select("term").where(F.length("term") > 2).distinct()
    plurals = words.where(F.col("term").endswith("s"))
    lemma = F.expr("left(term, length(term) - 1)")
    lemmas = plurals.select(F.col("term").alias("form"), lemma.alias("lemma"))
    return terms.term_counts(tokens(corpus, lemmas=lemmas))


def long_lemma_term_counts(spark, sf):
    """A lemma for every word of the corpus: a table above the bound of a broadcast."""
    corpus = _corpus(spark, sf)
    words = tokens(corpus).select("term").distinct()
    plural = F.col("term").endswith("s") & (F.length("term") > 2)
    lemma = F.when(plural, F.expr("left(term, length(term) - 1)")).otherwise(F.col("term"))
    lemmas = words.select(F.col("term").alias("form"), lemma.alias("lemma"))
    return terms.term_counts(tokens(corpus, lemmas=lemmas))


def token_positions(spark, sf):
    return tokens(_corpus(spark, sf))


def doc_term_counts(spark, sf):
    return count_document_terms(_corpus(spark, sf)).withColumn("length", F.length("term"))


def doc_term_counts_grouped(spark, sf):
    counted = terms.document_term_counts(tokens(_corpus(spark, sf, per_document=True)))
    return counted.withColumn("length", F.length("term"))


def total_counts(spark, sf):
    return terms.total_counts(count_document_terms(_corpus(spark, sf)))


def vocabulary_rank(spark, sf):
    return terms.vocabulary(terms.term_counts(tokens(_corpus(spark, sf))))


def vocabulary_size(spark, sf):
    counts = terms.term_counts(tokens(_corpus(spark, sf)))
    return counts.agg(F.count("term").alias("n_terms"), F.sum("n").alias("n_tokens"))


def bag_of_words_long(spark, sf):
    corpus = _corpus(spark, sf)
    ranked = terms.vocabulary(terms.term_counts(tokens(corpus)))
    return terms.bag_of_words(count_document_terms(corpus), ranked)


def bag_of_words_capped(spark, sf):
    corpus = _corpus(spark, sf)
    ranked = terms.vocabulary(terms.term_counts(tokens(corpus)), CAPPED_VOCABULARY)
    return terms.bag_of_words(count_document_terms(corpus), ranked)


def count_vectors(spark, sf):
    docs = _corpus(spark, sf)
    ranked = terms.vocabulary(terms.term_counts(tokens(docs)))
    vectors = terms.count_vectors(docs, count_document_terms(docs), ranked)
    # A vector as JSON is {"type", "size", "indices", "values"}.
    fields = F.from_json(
        F.to_json(F.struct("features")),
        "features struct<size int, indices array<int>, values array<double>>",
    )
    return vectors.select("doc_id", fields["features"].alias("v")).select(
        "doc_id",
        F.col("v.size").alias("size"),
        F.array_join("v.indices", " ").alias("indices"),
        F.array_join(F.col("v.values").cast("array<int>"), " ").alias("counts"),
    )


def topk_terms_per_doc(spark, sf):
    return top_terms(_corpus(spark, sf), TOP_TERMS)


def topk_terms_ranked(spark, sf):
    counted = terms.document_term_counts(tokens(_corpus(spark, sf, per_document=True)))
    return terms.top_document_terms(counted, TOP_TERMS)


def corpus_lines(spark, sf):
    lines = _corpus(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return clean_lines(lines)


def stop_words_file(spark, sf):
    """All texts as files of words, read back as a list of words."""
    path = _folder(spark, "words")
    _corpus(spark, sf).select("text").where("text IS NOT NULL").write.text(path)
    return read_stop_words(spark, path)


def text_corpus(spark, sf):
    """All texts as files of lines, read back as numbered documents: each line, how often, and
    whether the numbers are 0 and on without a gap."""
    path = _folder(spark, "lines")
    _corpus(spark, sf).select("text").where("text IS NOT NULL").write.text(path)
    read = read_text_corpus(spark, path)
    n, distinct, first, last = read.agg(
        F.count("doc_id"), F.count_distinct("doc_id"), F.min("doc_id"), F.max("doc_id")
    ).head()
    gapless = n == distinct and (n == 0 or (first == 0 and last == n - 1))
    return read.groupBy("text").agg(F.count(F.lit(1)).alias("n")).withColumn("gapless", F.lit(gapless))


def rows_in_memory(spark, sf):
    """The benchmark's texts numbered from 0 by item, on Spark; none passes through the driver."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    return number_rows(items, "item_id", index="doc_id").select("doc_id", "text")


def page_in_memory(spark, sf):
    """The titles of a page of movies, held by the caller, as documents again: the words of each."""
    shown = page(_movies(spark, sf), *catalog.newest_first(), size=PAGE_SIZE).collect()
    return tokens(documents_from_rows(spark, [movie.title for movie in shown]))


def document_numbers(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("source", "doc_id")
    return number_rows(table, "source", "doc_id")


# Sentences, mentions, opinions


def _chained(spark, sf, stopwords=ENGLISH_STOP_WORDS, lexicon=None):
    return chained_mentions(_corpus(spark, sf), stopwords, PRONOUNS, lexicon=lexicon)


def _long_lexicon(spark, sf):
    """A valence for every term of the corpus."""
    words = tokens(_corpus(spark, sf)).select("term").distinct()
    return words.withColumn("valence", (F.length("term") % 5 - 2).cast("int"))


def all_sentences(spark, sf):
    return sentences(_corpus(spark, sf))


def scored_sentences(spark, sf):
    score = F.col("score")
    return sentence_scores(sentences(_corpus(spark, sf)), LEXICON).select(
        "doc_id",
        "sent_no",
        "score",
        score_label(score).alias("label"),
        score_thumbs(score).alias("thumbs"),
        score_severity(score).alias("severity"),
    )


def score_counts(spark, sf):
    scored = sentence_scores(sentences(_corpus(spark, sf)), LEXICON)
    return scored.groupBy("score").agg(F.count(F.lit(1)).alias("n_sentences"))


def all_mentions(spark, sf):
    return mentions(sentences(_corpus(spark, sf)))


def strict_mentions(spark, sf):
    return mentions(sentences(_corpus(spark, sf)), strict_initial=True)


def mention_chains(spark, sf):
    return _chained(spark, sf)


def chain_mention_sets(spark, sf):
    """Chains with and without a stop list: most mentions are in both."""
    return distinct_mentions(_chained(spark, sf), _chained(spark, sf, stopwords=[]))


def all_chain_topics(spark, sf):
    return chain_topics(_chained(spark, sf))


def chain_names(spark, sf):
    listed = mentions_by_length(_chained(spark, sf))
    return listed.withColumn("names", F.array_join("names", "|"))


def scored_mentions(spark, sf):
    return _chained(spark, sf, lexicon=LEXICON)


def scored_mentions_joined(spark, sf):
    scored = sentence_scores(sentences(_corpus(spark, sf)), LEXICON)
    return mention_scores(_chained(spark, sf), scored)


def opinions_flat(spark, sf):
    return opinions.review_opinions(_corpus(spark, sf), LEXICON)


def opinions_from_mentions(spark, sf):
    return opinions.review_opinions(_corpus(spark, sf), LEXICON, by_mention=True)


def opinions_strict(spark, sf):
    return opinions.review_opinions(_corpus(spark, sf), LEXICON, strict_initial=True)


def opinions_long_lexicon(spark, sf):
    return opinions.review_opinions(_corpus(spark, sf), _long_lexicon(spark, sf))


def sentence_scores_long_lexicon(spark, sf):
    found = sentence_scores(sentences(_corpus(spark, sf)), _long_lexicon(spark, sf))
    return found.select("doc_id", "sent_no", "score")


def opinions_nested_json(spark, sf):
    return record_json(opinions.review_records(_corpus(spark, sf), LEXICON))


def records_from_mentions(spark, sf):
    return record_json(opinions.review_records(_corpus(spark, sf), LEXICON, by_mention=True))


def learned_classes(spark, sf):
    """Five classes learned from sentences that the lexicon classed: are they classes, and do
    they agree with it? At most ``TRAINING_SENTENCES`` are learned from, all are classed."""
    scored = sentence_scores(sentences(_corpus(spark, sf)), LEXICON)
    some = scored.orderBy(F.xxhash64("doc_id", "sent_no"), "doc_id", "sent_no").limit(TRAINING_SENTENCES)
    model = learned.fit_scorer(some, features=1 << 14)
    both = learned.learned_scores(model, scored.withColumnRenamed("score", "given"))
    share = both.agg(F.avg((F.col("given") == F.col("score")).cast("int"))).head()[0] or 0.0
    in_range = F.col("score").between(0, 4).alias("in_range")
    return both.select("doc_id", "sent_no", in_range, F.lit(share >= AGREEMENT).alias("agrees"))


def _held_out():
    """Which documents a model is judged on: it learns from the others."""
    return F.col("doc_id") % 5 == 0


def learned_confusion(spark, sf):
    """Five classes learned with equal weight and judged on documents held out of it: for each
    class its sentences there, and whether the mean recall is above a bound that a constant
    answer, which has a fifth, cannot reach. At most ``SENTENCES_PER_CLASS`` of each class
    are learned from, by a seeded hash; all held-out sentences are classed."""
    scored = sentence_scores(sentences(_corpus(spark, sf)), LEXICON)
    some = learned.stratified(scored.where(~_held_out()), SENTENCES_PER_CLASS)
    model = learned.fit_scorer(some, features=1 << 16, max_iter=60, reg=1e-4, balanced=True)
    given = scored.where(_held_out()).withColumnRenamed("score", "given")
    matrix = stored(learned.confusion(learned.learned_scores(model, given)))
    reached = learned.balanced_accuracy(matrix) >= BALANCED_ACCURACY
    return learned.recalls(matrix).select("given", "n", F.lit(reached).alias("balanced"))


def learned_scores(spark, sf):
    docs = _corpus(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("score"))
    labelled = docs.withColumnRenamed("text", "sentence").join(labels, "doc_id")
    model = learned.fit_scorer(labelled, features=1 << 18)
    return learned.learned_scores(model, sentences(docs)).drop("sentence")


def lda_topics(spark, sf):
    return topics.discover_topics(_corpus(spark, sf)).topics()


def lda_facts(spark, sf):
    """What must hold of any fit, from the topic table as it was written."""
    model = topics.discover_topics(_corpus(spark, sf), optimizer="online")
    path = _folder(spark, "topics")
    write_topics(model.topics(), path)
    table = spark.read.parquet(path)
    listed = table.join(model.vocabulary.select("term", F.lit(1).alias("known")), "term", "left")
    weights = F.sort_array(F.collect_list(F.struct("rank", "weight")))["weight"]
    found = listed.groupBy("topic").agg(
        F.count("term").alias("n_terms"),
        F.array_join(F.sort_array(F.collect_list("rank")), " ").alias("ranks"),
        weights.alias("weights"),
        (F.count("known") == F.count(F.lit(1))).alias("known"),
        F.sum("weight").between(0, 1).alias("bounded"),
    )
    falling = F.col("weights") == F.sort_array("weights", asc=False)
    return found.select("topic", "n_terms", "ranks", falling.alias("falling"), "known", "bounded")


def lda_default_facts(spark, sf):
    """What must hold of a fit with the default settings, each term looked up again: does the
    index that the vocabulary gives it, counted afresh, stand at its rank in the model?"""
    docs = _corpus(spark, sf)
    model = topics.discover_topics(docs)
    described = model.model.describeTopics(topics.TERMS_PER_TOPIC)
    fresh = terms.vocabulary(terms.term_counts(tokens(docs)))
    found = model.topics().join(fresh.select("term", "term_index"), "term")
    found = found.join(F.broadcast(described.withColumn("topic", F.col("topic") + 1)), "topic")
    at = F.col("rank") - 1
    same = (F.get("termIndices", at) == F.col("term_index")) & (F.get("termWeights", at) == F.col("weight"))
    return found.groupBy("topic").agg(
        F.count("term").alias("n_terms"),
        F.array_join(F.sort_array(F.collect_list("rank")), " ").alias("ranks"),
        F.every(F.coalesce(same, F.lit(False))).alias("looked_up"),
        F.sum("weight").between(0, 1).alias("bounded"),
    )


def topic_table_facts(spark, sf):
    """The same of topics held as a table, whose weights are of all terms: is each term, by the
    index of a fresh count, one that only so many others of the topic exceed as its rank says?"""
    docs = _corpus(spark, sf)
    table = topic_table.discover_topic_table(docs, steps=QUALITY_STEPS)
    fresh = terms.vocabulary(terms.term_counts(tokens(docs)))
    each = table.probabilities().select("term_index", F.posexplode("probs").alias("topic", "prob"))
    each = each.select(F.col("topic") + 1, "term_index", "prob").toDF("topic", "term_index", "prob")
    found = stored(table.topics().join(fresh.select("term", "term_index"), "term"))
    least = found.groupBy("topic").agg(F.min("weight").alias("least"))
    above = each.join(F.broadcast(least), "topic").where("prob >= least")
    rank = F.rank().over(Window.partitionBy("topic").orderBy(F.desc("prob"), "term_index"))
    above = above.select("topic", "term_index", rank.alias("rank"), "prob")
    met = found.join(above, ["topic", "term_index", "rank"], "left")
    summed = each.groupBy("topic").agg(F.count(F.lit(1)).alias("n_weights"), F.sum("prob").alias("whole"))
    facts = met.groupBy("topic").agg(
        F.count("term").alias("n_terms"), F.every(F.coalesce(F.col("prob") == F.col("weight"), F.lit(False))).alias("looked_up")
    )
    whole = F.abs(F.col("whole") - 1) < 1e-4
    return facts.join(summed, "topic").select("topic", "n_terms", "looked_up", "n_weights", whole.alias("whole"))


def topic_quality(spark, sf):
    """Do topics foretell documents that they were not fitted on better than the counts of words
    do, and does the same seed give the same topics? By both ways to fit them; ``n_documents``
    are the held-out documents with a word that the others have."""
    docs = _corpus(spark, sf)
    fitted_on, judged_on = docs.where(~_held_out()), docs.where(_held_out())
    rows = []
    for way in ("em", "table"):

        def fit():
            if way == "em":
                model = topics.discover_topics(fitted_on, max_iter=QUALITY_PASSES)
                return model, topic_table.model_probabilities(model)
            model = topic_table.discover_topic_table(fitted_on, steps=QUALITY_STEPS)
            return model, model.probabilities()

        (model, probabilities), (again, _) = fit(), fit()
        bags = stored(terms.bag_of_words(count_document_terms(judged_on), model.vocabulary))
        scores = topic_table.held_out_scores(bags, probabilities, model.vocabulary)
        of_topics, of_words = topic_table.perplexities(scores)
        first, second = (
            sorted(tuple(r) for r in m.topics().select("topic", "rank", "term").collect()) for m in (model, again)
        )
        n_documents = bags.select("doc_id").distinct().count()
        rows.append((way, n_documents, of_topics < of_words, first == second))
    return spark.createDataFrame(rows, "way string, n_documents bigint, beats_words boolean, same_again boolean")


def stream_opinions(spark, sf):
    """Conversations land in several files, one to a batch."""
    run = _folder(spark, "stream-opinions")
    landed = spark.read.parquet(f"{sf}/conversations.parquet")
    landed.repartition(STREAM_FILES, "conv_id").write.parquet(f"{run}/landed")
    arriving = read_review_stream(spark, f"{run}/landed", landed.schema, "parquet", 1, names="*.parquet")
    reviews = arriving.selectExpr("conv_id AS movie_id", "turn AS review_id", "text")
    keys = ("movie_id", "review_id")
    finish(start_opinions(reviews, f"{run}/sink", f"{run}/progress", LEXICON, keys=keys))
    return read_opinions(spark, f"{run}/sink").drop("batch_id")


# Catalogue


def title_search(spark, sf):
    return search.search_movies(_movies(spark, sf), SEARCH)


def title_matches(spark, sf):
    return catalog.title_search(_movies(spark, sf), SEARCH)


def indexed_searches(spark, sf):
    """Several searches by an index of grams that is written first."""
    index = write_title_index(_movies(spark, sf), _folder(spark, "titles"))
    found = [index.search(query).withColumn("query", F.lit(query)) for query in INDEXED_SEARCHES]
    return reduce(DataFrame.unionByName, found)


def written_page(spark, sf):
    """A page of all movies from a list that is written first, without the pages before it."""
    return write_pages(_movies(spark, sf), _folder(spark, "pages"), *catalog.newest_first()).page(DEEP_PAGE, PAGE_SIZE)


def second_page(spark, sf):
    return search.search_movies(_movies(spark, sf), SEARCH.split()[0], number=2)


def blank_search(spark, sf):
    return search.search_movies(_movies(spark, sf), "  ")


def several_searches(spark, sf):
    return search.search_many(_movies(spark, sf), SEARCHES)


def deep_page(spark, sf):
    return search.search_after(_movies(spark, sf), SEARCH.split()[0], *LAST_SEEN)


def last_page(spark, sf):
    return search.search_after(_movies(spark, sf), SEARCH.split()[0], *NEAR_THE_END)


def search_response(spark, sf):
    return search.search_response(_movies(spark, sf), SEARCH)


def movies_by_year(spark, sf):
    return page(_movies(spark, sf), *catalog.newest_first(), size=PAGE_SIZE)


def movie_synopses(spark, sf):
    return _movies(spark, sf).withColumn("synopsis", synopsis_or_default(F.col("synopsis")))


def reviews_of_movie(spark, sf):
    found = catalog.reviews_of_movie(_reviews(spark, sf), MOVIE, review_type=REVIEWER)
    return catalog.review_page(found)


def first_reviews(spark, sf):
    return catalog.first_reviews(_reviews(spark, sf), REVIEWS_PER_MOVIE)


def first_page_of_reviews(spark, sf):
    return catalog.first_reviews(_reviews(spark, sf))


def review_counts(spark, sf):
    return catalog.review_counts(_reviews(spark, sf))


def movie_reviews_join(spark, sf):
    movies = _movies(spark, sf).withColumn("synopsis", synopsis_or_default(F.col("synopsis")))
    return catalog.join_reviews(movies, _reviews(spark, sf))


def _buckets(spark, sf):
    folder = _folder(spark, "buckets")
    return write_review_buckets(_movies(spark, sf), _reviews(spark, sf), f"t{uuid.uuid4().hex}", folder)


def bucketed_join(spark, sf):
    return _buckets(spark, sf).joined()


def bucketed_counts(spark, sf):
    return _buckets(spark, sf).counts()


def append_reviews(spark, sf):
    reviews = _reviews(spark, sf)
    by_user = F.coalesce(F.col("critic") == "user", F.lit(False))
    return catalog.append_reviews(reviews.where(by_user), reviews.where(~by_user))


# JSON


def movies_json_roundtrip(spark, sf):
    return parse_movies(_movie_payloads(spark, sf, F.col("year"))).rows


def movies_json_with_faults(spark, sf):
    return parse_movies(_movie_payloads(spark, sf, _years_with_faults())).rows


def movies_json_quarantine(spark, sf):
    faulty = parse_movies(_movie_payloads(spark, sf, _years_with_faults())).quarantine
    broken = parse_movies(_events_as_payloads(spark, sf)).quarantine
    return faulty.unionByName(broken).drop("raw")


def _events_as_payloads(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(
        (-F.col("event_id") - 1).alias("page"), F.col("props").alias("value")
    )


def reviews_json_roundtrip(spark, sf):
    reviews = _reviews(spark, sf).withColumn("page", F.floor(F.col("review_id") / PAGE_SIZE) + 1)
    element = F.struct("review_id", F.struct("critic", "quote").alias("element"))
    grouped = reviews.groupBy("movie_id", "page").agg(
        F.sort_array(F.collect_list(element)).getField("element").alias("reviews")
    )
    payloads = grouped.select("movie_id", "page", F.to_json(F.struct("reviews")).alias("value"))
    return parse_reviews(payloads).rows.drop("page")


def event_props(spark, sf):
    props = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "props")
    parsed = F.from_json("props", "k int")
    return props.select(
        "event_id",
        parsed.getField("k").alias("k"),
        F.get_json_object("props", "$.k").alias("k_text"),
    )


QUERIES: dict[str, Query] = {
    "corpus_term_counts": corpus_term_counts,
    "symbol_term_counts": symbol_term_counts,
    "lemma_term_counts": lemma_term_counts,
    "long_lemma_term_counts": long_lemma_term_counts,
    "token_positions": token_positions,
    "doc_term_counts": doc_term_counts,
    "doc_term_counts_grouped": doc_term_counts_grouped,
    "total_counts": total_counts,
    "vocabulary_rank": vocabulary_rank,
    "vocabulary_size": vocabulary_size,
    "bag_of_words_long": bag_of_words_long,
    "bag_of_words_capped": bag_of_words_capped,
    "count_vectors": count_vectors,
    "topk_terms_per_doc": topk_terms_per_doc,
    "topk_terms_ranked": topk_terms_ranked,
    "corpus_lines": corpus_lines,
    "stop_words_file": stop_words_file,
    "text_corpus": text_corpus,
    "rows_in_memory": rows_in_memory,
    "page_in_memory": page_in_memory,
    "document_numbers": document_numbers,
    "sentences": all_sentences,
    "sentence_scores": scored_sentences,
    "score_counts": score_counts,
    "mentions": all_mentions,
    "mentions_strict": strict_mentions,
    "mention_chains": mention_chains,
    "chain_mention_sets": chain_mention_sets,
    "chain_topics": all_chain_topics,
    "chain_names": chain_names,
    "scored_mentions": scored_mentions,
    "scored_mentions_joined": scored_mentions_joined,
    "opinions_flat": opinions_flat,
    "opinions_from_mentions": opinions_from_mentions,
    "records_from_mentions": records_from_mentions,
    "opinions_strict": opinions_strict,
    "opinions_long_lexicon": opinions_long_lexicon,
    "sentence_scores_long_lexicon": sentence_scores_long_lexicon,
    "opinions_nested_json": opinions_nested_json,
    "learned_scores": learned_scores,
    "learned_classes": learned_classes,
    "learned_confusion": learned_confusion,
    "lda_topics": lda_topics,
    "lda_facts": lda_facts,
    "lda_default_facts": lda_default_facts,
    "topic_table_facts": topic_table_facts,
    "topic_quality": topic_quality,
    "stream_opinions": stream_opinions,
    "title_search": title_search,
    "title_matches": title_matches,
    "indexed_searches": indexed_searches,
    "written_page": written_page,
    "second_page": second_page,
    "blank_search": blank_search,
    "several_searches": several_searches,
    "deep_page": deep_page,
    "last_page": last_page,
    "search_response": search_response,
    "movies_by_year": movies_by_year,
    "movie_synopses": movie_synopses,
    "reviews_of_movie": reviews_of_movie,
    "first_reviews": first_reviews,
    "first_page_of_reviews": first_page_of_reviews,
    "review_counts": review_counts,
    "movie_reviews_join": movie_reviews_join,
    "bucketed_join": bucketed_join,
    "bucketed_counts": bucketed_counts,
    "append_reviews": append_reviews,
    "movies_json_roundtrip": movies_json_roundtrip,
    "movies_json_with_faults": movies_json_with_faults,
    "movies_json_quarantine": movies_json_quarantine,
    "reviews_json_roundtrip": reviews_json_roundtrip,
    "event_props": event_props,
}

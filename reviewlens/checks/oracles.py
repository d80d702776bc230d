"""The registered queries again, written from their definitions in DuckDB SQL."""

from __future__ import annotations

from reviewlens.checks.queries import (
    CAPPED_VOCABULARY,
    DEEP_PAGE,
    INDEXED_SEARCHES,
    LAST_SEEN,
    LEXICON,
    MOVIE,
    NEAR_THE_END,
    REVIEWER,
    REVIEWS_PER_MOVIE,
    SEARCH,
    SEARCHES,
    TOP_TERMS,
)

# Fixed values, written out again so that the SQL can disagree with the package.
SENTENCE = r"[^.!?\r\n]+[.!?]*"
WORD = r"\p{L}+"
WORD_OR_SYMBOLS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
MENTION = r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*|\p{L}+"
CAPITALISED = r"^\p{Lu}\p{L}"
LABELS = ["very_negative", "negative", "neutral", "positive", "very_positive"]
THUMBS = ["down down", "down", "up down", "up", "up up"]
SEVERITIES = ["danger", "warning", "default", "success", "primary"]
PAGE_SIZE = 50
PRONOUNS = "he she it they him her them his its their".split()
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom this
that these those am is are was were be been being have has had having do does did doing a an
the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now ll d m re ve isn aren wasn
weren haven hasn hadn doesn didn won wouldn shan shouldn mustn couldn cannot could let ought
would
""".split()


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


STOP, PRONOUN = _in(ENGLISH_STOP_WORDS), _in(PRONOUNS)
LEXICON_ROWS = ", ".join(f"('{term}', {valence})" for term, valence in LEXICON.items())


def _class_names(column: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {column} {whens} END"


def _tokens(text: str = "lower(text)", pattern: str = WORD) -> str:
    return f"""
  words AS (SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos
            FROM (SELECT doc_id, regexp_extract_all({text}, '{pattern}') AS ws FROM documents)),
  tokens AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, term FROM words
             WHERE length(term) > 1 AND term NOT IN {STOP})"""


TOKENS = _tokens()
DOC_TERMS = f"""{TOKENS},
  doc_terms AS (SELECT doc_id, term, count(*) AS n FROM tokens GROUP BY ALL)"""
COUNTS = f"""{TOKENS},
  counts AS (SELECT term, count(*) AS n FROM tokens GROUP BY term)"""
RANKED = f"""{COUNTS},
  ranked AS (SELECT term, n, row_number() OVER (ORDER BY n DESC, term) - 1 AS term_index FROM counts)"""


def _opinions(
    docs: str, keys: str, strict: bool = False, stop: str = STOP, lexicon: str = f"VALUES {LEXICON_ROWS}"
) -> str:
    """CTEs from texts to opinions; ``docs`` selects the keys and ``text``."""
    on = " AND ".join(f"h.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    names = f"""
  inside AS (SELECT DISTINCT lower(word) AS name FROM (
               SELECT pos, unnest(string_split(mention, ' ')) AS word,
                      generate_subscripts(string_split(mention, ' '), 1) AS nth
               FROM candidates WHERE NOT is_pronoun)
             WHERE pos > 0 OR nth > 1),
  mentions AS (SELECT * FROM candidates
               WHERE is_pronoun OR pos > 0 OR contains(mention, ' ')
                     OR lower(mention) IN (SELECT name FROM inside))"""
    chosen = names if strict else "\n  mentions AS (SELECT * FROM candidates)"
    return f"""
  docs AS ({docs}),
  split AS (SELECT {keys}, list_filter(
              list_transform(regexp_extract_all(text, '{SENTENCE}'), lambda s: trim(s, ' ' || chr(9))),
              lambda s: s <> '') AS ss
            FROM docs),
  sentences AS (SELECT {keys}, CAST(generate_subscripts(ss, 1) AS INTEGER) AS sent_no,
                       unnest(ss) AS sentence FROM split),
  lexicon(term, valence) AS ({lexicon}),
  hits AS (SELECT {keys}, sent_no, sum(valence) AS v
           FROM (SELECT {keys}, sent_no, unnest(regexp_extract_all(lower(sentence), '{WORD}')) AS term
                 FROM sentences) JOIN lexicon USING (term) GROUP BY ALL),
  scored AS (SELECT s.*, CASE WHEN v <= -2 THEN 0 WHEN v = -1 THEN 1 WHEN v = 1 THEN 3
                              WHEN v >= 2 THEN 4 ELSE 2 END AS score
             FROM sentences s LEFT JOIN hits h ON {on} AND h.sent_no = s.sent_no),
  runs AS (SELECT {keys}, sent_no, CAST(generate_subscripts(ms, 1) - 1 AS INTEGER) AS pos,
                  unnest(ms) AS mention
           FROM (SELECT {keys}, sent_no, regexp_extract_all(sentence, '{MENTION}') AS ms FROM sentences)),
  candidates AS (SELECT *, lower(mention) IN {PRONOUN} AS is_pronoun FROM runs
                 WHERE lower(mention) IN {PRONOUN}
                    OR (regexp_matches(mention, '{CAPITALISED}') AND lower(mention) NOT IN {stop})),{chosen},
  linked AS (SELECT *, last_value(CASE WHEN NOT is_pronoun
                                  THEN lower(string_split(mention, ' ')[-1]) END IGNORE NULLS)
                       OVER (PARTITION BY {keys} ORDER BY sent_no, pos
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chain_key
             FROM mentions),
  chains AS (SELECT * FROM linked WHERE chain_key IS NOT NULL),
  topics AS (SELECT {keys}, chain_key,
                    arg_min(mention, struct_pack(a := length(mention), b := mention))
                      FILTER (WHERE NOT is_pronoun) AS topic,
                    count(*) AS n_mentions,
                    count(*) FILTER (WHERE NOT is_pronoun) AS n_names
             FROM chains GROUP BY ALL),
  opinions AS (SELECT DISTINCT {keys}, chain_key, topic, score, sentence
               FROM chains JOIN topics USING ({keys}, chain_key) JOIN scored USING ({keys}, sent_no))"""


DOCUMENTS = "SELECT doc_id, text FROM documents"
OPINIONS = _opinions(DOCUMENTS, "doc_id")
STRICT = _opinions(DOCUMENTS, "doc_id", strict=True)
NO_STOP = _opinions(DOCUMENTS, "doc_id", stop="('')")
LONG_LEXICON = _opinions(
    DOCUMENTS, "doc_id", lexicon=f"WITH {TOKENS} SELECT DISTINCT term, length(term) % 5 - 2 FROM tokens"
)
CHAINED = "doc_id, sent_no, pos, mention, is_pronoun, chain_key FROM chains"

MOVIES = """
  movies AS (SELECT p_partkey AS movie_id, p_size + 1950 AS year, p_name AS title,
                    CASE p_type WHEN 'SMALL' THEN NULL WHEN 'ECONOMY' THEN ''
                                ELSE p_brand || ' ' || p_type END AS synopsis
             FROM part)"""
SHOWN = "coalesce(nullif(synopsis, ''), 'No synopsis.') AS synopsis"
REVIEWS = """
  reviews AS (SELECT conv_id AS movie_id, turn AS review_id, role AS critic, text AS quote,
                     role AS review_type, CASE WHEN turn % 3 = 2 THEN 'ca' ELSE 'us' END AS country
              FROM conversations)"""
NEWEST = "ORDER BY year DESC NULLS LAST, movie_id"


def _found(query: str) -> str:
    words = " AND ".join(f"contains(lower(title), '{w.lower()}')" for w in query.split())
    return f"SELECT * FROM movies WHERE {words or 'false'}"


def _page_after(year: int, movie_id: int) -> str:
    follows = f"(year < {year} OR year IS NULL OR (year = {year} AND movie_id > {movie_id}))"
    return f"""WITH {MOVIES} SELECT movie_id, year, title, {SHOWN}
        FROM ({_found(SEARCH.split()[0])} AND {follows} {NEWEST} LIMIT {PAGE_SIZE})"""


ORACLES: dict[str, str] = {
    "corpus_term_counts": f"WITH {COUNTS} SELECT term, n FROM counts",
    "symbol_term_counts": f"""WITH {_tokens("text", WORD_OR_SYMBOLS)}
        SELECT term, count(*) AS n FROM tokens GROUP BY term""",
    "lemma_term_counts": rf"""WITH {TOKENS},
        lemmas AS (SELECT DISTINCT term AS form, left(term, length(term) - 1) AS lemma
                   FROM tokens WHERE length(term) > 2 AND term LIKE '%s'),
        lemmatised AS (SELECT coalesce(lemma, term) AS term
                       FROM words LEFT JOIN lemmas ON term = form)
        SELECT term, count(*) AS n FROM lemmatised
        WHERE length(term) > 1 AND term NOT IN {STOP} GROUP BY term""",
    "token_positions": f"WITH {TOKENS} SELECT doc_id, pos, term FROM tokens",
    "stop_words_file": r"""SELECT DISTINCT term FROM
        (SELECT unnest(regexp_split_to_array(text, '\s+')) AS term FROM documents) WHERE term <> ''""",
    "text_corpus": r"""WITH
        lines AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents),
        clean AS (SELECT trim(replace(value, chr(13), ''), ' ' || chr(9)) AS text FROM lines)
        SELECT text, count(*) AS n, true AS gapless FROM clean WHERE text <> '' GROUP BY text""",
    "rows_in_memory": "SELECT row_number() OVER (ORDER BY item_id) - 1 AS doc_id, text FROM benchmark",
    "bag_of_words_capped": f"""WITH {RANKED},
        doc_terms AS (SELECT doc_id, term, count(*) AS m FROM tokens GROUP BY ALL)
        SELECT doc_id, term_index, CAST(m AS DOUBLE) AS value FROM doc_terms JOIN ranked USING (term)
        WHERE term_index < {CAPPED_VOCABULARY}""",
    "doc_term_counts": f"WITH {DOC_TERMS} SELECT *, CAST(length(term) AS INTEGER) AS length FROM doc_terms",
    "total_counts": f"WITH {COUNTS} SELECT term, n FROM counts",
    "vocabulary_rank": f"WITH {RANKED} SELECT term, n, term_index FROM ranked",
    "vocabulary_size": f"""WITH {COUNTS}
        SELECT count(*) AS n_terms, CAST(sum(n) AS BIGINT) AS n_tokens FROM counts""",
    "bag_of_words_long": f"""WITH {RANKED},
        doc_terms AS (SELECT doc_id, term, count(*) AS m FROM tokens GROUP BY ALL)
        SELECT doc_id, term_index, CAST(m AS DOUBLE) AS value FROM doc_terms JOIN ranked USING (term)""",
    "count_vectors": f"""WITH {RANKED},
        entries AS (SELECT doc_id, term_index, count(*) AS m FROM tokens JOIN ranked USING (term)
                    GROUP BY ALL),
        bags AS (SELECT doc_id, string_agg(CAST(term_index AS VARCHAR), ' ' ORDER BY term_index) AS indices,
                        string_agg(CAST(m AS VARCHAR), ' ' ORDER BY term_index) AS counts
                 FROM entries GROUP BY doc_id)
        SELECT doc_id, CAST((SELECT count(*) FROM ranked) AS INTEGER) AS size,
               coalesce(indices, '') AS indices, coalesce(counts, '') AS counts
        FROM documents LEFT JOIN bags USING (doc_id)""",
    "topk_terms_per_doc": f"""WITH {DOC_TERMS},
        placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term)
                             AS INTEGER) AS rank FROM doc_terms)
        SELECT * FROM placed WHERE rank <= {TOP_TERMS}""",
    "corpus_lines": r"""WITH
        lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents),
        clean AS (SELECT doc_id, trim(replace(value, chr(13), ''), ' ' || chr(9)) AS value FROM lines)
        SELECT * FROM clean WHERE value <> ''""",
    "document_numbers": """SELECT source, doc_id,
        row_number() OVER (ORDER BY source, doc_id) - 1 AS row_index FROM documents""",
    "sentences": f"WITH {OPINIONS} SELECT doc_id, sent_no, sentence FROM sentences",
    "sentence_scores": f"""WITH {OPINIONS} SELECT doc_id, sent_no, score,
        {_class_names("score", LABELS)} AS label, {_class_names("score", THUMBS)} AS thumbs,
        {_class_names("score", SEVERITIES)} AS severity FROM scored""",
    "score_counts": f"WITH {OPINIONS} SELECT score, count(*) AS n_sentences FROM scored GROUP BY score",
    "mentions": f"WITH {OPINIONS} SELECT doc_id, sent_no, pos, mention, is_pronoun FROM mentions",
    "mentions_strict": f"WITH {STRICT} SELECT doc_id, sent_no, pos, mention, is_pronoun FROM mentions",
    "mention_chains": f"""WITH {OPINIONS}
        SELECT doc_id, sent_no, pos, mention, is_pronoun, chain_key FROM chains""",
    "chain_mention_sets": f"""(WITH {OPINIONS} SELECT {CHAINED})
        UNION (WITH {NO_STOP} SELECT {CHAINED})""",
    "chain_topics": f"WITH {OPINIONS} SELECT doc_id, chain_key, topic, n_mentions, n_names FROM topics",
    "chain_names": f"""WITH {OPINIONS},
        names AS (SELECT DISTINCT doc_id, chain_key, mention FROM chains WHERE NOT is_pronoun)
        SELECT doc_id, chain_key,
               string_agg(mention, '|' ORDER BY length(mention), mention) AS names
        FROM names GROUP BY ALL""",
    "scored_mentions": f"""WITH {OPINIONS}
        SELECT doc_id, sent_no, pos, mention, is_pronoun, chain_key, sentence, score
        FROM chains JOIN scored USING (doc_id, sent_no)""",
    "opinions_flat": f"WITH {OPINIONS} SELECT doc_id, chain_key, topic, score, sentence FROM opinions",
    "opinions_long_lexicon": f"""WITH {LONG_LEXICON}
        SELECT doc_id, chain_key, topic, score, sentence FROM opinions""",
    "sentence_scores_long_lexicon": f"WITH {LONG_LEXICON} SELECT doc_id, sent_no, score FROM scored",
    "learned_classes": f"WITH {OPINIONS} SELECT doc_id, sent_no, true AS in_range, true AS agrees FROM sentences",
    "lda_facts": """SELECT CAST(range AS INTEGER) AS topic, CAST(5 AS BIGINT) AS n_terms, '1 2 3 4 5' AS ranks,
        true AS falling, true AS known, true AS bounded FROM range(1, 6)""",
    "learned_confusion": f"""WITH {OPINIONS}
        SELECT score AS given, count(*) AS n, true AS balanced FROM scored WHERE doc_id % 5 = 0 GROUP BY score""",
    "lda_default_facts": """SELECT CAST(range AS INTEGER) AS topic, CAST(5 AS BIGINT) AS n_terms, '1 2 3 4 5' AS ranks,
        true AS looked_up, true AS bounded FROM range(1, 6)""",
    "topic_table_facts": f"""WITH {COUNTS}
        SELECT CAST(range AS INTEGER) AS topic, CAST(5 AS BIGINT) AS n_terms, true AS looked_up,
            (SELECT count(*) FROM counts) AS n_weights, true AS whole FROM range(1, 6)""",
    "topic_quality": f"""WITH {_tokens()},
        known AS (SELECT DISTINCT term FROM tokens WHERE doc_id % 5 <> 0)
        SELECT way, count(DISTINCT doc_id) AS n_documents, true AS beats_words, true AS same_again
        FROM tokens JOIN known USING (term), (VALUES ('em'), ('table')) ways(way) WHERE doc_id % 5 = 0 GROUP BY way""",
    "opinions_strict": f"WITH {STRICT} SELECT doc_id, chain_key, topic, score, sentence FROM opinions",
    "opinions_nested_json": f"""WITH {OPINIONS},
        per_topic AS (SELECT doc_id, topic,
            list(struct_pack(score := score, sentence := sentence) ORDER BY score, sentence) AS opinions
            FROM opinions GROUP BY doc_id, chain_key, topic),
        per_review AS (SELECT doc_id,
            list(struct_pack(topic := topic, opinions := opinions) ORDER BY topic) AS sentiments
            FROM per_topic GROUP BY doc_id)
        SELECT doc_id, CAST(to_json(struct_pack(review := text,
            sentiments := coalesce(sentiments, []))) AS VARCHAR) AS json
        FROM documents LEFT JOIN per_review USING (doc_id)""",
    "stream_opinions": f"""WITH
        {_opinions("SELECT conv_id AS movie_id, turn AS review_id, text FROM conversations",
                   "movie_id, review_id")}
        SELECT movie_id, review_id, chain_key, topic, score, sentence FROM opinions""",
    "title_search": f"""WITH {MOVIES}
        SELECT movie_id, year, title, {SHOWN} FROM ({_found(SEARCH)} {NEWEST} LIMIT {PAGE_SIZE})""",
    "title_matches": f"WITH {MOVIES} {_found(SEARCH)}",
    "second_page": f"""WITH {MOVIES} SELECT movie_id, year, title, {SHOWN}
        FROM ({_found(SEARCH.split()[0])} {NEWEST} LIMIT {PAGE_SIZE} OFFSET {PAGE_SIZE})""",
    "several_searches": " UNION ALL ".join(
        f"""SELECT * FROM (WITH {MOVIES} SELECT movie_id, year, title, {SHOWN}, '{query}' AS query
            FROM ({_found(query)} {NEWEST} LIMIT {PAGE_SIZE}))"""
        for query in SEARCHES
    ),
    "indexed_searches": " UNION ALL ".join(
        f"SELECT * FROM (WITH {MOVIES} SELECT *, '{query}' AS query FROM ({_found(query)}))" for query in INDEXED_SEARCHES
    ),
    "written_page": f"""WITH {MOVIES}
        SELECT * FROM movies {NEWEST} LIMIT {PAGE_SIZE} OFFSET {(DEEP_PAGE - 1) * PAGE_SIZE}""",
    "page_in_memory": f"""WITH {MOVIES},
        shown AS (SELECT title, row_number() OVER ({NEWEST}) - 1 AS doc_id FROM movies),
        words AS (SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos
                  FROM (SELECT doc_id, regexp_extract_all(lower(title), '{WORD}') AS ws FROM shown
                        WHERE doc_id < {PAGE_SIZE}))
        SELECT doc_id, CAST(pos AS INTEGER) AS pos, term FROM words WHERE length(term) > 1 AND term NOT IN {STOP}""",
    "deep_page": _page_after(*LAST_SEEN),
    "last_page": _page_after(*NEAR_THE_END),
    "blank_search": f"WITH {MOVIES} SELECT movie_id, year, title, {SHOWN} FROM movies WHERE false",
    "search_response": f"""WITH {MOVIES},
        found AS ({_found(SEARCH)} {NEWEST} LIMIT {PAGE_SIZE}),
        answer AS (SELECT string_agg('{{"mYear":' || year || ',"mId":"' || movie_id || '","mTitle":'
            || to_json(title) || CASE WHEN synopsis IS NULL THEN ''
                                 ELSE ',"mSynopsis":' || to_json(synopsis) END || '}}',
            ',' {NEWEST}) AS movies FROM found)
        SELECT '{SEARCH}' AS query,
               '{{"query":"{SEARCH}","movies":[' || coalesce(movies, '') || ']}}' AS json FROM answer""",
    "movies_by_year": f"WITH {MOVIES} SELECT * FROM movies {NEWEST} LIMIT {PAGE_SIZE}",
    "movie_synopses": f"WITH {MOVIES} SELECT movie_id, year, title, {SHOWN} FROM movies",
    "reviews_of_movie": f"""WITH {REVIEWS} SELECT * FROM reviews
        WHERE movie_id = {MOVIE} AND review_type = '{REVIEWER}' AND country = 'us'
        ORDER BY review_id LIMIT {PAGE_SIZE}""",
    "first_reviews": f"""WITH {REVIEWS},
        placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY movie_id ORDER BY review_id)
                             AS INTEGER) AS rank FROM reviews)
        SELECT * FROM placed WHERE rank <= {REVIEWS_PER_MOVIE}""",
    "first_page_of_reviews": f"""WITH {REVIEWS},
        placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY movie_id ORDER BY review_id)
                             AS INTEGER) AS rank FROM reviews)
        SELECT * FROM placed WHERE rank <= {PAGE_SIZE}""",
    "review_counts": f"WITH {REVIEWS} SELECT movie_id, count(*) AS n_reviews FROM reviews GROUP BY movie_id",
    "movie_reviews_join": f"""WITH {MOVIES}, {REVIEWS}
        SELECT movie_id, review_id, critic, quote, review_type, country, year, title, {SHOWN}
        FROM reviews JOIN movies USING (movie_id)""",
    "bucketed_join": f"""WITH {MOVIES}, {REVIEWS}
        SELECT movie_id, review_id, critic, quote, review_type, country, year, title, synopsis
        FROM reviews JOIN movies USING (movie_id)""",
    "bucketed_counts": f"WITH {REVIEWS} SELECT movie_id, count(*) AS n_reviews FROM reviews GROUP BY movie_id",
    "append_reviews": f"WITH {REVIEWS} SELECT * FROM reviews",
    "movies_json_roundtrip": f"""WITH {MOVIES}
        SELECT CAST(floor(movie_id / {PAGE_SIZE}) AS BIGINT) AS page,
               CAST(movie_id AS VARCHAR) AS movie_id, year, title, synopsis FROM movies""",
    "movies_json_with_faults": f"""WITH {MOVIES}
        SELECT CAST(floor(movie_id / {PAGE_SIZE}) AS BIGINT) AS page,
               CAST(movie_id AS VARCHAR) AS movie_id, year, title, synopsis FROM movies
        WHERE synopsis IS NOT NULL""",
    "movies_json_quarantine": f"""WITH {MOVIES},
        placed AS (SELECT *, CAST(floor(movie_id / {PAGE_SIZE}) AS BIGINT) AS page FROM movies),
        numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY movie_id) - 1
                               AS INTEGER) AS element_no FROM placed)
        SELECT page, 'no year' AS reason, element_no FROM numbered WHERE synopsis IS NULL
        UNION ALL
        SELECT -event_id - 1, 'no movies array', NULL FROM events""",
    "reviews_json_roundtrip": f"WITH {REVIEWS} SELECT movie_id, review_id, critic, quote FROM reviews",
    "event_props": """SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k,
        props ->> '$.k' AS k_text FROM events""",
}
# The same results by the other way of computing them.
ORACLES["doc_term_counts_grouped"] = ORACLES["doc_term_counts"]
ORACLES["topk_terms_ranked"] = ORACLES["topk_terms_per_doc"]
ORACLES["long_lemma_term_counts"] = ORACLES["lemma_term_counts"]
ORACLES["scored_mentions_joined"] = ORACLES["scored_mentions"]
ORACLES["opinions_from_mentions"] = ORACLES["opinions_flat"]
ORACLES["records_from_mentions"] = ORACLES["opinions_nested_json"]

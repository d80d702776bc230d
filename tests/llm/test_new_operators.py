"""Ranked search, periodic runs and exact dedup against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from awkward import SCHEMA, awkward, awkward_rows, empty, words
from pyspark.sql import functions as F

from reviewlens import sizing
from reviewlens.llm import exact_dedup, periodic_runs, ranked_search

# Exact dedup


def plain_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    found = []
    for text, ids in groups.items():
        largest = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        stays = ids.index(largest)
        found += [(i, largest, len(ids), at == stays, sha) for at, i in enumerate(ids)]
    return Counter(found)


def copy_rows():
    """Half of the rows are one text; others share length, or length and prefix, only."""
    draw = random.Random(3)
    long = words(1, 40)
    rows = [(i, long) for i in range(400)] + [(1000 + i, long[:-2] + f"{i:02d}") for i in range(60)]
    rows += [(2000 + i, long[:-2] + f"{i % 20:02d}") for i in range(60)]
    rows += [(3000 + i, words(i, draw.randrange(1, 6))) for i in range(100)]
    return rows + [row[:2] for row in awkward_rows()]


def frame_of(spark, rows):
    return spark.createDataFrame([(*row, *[None] * 13) for row in rows], SCHEMA)


@pytest.mark.parametrize("broadcast_rows, words_of_filter", [(50_000, 1 << 18), (0, 1 << 18), (0, 1)])
def test_exact_copies(spark, monkeypatch, broadcast_rows, words_of_filter):
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(exact_dedup, "WORDS", words_of_filter)
    rows = copy_rows()
    frame = frame_of(spark, rows).repartition(7)
    found = exact_dedup.exact_copies(frame, digests=True)
    assert Counter(map(tuple, found.collect())) == plain_copies(rows)
    some = exact_dedup.exact_copies(frame)
    whole = found.where("group_size > 1").select("doc_id", "text_sha256")
    assert whole.exceptAll(some.select("doc_id", "text_sha256")).count() == 0


def test_only_survivors_are_read_whole(spark):
    """A text alone with its length, or with its prefix, has no digest."""
    rows = [(1, "a" * 100), (2, "b" * 100), (3, "c" * 101), (4, "d" * 102), (5, "d" * 102), (6, "e" * 70 + "x"), (7, "e" * 70 + "y")]
    found = exact_dedup.exact_copies(frame_of(spark, rows))
    assert {r.doc_id for r in found.collect() if r.text_sha256 is not None} == {4, 5, 6, 7}


def test_a_text_of_most_rows_is_split(spark, monkeypatch):
    """Nine rows of ten are one text; the join that gives rows their group spreads them."""
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
    rows = [(i, "same words") for i in range(9000)] + [(10_000 + i, f"other {i // 2}") for i in range(1000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = exact_dedup.exact_copies(frame_of(spark, rows).repartition(8))
        per_task = found.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in per_task) < 4000 and found.where("kept").count() == 501
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_drop_copies(spark):
    frame = awkward(spark).unionByName(frame_of(spark, copy_rows()[:600]))
    kept = exact_dedup.drop_copies(frame)
    assert kept.columns == frame.columns
    found = Counter((r.doc_id, r.text or "") for r in kept.collect())
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    want = Counter()
    for text in {t or "" for _, t in rows}:
        want[max((i for i, t in rows if (t or "") == text and i is not None), default=None), text] += 1
    assert found == want


def test_exact_copies_of_nothing(spark):
    assert exact_dedup.exact_copies(empty(spark)).count() == 0 and exact_dedup.drop_copies(empty(spark)).count() == 0


# Periodic runs


def plain_runs(words, least=6, exponent=4):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda run: (run[0], run[2]))


def plain_collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return b" ".join(word for i, word in enumerate(words) if i not in gone)


def repetitive(draw):
    """Words with repeated stretches, some nested in others, of few or many kinds."""
    kinds = draw.choice([1, 2, 3, 50])
    words = [b"%d" % draw.randrange(kinds) for _ in range(draw.randrange(0, 50))]
    for _ in range(draw.randrange(3)):
        part = [b"%d" % draw.randrange(kinds) for _ in range(draw.randrange(1, 6))]
        whole = part * draw.randrange(2, 9) + part[: draw.randrange(len(part) + 1)]
        at = draw.randrange(len(words) + 1)
        words[at:at] = whole * draw.choice([1, 1, 4])
    return words


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (4, 3), (9, 2), (6, 7)])
def test_runs_of_texts(least, exponent):
    draw = random.Random(least * exponent)
    for _ in range(60):
        texts = [repetitive(draw) for _ in range(draw.randrange(1, 7))]
        for text, (runs, collapsed) in zip(texts, periodic_runs.runs_of_texts(texts, least, exponent), strict=True):
            assert runs == plain_runs(text, least, exponent)
            assert collapsed == plain_collapsed(text, runs)


def test_agreement_is_that_of_the_text():
    draw = np.random.default_rng(5)
    text = np.concatenate(([900], np.tile(draw.integers(0, 3, 7), 40), draw.integers(0, 2, 300), [901]))
    rounds = periodic_runs.compress(text, np.array([0, len(text) - 1]))
    i = draw.integers(1, len(text) - 1, 3000)
    j = draw.integers(1, len(text) - 1, 3000)
    i, j = i[i != j], j[i != j]
    for a, b, n in zip(i, j, periodic_runs.agreement(rounds, i, j), strict=True):
        assert (text[a : a + n] == text[b : b + n]).all() and text[a + n] != text[b + n]


@pytest.mark.parametrize("part", [[b"a"], [b"a", b"b", b"c"], [b"%d" % i for i in range(30_000)]])
def test_a_very_long_text(part):
    n = 200_000
    text = (part * (n // len(part) + 1))[:n]
    (runs, collapsed), = periodic_runs.runs_of_texts([text])
    assert runs == [(0, n, len(part))] and collapsed == b" ".join(part)


def test_candidates_in_portions(monkeypatch):
    monkeypatch.setattr(periodic_runs, "CANDIDATES", 5)
    text = repetitive(random.Random(77)) * 5
    (runs, _), = periodic_runs.runs_of_texts([text])
    assert runs == plain_runs(text)


def test_periodic_runs(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "SEQUENCE", 500)
    draw = random.Random(9)
    rows = [row[:2] for row in awkward_rows()] + [(100 + i, b" \n".join(repetitive(draw)).decode()) for i in range(80)]
    found = Counter()
    for r in periodic_runs.periodic_runs(frame_of(spark, rows)).collect():
        found[r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed] += 1
    want = Counter()
    for doc_id, text in rows:
        parts = (text or "").encode().split()
        runs = plain_runs(parts) if len(parts) < 1000 else []
        want[doc_id, len(parts), tuple(runs), plain_collapsed(parts, runs).decode()] += 1
    assert found == want
    assert periodic_runs.periodic_runs(empty(spark)).count() == 0


def test_planted_tails(spark):
    frame = awkward(spark).unionByName(frame_of(spark, [(100 + i, words(i, i)) for i in range(200)]))
    planted = periodic_runs.with_planted_tails(frame)
    assert planted.columns == frame.columns
    want = Counter()
    for r in frame.collect():
        text, parts = r.text, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h = 1 if r.doc_id is None else zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and parts:
            g, n = h // 10, len(parts)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(parts[i] if i < a else parts[a + (i - a) % p] for i in range(n))
        want[r.doc_id, text] += 1
    assert Counter((r.doc_id, r.text) for r in planted.collect()) == want


def test_longest(spark):
    rows = [(1, [(0, 8, 2), (9, 12, 3), (30, 12, 1)]), (2, []), (3, [(4, 9, 2), (4, 9, 1)])]
    frame = spark.createDataFrame(rows, "k int, runs array<struct<start: bigint, length: bigint, period: bigint>>")
    found = dict(frame.select("k", periodic_runs.longest(F.col("runs"))).collect())
    assert tuple(found[1]) == (9, 12, 3) and found[2] is None and tuple(found[3]) == (4, 9, 1)


# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranked(docs, items, k=10):
    counts = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counts = [(doc_id, c) for doc_id, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(term for _, c in counts for term in c)
    found = Counter()
    for item_id, wanted in {(item_id, tuple(sorted(set(terms(text))))) for item_id, text in items}:
        scored = []
        for doc_id, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = 0
            for term in wanted:
                if term in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * (10**9 * c[term] // (1000 * c[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for at, (score, none, doc_id) in enumerate(sorted(scored)[:k]):
            found[item_id, at + 1, None if none else doc_id, -score] += 1
    return found


def zipf_text(draw, n, vocabulary=400):
    return " ".join(f"w{min(int(draw.paretovariate(0.7)), vocabulary)}" for _ in range(n))


def search_tables(seed, n):
    draw = random.Random(seed)
    docs = [(i, zipf_text(draw, draw.randrange(1, 80))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(40)] + [docs[5], docs[5]]  # ties, repeated rows
    items = [(i, zipf_text(draw, draw.randrange(1, 30))) for i in range(12)]
    items += [items[0], (0, "w1 W2"), (None, "w3"), (50, None), (51, "--- !"), (52, "nowhere"), (53, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("block_docs, block_postings, k", [(65_536, 2_000_000, 10), (40, 2_000_000, 3), (1000, 60, 10), (1, 1, 1)])
def test_ranked_search(spark, monkeypatch, block_docs, block_postings, k):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCUMENTS", block_docs)
    monkeypatch.setattr(ranked_search, "BLOCK_POSTINGS", block_postings)
    docs, items = search_tables(block_docs, 300)
    docs += [row[:2] for row in awkward_rows()]
    frame = spark.createDataFrame(items, "item_id bigint, text string").withColumn("words", F.lit(1))
    found = ranked_search.ranked_search(frame_of(spark, docs).repartition(3), frame, k)
    assert Counter(map(tuple, found.collect())) == plain_ranked(docs, items, k)


def test_items_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 1500)
    docs, items = search_tables(8, 60)
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    found = ranked_search.ranked_search(frame_of(spark, docs), frame)
    assert Counter(map(tuple, found.collect())) == plain_ranked(docs, items)


def test_accumulators_are_limited():
    """Rare terms fill the ranks; of the common term no new document is taken up."""
    n = 5000
    sizes = np.full(n, 100)
    rare, common = np.arange(20), np.arange(n)
    docs, terms_ = np.concatenate((rare, common)), np.concatenate((np.zeros(20, int), np.ones(n, int)))
    block = ranked_search.Block(sizes, docs, terms_, np.ones(len(docs), int), np.array([9000, 10]), n, 100 * n)
    found, scores = block.best([0, 1], 10, 0)
    assert sorted(found) == list(range(20)) and len(set(scores)) == 1  # all ties, common term added
    alone, _ = block.best([0], 10, 0)
    assert scores[0] > block.bounds[0] and sorted(alone) == list(range(20))
    none, _ = block.best([1], 10, int(scores[0]))
    assert len(none) == 0


def test_ranked_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "some words")], "item_id bigint, text string")
    assert ranked_search.ranked_search(empty(spark), items).count() == 0
    assert ranked_search.ranked_search(awkward(spark), items.limit(0)).count() == 0

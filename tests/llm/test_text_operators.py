"""Decontamination, sharding, secrets, tokens and languages against plain Python."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlens.llm import decontaminate, language_id, secrets, sharding, token_counts
from awkward import awkward, awkward_rows, empty, words

# Decontamination


def plain_words(text):
    lowered = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_hits(text, items, n=10):
    found, hit, ids = plain_words(text), set(), set()
    for item_id, item in items:
        parts = plain_words(item)
        width = min(n, len(parts))
        if not width:
            continue
        for window in {tuple(parts[i : i + width]) for i in range(len(parts) - width + 1)}:
            for i in range(len(found) - width + 1):
                if tuple(found[i : i + width]) == window:
                    hit |= set(range(i, i + width))
                    ids.add(str(item_id))
    return len(found), len(hit), sorted(ids)


def documents_with_items(seed):
    draw = random.Random(seed)
    items = [(i, words(1000 + i, draw.choice([1, 2, 3, 9, 10, 11, 30]), 40)) for i in range(12)]
    items += [(50, ""), (51, None), (52, items[0][1]), (None, words(7, 12))]
    docs = [(None, None), (1, ""), (2, items[-1][1])]
    for i in range(3, 60):
        text = words(i, draw.randrange(1, 60), 40)
        if draw.random() < 0.5:
            chosen = draw.choice(items[:12])[1].upper()
            text = f"{text}, {chosen}! {text}"
        docs.append((i, text))
    docs += [docs[-1], docs[-1], (docs[-1][0], "other")]
    return docs, items


@pytest.mark.parametrize("window", [10, 3])
def test_benchmark_hits(spark, window):
    docs, items = documents_with_items(window)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("words", F.lit(1))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("window", F.lit(1))
    hits = decontaminate.benchmark_hits(frame, benchmark, window)
    rows = hits.select("doc_id", "n_words", decontaminate.hit_words(F.col("spans")), "item_ids").collect()
    named = [(i, t) for i, t in items if i is not None]
    want = [(d, *plain_hits(t, named, window)) for d, t in docs]
    assert Counter(map(repr, map(tuple, rows))) == Counter(map(repr, want))


def test_benchmark_hits_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 7_000)
    docs, items = documents_with_items(3)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    hits = decontaminate.benchmark_hits(frame, benchmark)
    rows = hits.select("doc_id", "n_words", decontaminate.hit_words(F.col("spans")), "item_ids").collect()
    named = [(i, t) for i, t in items if i is not None]
    assert Counter(map(repr, map(tuple, rows))) == Counter(repr((d, *plain_hits(t, named))) for d, t in docs)


def test_cut_documents_and_spans(spark):
    item = words(5, 12)
    rows = [(1, f"Before. {item.upper()}; after"), (2, "clean text"), (3, None), (None, item), (2, "clean text")]
    frame = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, spans string")
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = decontaminate.decontaminate(frame, benchmark)
    assert kept.columns == frame.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(
        map(repr, [(2, "clean text", "s"), (2, "clean text", "s"), (3, None, "s")])
    )
    cut = {repr(r.doc_id): r.text for r in decontaminate.decontaminate(frame, benchmark, cut="spans").collect()}
    assert cut["1"] == "Before. " + " " * 11 + "; after" and cut["2"] == "clean text" and cut["None"] == " " * 11
    with pytest.raises(ValueError):
        decontaminate.decontaminate(frame, benchmark, cut="some")


def test_decontaminate_awkward(spark):
    items = spark.createDataFrame([(1, words(2, 60))], "item_id bigint, text string")
    frame = awkward(spark)
    kept = decontaminate.decontaminate(frame, items)
    assert kept.count() == frame.count() - 2
    assert decontaminate.decontaminate(empty(spark), items).count() == 0
    assert decontaminate.benchmark_hits(frame, items.limit(0)).where(F.size("spans") > 0).count() == 0


def test_decontaminate_runs_no_python(spark, plan_of):
    items = spark.createDataFrame([(1, words(2, 60))], "item_id bigint, text string")
    plan = plan_of(decontaminate.benchmark_hits(awkward(spark), items))
    assert not re.search("EvalPython|InPandas|InArrow|BatchEval", plan)


# Sharding


def plain_jump(key, shards):
    key, b, j = key % (1 << 64), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 40, 64, 1000, 100_000])
def test_jump_shards(spark, shards):
    draw = random.Random(shards)
    keys = [0, 1, -1, (1 << 63) - 1, -(1 << 63), *(draw.randrange(-(1 << 63), 1 << 63) for _ in range(200))]
    frame = spark.createDataFrame([(k,) for k in keys], "key bigint")
    rows = frame.select("key", sharding.jump_shards(F.col("key"), shards).alias("s")).select("key", "s.*").collect()
    assert [(r.shard, r.grown) for r in rows] == [(plain_jump(k, shards), plain_jump(k, shards + 1)) for k in keys]


def test_few_steps_are_finished_by_many(spark, monkeypatch):
    monkeypatch.setattr(sharding.math, "log", lambda _: -3.9)  # one or two steps at first
    frame = spark.range(50)
    rows = frame.select("id", sharding.jump_shards(F.col("id"), 300).alias("s")).select("id", "s.*").collect()
    assert [(r.shard, r.grown) for r in rows] == [(plain_jump(r.id, 300), plain_jump(r.id, 301)) for r in rows]


@pytest.mark.parametrize("slot_rows", [sharding.SLOT_ROWS, 1])
def test_shard_documents(spark, monkeypatch, slot_rows):
    monkeypatch.setattr(sharding, "SLOT_ROWS", slot_rows)
    frame = awkward(spark)
    rows = sharding.shard_documents(frame, shards=3).collect()
    texts = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in awkward_rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
    slots = {}
    for r in sorted(rows, key=lambda r: (r.shard, r.slot)):
        assert r.shard == plain_jump(r.doc_id or 0, 3) and r.grown_shard == plain_jump(r.doc_id or 0, 4)
        assert r.grown_shard in (r.shard, 3)
        assert r.law == "key" and r.slot == slots.get(r.shard, 0)
        slots[r.shard] = r.slot + 1
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_many_ranges_number_alike(spark, monkeypatch):
    frame = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    want = sharding.shard_documents(frame, 4).orderBy("doc_id").collect()
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    assert sharding.shard_documents(frame, 4).orderBy("doc_id").collect() == want


def test_write_shards(spark, tmp_path):
    sharding.write_shards(awkward(spark).drop("shard"), str(tmp_path / "s"), 3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(awkward_rows())


# Secrets


def plain_spans(text):
    text = text or ""
    found = [(m.start(), m.end(), "assign") for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in secrets.HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


PARTS = ["pass", "word", "password", "passwd", "token", "api", "_", "key", "secret", "=", ":", "  ", "'", '"', "AKIA"]
PARTS += ["ABCD1234", "0a1b", "ffff" * 3, "é", "İ", "ſecret", "toKen", "x.y", "\n", "TOKEN: ", "K"]


def test_secret_spans(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choices(PARTS, k=draw.randrange(40))) for _ in range(800)]
    texts += [None, "", "password=" + "a" * 100_000, "f" * 100_000, "password " * 5_000, "AKIA" * 30]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("spans", F.lit(1))
    for row in secrets.secret_spans(frame).collect():
        want = plain_spans(texts[row.doc_id])
        kinds = Counter(kind for _, _, kind in want)
        assert (row.n_assign, row.n_access, row.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert row.base_sha256 == hashlib.sha256(secrets.joined(want).encode()).hexdigest()
        assert [s for s in row.spans.split(",") if s.split(":")[0] in secrets.BASE_KINDS] == [
            f"{kind}:{a}:{b}" for a, b, kind in want
        ]


def test_checksums(spark):
    body = "Ab3" * 10
    good, bad = body + secrets.checksum62(body), body + "000000"
    texts = [f"é ghp_{good}", f"ghp_{bad}", f"npm_{good}.", f"ghp_{good}x", "card 4111 1111 1111 1111", "card: 4111111111111112"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = [r.spans for r in secrets.secret_spans(frame).orderBy("doc_id").collect()]
    assert spans == ["forge:2:42", "", "registry:0:40", "", "card:0:24", ""]


def test_secrets_awkward(spark):
    assert secrets.secret_spans(awkward(spark)).count() == len(awkward_rows())
    assert secrets.secret_spans(empty(spark)).count() == 0


# Tokens


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))


def token_texts():
    draw = random.Random(8)
    parts = ["ab", "the ", "\n", "é", "é", " ́x", "don't", "'s", "1234", "!!", "<|endoftext|>", "<|", "日本", "  ", "\t"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(1, 400))) for _ in range(120)]
    return [*texts, "", None, "a" * 3_000, "ab" * 2_000 + " " + "c" * 3_000, " " * 2_000, words(3, 3_000), " ".join("abcdef" * 200)]


@pytest.mark.parametrize("chunk, overlap", [(token_counts.CHUNK, token_counts.OVERLAP), (97, 5), (20, 1), (300, 64)])
def test_token_counts(spark, tokenizer, chunk, overlap):
    texts = token_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = token_counts.token_counts(frame, limit=100, chunk=chunk, overlap=overlap).collect()
    for row in rows:
        text = texts[row.doc_id] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 100), text[:80]


def test_spliced_tokens_are_those_of_the_whole(tokenizer):
    encode = token_counts.tokens_of(tokenizer)
    for text in token_texts():
        if text:
            assert list(token_counts.encode_huge(text, encode, 64, 4)) == encode(text)


def test_known_pieces_are_bounded(monkeypatch, tokenizer):
    import public_tokenizers

    monkeypatch.setattr(token_counts, "KNOWN_PIECES", 10)
    counter = token_counts.Counter(public_tokenizers.path(token_counts.VOCABULARY))
    for seed in range(5):
        text = words(seed, 200)
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_tokens_awkward(spark):
    assert token_counts.token_counts(awkward(spark)).count() == len(awkward_rows())
    assert token_counts.token_counts(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(empty(spark), chunk=5, overlap=5)


# Languages


def test_codewords_lie_apart():
    for classes in (2, 3, 4, 7, 8, 30):
        code = language_id.codewords(classes)
        apart = min((a != b).sum() for i, a in enumerate(code) for b in code[:i])
        assert apart >= max(1, code.shape[1] // 4)
        assert ((code.sum(0) > 0) & (code.sum(0) < classes)).all()


def test_grams_of_slices_add_up(monkeypatch):
    text = words(1, 500) + " Äß日本"
    whole = language_id.grams(text)
    assert whole.sum() == sum(len(text.encode()) - n + 1 for n in language_id.GRAMS)
    monkeypatch.setattr(language_id, "SLICE", 7)
    assert (language_id.grams(text) == whole).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    answers = language_id.identify(docs, model).withColumn("held", language_id.held_out(F.col("doc_id")))
    both = answers.join(docs.select("doc_id", "lang"), "doc_id").where("held")
    right, n = both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 250 and right >= 0.97
    ids = {r.doc_id for r in both.select("doc_id").collect()}
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in ids)
    assert answers.where("score < 0 or score > 1 or score is null").count() == 0


def test_languages_awkward(spark):
    frame = awkward(spark)
    model = language_id.train(frame)
    assert model.languages == ("xx", "yy")
    rows = language_id.identify(frame, model).collect()
    assert len(rows) == len(awkward_rows())
    unknown = Counter(r.doc_id for r in rows if r.lang_pred == "und")
    assert unknown == Counter([10, 11, 12, 18, None])
    kept = language_id.keep_identified(frame, model)
    assert kept.schema == frame.schema and kept.count() == len(rows) - 5
    nothing = language_id.train(empty(spark))
    assert {r.lang_pred for r in language_id.identify(frame, nothing).collect()} == {"und"}
    one = language_id.train(frame.where("lang = 'xx'"))
    assert {r.lang_pred for r in language_id.identify(frame, one).collect()} == {"xx", "und"}
    assert language_id.identify(empty(spark), model).count() == 0

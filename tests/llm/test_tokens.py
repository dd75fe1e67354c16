import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tiktoken")
from cohortloom.llm import tokens as T  # noqa: E402

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(T.VOCABULARY), reason="no vocabulary here")

TEXTS = ["", None, " ", "Hello  world\n\n  x", "<|endoftext|> is text", "naïve café 日本語 👩‍👩‍👧", "it's we'll  I'M", "a b c\x1cd\x85e", "x" * 20_000, "0123456789" * 3000, "\t\t\n \r\n", "a" + " " * 5000 + "b", "́é﻿​", "٣٤٥ ⅷ ²"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    import public_tokenizers as P

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=T.read_ranks(), special_tokens={})


def test_ids_equal_the_tokenizer(spark, reference):
    rng = random.Random(1)
    pieces = ["def ", "noisy_encoder", " ", "  ", "\n", "'s", "é", "漢", "\x1b[0m", "3.14", "\\n", '"', "=", "\t", "😀", "’"]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in T.encode_corpus(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == reference.encode_ordinary(t or ""), repr(t)[:60]


def test_lexicon_is_exact_and_shares_suffixes():
    words = {w.encode(): (i, i + 1) for i, w in enumerate(["walking", "talking", "walk", "talk", "w", "walked"])}
    lx = T.Lexicon.build(words)
    probe = [*words, b"", b"wal", b"walkin", b"zzz", b"walkingx"]
    place = lx.places(probe)
    ordered = sorted(words)
    assert [ordered[p] if p >= 0 else None for p in place] == [*words, None, None, None, None, None]
    assert all(list(lx.ids_of(p)) == list(words[w]) for w, p in zip(probe, place) if p >= 0)
    assert len(lx.final) < sum(map(len, words)) and len(lx.keys) < sum(map(len, words))
    assert T.Lexicon.build({}).places([b"a"]).tolist() == [-1]


def test_lexicon_of_many_words():
    rng = random.Random(4)
    words = {bytes(rng.choice(b"abc\x00\xff") for _ in range(rng.randrange(1, 9))): [rng.randrange(99) for _ in range(rng.randrange(4))] for _ in range(3000)}
    lx = T.Lexicon.build(words)
    probe = [bytes(rng.choice(b"abc\x00\xff") for _ in range(rng.randrange(10))) for _ in range(3000)] + list(words)
    for w, p in zip(probe, lx.places(probe)):
        assert (p >= 0) == (w in words) and (p < 0 or list(lx.ids_of(p)) == words[w])


def test_frequent_words_are_counted_over_all_texts(spark):
    texts = ["the cat the dog", "the  end", None, "", "x" * 100 + " the", "é the"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = {r.word: r.n for r in T.word_counts(df).collect()}
    assert counts == {None: 12, "the": 2, " cat": 1, " the": 3, " dog": 1, " ": 1, " end": 1, "é": 1} or counts[" the"] == 3
    total = counts.pop(None)
    assert total == sum(counts.values()) + 1 and max(map(len, counts)) <= T.LONGEST
    assert T.frequent_words(df, one_in=6) == sorted(w for w, n in counts.items() if n * 6 >= total)
    assert T.frequent_words(df.limit(0)) == []


def test_ids_do_not_depend_on_the_lexicon(spark, reference):
    texts = ["the cat the dog the end", "the catalogue"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for one_in in (1, 3, 1000):
        assert {r.doc_id: r.ids for r in T.encode_corpus(df, one_in=one_in).collect()} == {i: reference.encode_ordinary(t) for i, t in enumerate(texts)}


def test_other_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "x"), (None, "b", "y"), (1, "a", "x")], "doc_id bigint, text string, TEXT string")
    assert len(T.encode_corpus(df).collect()) == 3
    assert T.encode_corpus(df.limit(0)).collect() == []
    assert T.encode_corpus(df.select(F.col("doc_id").alias("ids"), df.columns[1] if False else F.lit("a").alias("text")), key="ids").columns == ["ids", "_ids"]

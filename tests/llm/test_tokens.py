import random

import pytest
import tiktoken

from roadloom.llm.tokens import PATTERN, VOCABULARY, Encoder, encoded, ranks, token_counts


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks(), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return Encoder(VOCABULARY)


CUES = "1\n00:00:27,627 --> 00:00:32,395\nElle a volé une lettre.\n- L'été!\n\n2\n00:00:32.958 --> 00:00:35.631\n♪ LA PORTE ♪\n\n\n"


def test_cues_and_odd_texts(plain, own):
    texts = [CUES, CUES.strip(), "\n" + CUES, CUES.replace("\n", "\r\n"), CUES.replace("\n\n", " \n\n "), "<|endoftext|> <|startoftext|>", " ", "\n", "\n\n\n", "a\n\n\n", "x " * 5000, "a" * 20000, "it's we'll I'D don't", "​ 　x﻿", "漢字かな🙂👩‍👩‍👧", "00:00:27,627 --> 00:00:32,395", "٠٠:٠٠:٢٧,٦٢٧ --> 00:00:32,395"]
    for t in texts:
        ids = own.encode(t)
        assert list(ids) == plain.encode_ordinary(t), t[:40]
        assert own.decode(ids) == t


def test_random_texts(plain, own):
    rng = random.Random(3)
    alphabet = " \n\n\t 　abcé世​\u0085\u001c\r.'s12,:-><|🙂"
    for _ in range(5000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(16)))
        assert list(own.encode(t)) == plain.encode_ordinary(t), repr(t)
        assert own.decode(own.encode(t)) == t


def test_caches_may_overflow(plain, monkeypatch):
    monkeypatch.setattr("roadloom.llm.tokens.LINES", 3)
    monkeypatch.setattr("roadloom.llm.tokens.WORDS", 5)
    e = Encoder(VOCABULARY)
    for k in range(30):
        t = f"line {k} of words\nand {k * k} more\n"
        assert list(e.encode(t)) == plain.encode_ordinary(t)


def test_frames(spark, plain):
    rows = [(1, "Hello world", 5), (2, "", 6), (3, None, 7), (1, "Hello world", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in encoded(df).collect())
    assert got == [(1, plain.encode_ordinary("Hello world"))] * 2 + [(2, []), (3, [])]
    assert sorted(r.n_tokens for r in token_counts(df).collect()) == [0, 0, 2, 2]
    assert encoded(df.limit(0)).schema["ids"].dataType.simpleString() == "array<int>" and encoded(df.limit(0)).count() == 0

import random

import public_tokenizers
import pytest
import sentencepiece

from sentrylake.llm import sp_viterbi, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "abet ▁\n\t  ing.é漢字😀\x00{};\r<s>0123"


def texts():
    rng = random.Random(4)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(150))) for _ in range(200)]
    return [*made, "", " ", "a" * 3000, "ab" * 2000, " " * 200, "the" * 900, "=-" * 700, "<s></s><unk>", "Hello, world!  Ünïcode"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_library_and_decode_back(library):
    m = sp_viterbi.model(PATH)
    for text in texts():
        ids = sp_viterbi.encode(m, text)
        assert ids == library.encode(text)
        assert sp_viterbi.decode(m, ids) == library.decode(ids)
        assert "▁" in text or sp_viterbi.decode(m, ids) == text


def test_the_stream_commits_within_its_window():
    m = sp_viterbi.model(PATH)
    seen = 0

    def chars():
        nonlocal seen
        for _ in range(20_000):
            seen += 1
            yield "abc"[seen % 3]

    first = next(sp_viterbi.viterbi(m, chars()))
    assert seen < 200 and first


@pytest.mark.parametrize("hot", [1, 18])
def test_counts_equal_the_library(spark, library, monkeypatch, hot):
    monkeypatch.setattr(token_counts, "HOT", hot)  # at 1 nearly all pre-tokens take the shuffled join
    made = texts()
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, PATH, 4096, keep=["doc_id"]).collect()}
    assert found == {i: len(x) for i, x in enumerate(library.encode(made))}


def test_each_distinct_pre_token_is_counted_once(spark, library):
    df = spark.createDataFrame([(f"the cat {i % 3} the",) for i in range(200)] + [(None,)], "text string").repartition(4)
    rows = token_counts.pre_token_pieces(df, PATH).collect()
    assert sorted((r["pre_token"], r["n"]) for r in rows) == [("▁0", 67), ("▁1", 67), ("▁2", 66), ("▁cat", 200), ("▁the", 400)]


def test_columns(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "Hello é", 7), (3, "Hello é", 7), (None, "x " * 5000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    key = lambda r: (str(r["doc_id"]), r["n_tokens"])
    got = sorted(token_counts.token_counts(df, PATH, 4096).collect(), key=key)
    assert [(r["n_bytes"], r["over_limit"]) for r in got] == [(0, False), (0, False), (8, False), (8, False), (10_000, True)]
    assert token_counts.token_counts(df.limit(0), PATH, 4096).count() == 0
    coded = sorted(sp_viterbi.digest_column(df, PATH).collect(), key=key)
    assert [r["n_tokens"] for r in coded] == [r["n_tokens"] for r in got] and all(r["round_trip"] for r in coded)

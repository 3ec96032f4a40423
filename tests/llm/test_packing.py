import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sentrylake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello WORLD, it's fine\x1c\x85 ok",
    None,
    "",
    "  \n\t ",
    "<|endoftext|> and <|startoftext|>x",
    "<|ENDOFTEXT|> <|EndOfText|>É<|endoftext|>A b<|startoftext|>C <| |> X<|endoftext|>Don'T",
    "é É İ ΣαΣ K 1234 don't WE'LL",
    "word " * 3000,
    "漢字" * 900,
    "\x00 ​ \U0001f600\U0001f600",
]


@pytest.mark.parametrize("sequence", [8, 2048])
def test_pieces_hold_every_id_once(spark, sequence):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int")
    out = packing.pack(df, PATH, sequence=sequence).collect()
    tok = Tokenizer.from_file(PATH)
    want = sorted((str(i), tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    by_row = {}
    for p in out:
        by_row.setdefault(p["row"], []).append(p)
    assert len(by_row) == len(rows)
    left = list(want)
    for pieces in by_row.values():
        pieces.sort(key=lambda p: p["start"])
        for doc_id, ids in left:
            cut = [ids[p["start"] : p["start"] + p["length"]] for p in pieces]
            if (
                doc_id == str(pieces[0]["doc_id"])
                and sum(map(len, cut)) == len(ids) == pieces[0]["doc_tokens"]
                and all(zlib.crc32(np.array(c, "<u4").tobytes()) == p["ids_crc32"] for c, p in zip(cut, pieces))
            ):
                left.remove((doc_id, ids))
                break
        else:
            raise AssertionError(pieces)
    sequences = {}
    for p in out:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == sequence or at & (at - 1) == 0


def test_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_hilbert_neighbours_differ_by_one_step():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = grid[np.argsort(packing.hilbert(grid, bits=3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_copies_spread_over_ranges(spark):
    df = spark.createDataFrame([(i, "same text again") for i in range(400)], "doc_id long, text string")
    curves = {r["curve"] for r in packing.pack(df, PATH, sequence=64).collect()}
    assert len(curves) == 400


def test_ids_beyond_16_bits_are_kept(spark, tmp_path):
    from tokenizers import models, pre_tokenizers

    words = {f"w{i}": i for i in range(70_000)}
    tok = Tokenizer(models.WordLevel(words, unk_token="w0"))
    tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    tok.save(str(tmp_path / "t.json"))
    df = spark.createDataFrame([(1, "w69999 w3 w65536"), (2, "w5")], "doc_id long, text string")
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.pack(df, str(tmp_path / "t.json"), sequence=64, end_id=1).collect() if r["start"] == 0}
    assert zlib.crc32(np.array([5, 1], "<u4").tobytes()) in got.values()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", " ", "Hello", "É", "it's", "\t", "9", "<"]), max_size=8).map("".join))
def test_ids_around_special_strings(text):
    tok = Tokenizer.from_file(PATH)
    (ids,), _ = packing.tokenise([text], PATH, 1)
    assert np.frombuffer(ids, "<u4").tolist() == [*tok.encode(text, add_special_tokens=False).ids, 1]

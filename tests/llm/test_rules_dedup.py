import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentrylake.llm import exact_trie, quality_rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_measures_of_a_small_text():
    text = "a b c a b c\na b c a b c\nX! #\x85y z"
    m = dict(zip(quality_rules.MEASURES, quality_rules.measure(text)))
    assert m["n_words"] == 14 and m["n_dup_lines"] == 1 and m["n_lines"] == 3
    assert m["n_repeat_words"] == 12 and m["n_symbols"] == 1 and m["word_chars"] == 19
    assert quality_rules.measure("") == (0,) * len(quality_rules.MEASURES)


def test_ledger_policies_and_ablations(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "k"), (2, None, "k"), (3, "", None), (4, words.upper(), "k"), (4, words.upper(), "k"), (5, " ".join(["x y z"] * 30), "k"), (6, "ab " * 10, "k"), (None, "# " * 60, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    book = quality_rules.ledger(df)
    assert book.columns.count("n_words") == 1 and book.count() == len(rows)
    policy = quality_rules.POLICIES["v2-content"]
    kept = {(r["doc_id"], r["fail_bits"]): r["kept"] for r in book.withColumn("kept", quality_rules.verdict(policy)).collect()}
    assert [k for k, v in kept.items() if v] == [(1, 0)]
    by_rule = {r["rule"]: r for r in quality_rules.ablations(book, policy).collect()}
    bits = [r["fail_bits"] for r in book.collect()]
    for rule in quality_rules.RULES:
        flag = 1 << rule.bit
        r = by_rule[rule.name]
        assert r["n_failed"] == sum(bool(b & flag) for b in bits)
        assert r["n_only"] == sum((b & policy.mask) == flag for b in bits)
        assert r["n_kept_without"] == sum(not (b & policy.mask & ~flag) for b in bits)
    assert quality_rules.ledger(df.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 9) | st.none()), max_size=40), st.integers(1, 4))
def test_trie_agrees_with_a_dictionary_whatever_it_spills(rows, every):
    trie, spilled = exact_trie.PatriciaTrie(), []
    for i, (key, doc_id) in enumerate(rows):
        trie.insert(key, doc_id)
        if i % every == every - 1:
            spilled += [(k, list(o)) for k, o in trie.spill()]
    spilled += [(k, list(o)) for k, o in trie.terminals()]
    again = exact_trie.PatriciaTrie()
    for key, own in spilled:
        again.insert(key, *own)
    want = {}
    for key, doc_id in rows:
        want.setdefault(key, []).append(doc_id)
    rank = lambda x: (x is not None, x or 0)
    for key, own in again.terminals():
        ids = want.pop(key)
        best = max(ids, key=rank)
        assert own == [best, ids.count(best), len(ids)]
    assert not want


def test_assign_matches_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_trie, "TRIE_BYTES", 2000)
    rng = random.Random(2)
    texts = ["", None, "Same", "SAME", "é", "É", "a" * 5000, "A" * 5000, "ſ", "x\x00y"]
    rows = [(rng.randrange(40), rng.choice(texts), i) for i in range(200)] + [(None, "Same", 200), (None, None, 201), (39, "same", 202), (39, "same", 203)]
    spark.createDataFrame(rows, "doc_id long, text string, row long").repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = exact_trie.assign(df).collect()
    groups = {}
    for doc_id, text, _ in rows:
        groups.setdefault(hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest(), []).append(doc_id)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    for sha in groups:
        assert sum(r["kept"] for r in got if r["text_sha256"] == sha) == 1
    assert exact_trie.drop_copies(df).count() == len(groups)
    assert exact_trie.assign(df.limit(0)).count() == 0


def test_extra_columns_survive_the_filter(spark, tmp_path):
    spark.createDataFrame([(1, "a", 5), (2, "A", 6)], "doc_id long, text string, kept int").write.parquet(str(tmp_path / "t"))
    kept = exact_trie.drop_copies(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert [tuple(r) for r in kept] == [(2, "A", 6)]

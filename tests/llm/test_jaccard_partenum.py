import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sentrylake.llm import jaccard_partenum as J

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[x : x + size]) for x in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in having[g]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for g in s:
            having[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([4, 11, 30, 80, 200]))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(8)):
            edited = list(base)
            for _ in range(rng.randrange(1, 1 + len(base) // 12 + 1)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            out.append("\t".join(edited).upper() if rng.random() < 0.3 else " \n".join(edited))
    return out + ["", None, " \n ", "one", "ONE", "one two", "one two", "a b c", "A b\tc"]


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (3, 60)])
def test_components_match_brute_force(spark, size, percent):
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts(5))] + [(None, "lonely words here now"), (3, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.near_duplicates(df, size, percent).collect()]
    assert sorted(got, key=repr) == brute(rows, size, percent)


def test_blocks_compare_all_members(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 3)
    rows = list(enumerate(t for t in texts(9) if t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.near_duplicates(df, 3, 80).collect()]
    assert sorted(got, key=repr) == brute(rows, 3, 80)


def test_empty_table_and_keep_one(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert J.near_duplicates(none).count() == 0
    long = " ".join(f"t{i}" for i in range(60))
    rows = [(5, long, 1), (2, long + " end", 2), (9, "", 3), (9, None, 4), (None, "a b c d e f", 5), (None, "g h i j k l", 6), (2, long, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, extra int").write.parquet(str(tmp_path / "t"))
    kept = J.keep_one(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert len(kept) == 5 and {r["extra"] for r in kept} & {2, 7} and {3, 4, 5, 6} <= {r["extra"] for r in kept}


@settings(max_examples=60, deadline=None)
@given(st.integers(9, 300), st.integers(0, 60), st.integers(0, 60), st.sampled_from([50, 65, 80, 90]), st.integers(0, 2**31))
def test_linked_sets_share_a_signature(common, only_a, only_b, percent, seed):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**63, common + only_a + only_b).astype(np.uint64))
    a = np.sort(np.concatenate([pool[:common], pool[common : common + only_a]]))
    b = np.sort(np.concatenate([pool[:common], pool[common + only_a :]]))
    apart = len(np.setxor1d(a, b))
    distance = np.bitwise_count(J.sketch(a).view(np.uint64) ^ J.sketch(b).view(np.uint64)).sum()
    assert distance <= apart
    linked = 100 * common >= percent * (common + apart)
    if linked and apart:
        assert len(np.intersect1d(J.signatures(a, percent), J.signatures(b, percent)))

def test_a_pair_comes_from_one_of_its_buckets(spark, monkeypatch):
    # Texts around one long passage share dozens of buckets each, but few of their pairs may be linked.
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(160)
    rows = [(i, " ".join(fresh(24) + passage + fresh(24))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " more words " + str(i)) for i in range(10)]
    made, compare, tested, write = spark.sparkContext.accumulator(0), J._compare, {}, J.materialise

    def noted(*given):
        inner = compare(*given)

        def run(batches):
            for out in inner(batches):
                made.add(out.num_rows)
                yield out

        return run

    def written(df, tag, *a, **k):
        out = write(df, tag, *a, **k)
        if tag in ("partenum-pairs", "partenum-more"):
            tested[tag] = out.count()
        return out

    monkeypatch.setattr(J, "_compare", noted)
    monkeypatch.setattr(J, "materialise", written)
    monkeypatch.setattr(J, "ROUNDS", 0)  # all pairs at once
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.near_duplicates(df, 5, 80).collect()]
    assert sorted(got, key=repr) == brute(rows, 5, 80)
    assert 0 < tested["partenum-more"] <= made.value <= sum(tested.values())


def test_largest_shared_bucket_keeps_each_pair():
    rng = np.random.default_rng(2)
    lists = [sorted({int(b) for b in rng.integers(1, 30, 6)}, reverse=True) for _ in range(40)]
    size = {b: 100 + b // 3 for b in range(30)}
    pack = lambda x: np.array(sorted(((size[b], b - 15) for b in x), reverse=True)[:3], J.RANK).tobytes()
    seen = Counter()
    for b in range(1, 30):
        inside = [k for k, x in enumerate(lists) if b in x]
        ranks = np.array([pack(lists[k]) for k in inside] + [None], object)[:-1]
        x, y = np.triu_indices(len(inside), 1)
        same = lambda v: np.full(len(inside), v, np.int64)
        left = ~J._met_before(ranks, same(size[b]), same(b - 15), x, y)
        seen.update((inside[a], inside[c]) for a, c in zip(x[left], y[left]))
    shared = {(a, c) for a in range(40) for c in range(a + 1, 40) if set(lists[a]) & set(lists[c])}
    assert set(seen) == shared

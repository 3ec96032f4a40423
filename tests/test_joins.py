"""As-of joins, seal coverage, kill state and rule tables against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from sentrylake.operators import evidence, killswitch, policy
from sentrylake.operators.asof import as_of


def test_as_of(spark):
    rng = random.Random(2)
    points = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-50, 90)]), i) for i in range(150)]
    marks = [(rng.choice(["a", None, "c"]), rng.choice([None, *range(-40, 70)]), i) for i in range(60)]
    df = as_of(spark.createDataFrame(points, "g string, at long, i long"), spark.createDataFrame(marks, "g string, at long, v long"), ["g"], "at", F.col("v"), 8)
    want = {
        i: max(((a, v) for h, a, v in marks if h == g and a is not None and at is not None and a <= at), default=(None, None))[1] for g, at, i in points
    }
    assert {r["i"]: r["mark"] for r in df.collect()} == want


def test_seal_coverage_and_contents(spark):
    rng = random.Random(3)
    seqs = sorted(rng.sample(range(1, 400), 330) + list(range(70_000, 70_100)))
    seals = [(f"s{i}", a := rng.choice([0, 1, 70_000, rng.randrange(400)]), a + rng.randrange(0, 60)) for i in range(60)] + [("far", 5, 10**15), ("odd", 9, 8)]
    leaves = spark.createDataFrame([(s, f"{s:064x}") for s in seqs], "seq long, leaf_hash string")
    df = spark.createDataFrame(seals, "seal_id string, first_seq long, last_seq long")
    got = {r["seal_id"]: r for r in evidence.seal_coverage(leaves, df).collect()}
    have = set(seqs)
    for name, a, b in seals:
        covered = sum(a <= s <= b for s in seqs)
        assert got[name]["covered"] == covered and got[name]["expected"] == b - a + 1
        missing = next((s for s in range(a, min(b, 10**6) + 1) if s not in have), None) if covered < b - a + 1 else None
        assert got[name]["missing_seq"] == missing
    full = [s for s in seals if got[s[0]]["covered"] == s[2] - s[1] + 1 and s[2] >= s[1]]
    rows = evidence.sealed_leaves(leaves, df.where(F.col("seal_id").isin([s[0] for s in full]))).collect()
    assert sorted((r["seal_id"], r["i"], int(r["leaf_hash"], 16)) for r in rows) == sorted((n, s - a, s) for n, a, b in full for s in range(a, b + 1))
    marked = df.withColumns({c: F.lit("x") for c in ("merkle_root", "seal_hash", "recomputed")})
    plan = evidence.seal_failures(leaves, marked, False)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_kill_state_against_a_loop(spark):
    rng = random.Random(4)
    log = [(rng.choice(["a", "b", None]), rng.randrange(900), rng.random() < 0.5) for _ in range(40)]
    asked = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(1000)])) for i in range(200)] + [(7, "a", 5)]
    at = lambda df: df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = killswitch.state_as_of(at(spark.createDataFrame(asked, "query_id long, run string, s long")), at(spark.createDataFrame(log, "run string, s long, on boolean")))

    def state(run, s):
        return max(((t, on) for r, t, on in log if r == run and s is not None and t <= s), default=(0, False))[1]

    want = sorted((i, bool(run) and state(run, s), state(None, s)) for i, run, s in asked)
    assert sorted((r["query_id"], r["run_killed"], r["panic"]) for r in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("at_once", [1, 3, 100])
def test_rule_tables_agree_with_literal_rules(spark, at_once):
    patterns = [["a\\sb"], ["(", "promise.{0,9}discount", "x+"], ["[", "*"], [], None, ["straße", None], ["^end$"]]
    rules = [(f"R{i}", f"t{i}", "needs approval" if i == 1 else "s", "c", "high", p) for i, p in enumerate(patterns)]
    texts = ["a\x1cb", "promise a discount", "promise a discount, approved xx", "STRASSE STRAßE", "", None, "end", "a b", "end\n"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1, texts[1])], "doc_id long, text string")
    table = spark.createDataFrame(rules, "rule_id string, title string, summary string, category string, severity string, violation_patterns array<string>")
    literal = [policy.PolicyRule(i, t, s, c, "", (), tuple(p for p in ps or () if p is not None), v) for i, t, s, c, v, ps in rules]
    want = docs.select("doc_id", F.explode(policy.evaluate(F.col("text"), literal)["findings"]).alias("f")).select("doc_id", "f.rule_id", "f.matched_pattern")
    got = policy.enforce_table(docs, table, at_once=at_once).select("doc_id", "rule_id", "matched_pattern")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert policy.enforce_table(docs, table.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 2, 200])
def test_copied_hashes_against_a_loop(spark, monkeypatch, few):
    monkeypatch.setattr(evidence, "FEW", few)
    rng = random.Random(few)
    rows = [(i, rng.choice([None, *(f"h{k}" for k in range(300))])) for i in range(200)] + [(5, "h1"), (5, "h1"), (9, "h1")]
    df = spark.createDataFrame(rows, "seq long, leaf_hash string").withColumns({"prev_leaf_hash": F.col("leaf_hash"), "recomputed": F.col("leaf_hash")})
    got = sorted(r["seq"] for r in evidence.leaf_failures(df).where("check = 4").collect())
    places = {}
    for seq, digest in rows:
        places.setdefault(digest, set()).add(seq)
    assert got == sorted(sorted(at)[1] for digest, at in places.items() if digest and len(at) > 1) != []


def test_clean_leaves_are_not_shuffled_by_their_hashes(spark):
    df = spark.range(50).select(F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("leaf_hash"))
    df = df.withColumns({"prev_leaf_hash": F.lit(None).cast("string"), "recomputed": F.col("leaf_hash")})
    assert "hashpartitioning(leaf_hash" not in evidence.leaf_failures(df)._jdf.queryExecution().executedPlan().toString()

"""Rules tried by words first find what the expressions alone find, and findings are computed once."""

import random
import string

from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.functions.regex import Rules, folded, matches, needed
from sentrylake.functions.text import let
from sentrylake.operators import grading

PATTERNS = [r for *_, patterns in V.GRADING_VECTORS for r in patterns]


def test_words_of_an_expression():
    assert needed("(?:drop|side[- ]?effect|dropped)") == (("drop", "side effect", "side-effect", "sideeffect"), True)
    assert needed(r"max(?:imum)?.*(?:length|token)|truncat") == (("length", "token", "truncat"), False)
    assert needed(r"\w+|drop") == (None, False)
    assert needed(r"(?:kill\s*switch)?") == (None, False)


def test_folding_meets_the_letters_that_java_folds(spark):
    chars = spark.range(0x20, 0x1FFFF).where("id NOT BETWEEN 55296 AND 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    for letter in string.ascii_lowercase:
        found = chars.where(matches(F.col("c"), letter, "i") != F.contains(folded(F.col("c")), F.lit(letter)))
        assert found.isEmpty(), letter
    assert chars.where(F.length(folded(F.col("c"))) != F.length("c")).isEmpty()


def test_rules_by_words_equal_the_expressions(spark):
    rng = random.Random(5)
    words = Rules(PATTERNS).words + "do not never another agent only within the assigned task as untrusted maximum required \n . é ß 😀 K x".split(" ")
    odd = str.maketrans({"i": "İ", "s": "ſ", "k": "K"})
    change = [str.upper, str.title, lambda w: w.translate(odd), lambda w: w.replace("i", "ı"), *[str] * 4]
    texts = [rng.choice([" ", "", " "]).join(rng.choice(change)(rng.choice(words)) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rules = Rules(PATTERNS)
    by_words = let(folded(F.col("t")), lambda f: let(rules.there(f), lambda h: F.array(*(rules.matches(F.col("t"), f, h, p, flags) for flags, p in PATTERNS))))
    alone = F.array(*(matches(F.col("t"), p, flags) for flags, p in PATTERNS))
    rows = df.select("t", by_words.alias("a"), alone.alias("b")).collect()
    assert [r["t"] for r in rows if r["a"] != r["b"]] == []
    hit = [sum(r["b"][k] for r in rows) for k in range(len(PATTERNS))]
    assert sum(h > 0 for h in hit) >= len(PATTERNS) - 8 and all(h < len(rows) for h in hit)


def test_findings_are_computed_once(spark):
    df = spark.createDataFrame([(1, "Never guess.")], "k long, text string")
    long = grading.vectors_long(grading.grade(df), "k").select("k", "vector_id", "evidence")
    for out in (long, grading.compliance_violations(grading.grade(df, evidence=False), "k")):
        plan = out._jdf.queryExecution().optimizedPlan()
        below = plan.toString().split("Generate ")[1]
        assert "Filter" not in below and below.count("Project") == 1, below[:2000]
        assert out.count() > 0
    assert grading.vectors_long(grading.grade(df.where("k = 2")), "k").isEmpty()
    assert grading.vectors_long(grading.grade(df.select("k", F.repeat("text", 10_000).alias("text"))), "k").isEmpty()

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sentrylake.llm import html_crf, lm_mixing, nbsvm, toxicity
from sentrylake.llm.common import remainder


def test_segments_match_a_quadratic_search():
    rng = random.Random(1)
    scores = toxicity.Scores({"t": 1.0, "u": 0.4})
    for _ in range(200):
        words = [rng.choice("tuxxxxx") for _ in range(rng.randrange(25))]
        values = [scores.get(w, -0.12) for w in words]
        found = toxicity.segments(words, scores)
        best = max((sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)), default=0)
        assert abs(max((s for *_, s in found), default=0) - max(best, 0)) < 1e-9
        for a, b, s in found:
            assert abs(sum(values[a:b]) - s) < 1e-9 and s > 0
            assert all(sum(values[a:k]) > 0 for k in range(a + 1, b)) and all(sum(values[k:b]) > 0 for k in range(a + 1, b))
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def corpus(n=400):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(60)]
        bad, low = i % 5 == 0, i % 4 == 1
        if bad:
            for _ in range(6):
                text.insert(rng.randrange(60), rng.choice(["vile", "nasty"]))
        if low:
            text = [w + "***" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(not low), int(bad)))
    return rows + [(None, None), (n, ""), (0, rows[0][1])], labels


def test_classifiers_on_held_out_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    for k, (module, name) in enumerate(((nbsvm, "quality"), (toxicity, "toxic"))):
        model = module.train(docs, marks, name, remainder(F.col("doc_id"), 5) != 0)
        got = module.score(docs, model, keep=["doc_id"]).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        held = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
        assert sum(r["predicted"] == truth[r["doc_id"]][k] for r in held) >= 0.95 * len(held)
        assert module.score(docs.limit(0), model).count() == 0
    spans = toxicity.passages(docs, model, keep=["doc_id"]).where("doc_id = 5").first()["passages"]
    assert spans and "vile" in " ".join(s["words"] for s in spans) + "vile"
    empty = module.train(docs, marks.limit(0), "toxic", F.lit(True))
    assert module.score(docs, empty).count() == len(rows)
    assert nbsvm.score(docs, nbsvm.train(docs, marks.limit(0), "quality", F.lit(True))).count() == len(rows)


def test_base_scores_and_model(spark):
    rows, _ = corpus(120)
    rows.append((500, "UNSEEN " + "z" * 3000))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_tokens string")
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["\n"]
    learned = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in learned for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), len(tokens(t)), sum(w in counts for w in tokens(t)), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6))
        for i, t in rows
    )
    got = lm_mixing.train_and_score(df, remainder(F.col("doc_id"), 5) != 1).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert lm_mixing.train_and_score(df.limit(0), F.lit(True)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>
<div class="cookie-notice"><p>We use cookies. Accept?</p></div><nav><ul><li><a href="/">Home</a></li></ul></nav>
<article><h1>A &amp; B</h1><p>First  line
of <b>text</b> here.<p>Second &lt;para&gt; with a longer sentence in it.</p><script>var t="</p>";</script>
<form><p>Mail</p></form></article>
<section id="comments"><h3>Comments</h3><p>I think this is a very long reader comment about it.</p></section>
<aside><p>Related links</p></aside><footer>&copy; site</footer></body></html>"""


def test_html_extraction(spark):
    field = html_crf.default_field()
    assert field.text(PAGE) == "A & B\nFirst line of text here.\nSecond <para> with a longer sentence in it."
    held = html_crf.labelled_pages(120, seed=77)
    wrong = sum(x != y for found, labels in held for x, y in zip(field.decode(found), labels))
    assert wrong <= 0.02 * sum(len(labels) for _, labels in held)
    rows = [(1, PAGE, 3), (2, None, 3), (3, "", 3), (4, "<p", 3), (5, "<!-- x", 3), (6, "<script>a", 3)]
    df = spark.createDataFrame(rows, "page_id long, html string, n_chars int")
    got = {r["page_id"]: r for r in html_crf.extract(df).collect()}
    assert all(got[i]["text"] == "" and got[i]["n_chars"] == 0 for i in (2, 3, 4, 5, 6))
    assert html_crf.extract(df.limit(0)).count() == 0


def test_viterbi_is_the_best_labelling():
    import itertools

    rng = np.random.default_rng(0)
    f = html_crf.Field(steps=rng.normal(size=(2, 2)), ends=rng.normal(size=(2, 2)))
    for n in range(1, 7):
        values = rng.normal(size=n) * 2
        f.content = lambda b: b
        score = lambda y: sum(v for v, k in zip(values, y) if k) + f.ends[0, y[0]] + f.ends[1, y[-1]] + sum(f.steps[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert abs(score(f.decode(list(values))) - score(best)) < 1e-9


def test_markup_of_odd_pages_stays_out():
    texts = lambda page: [b.text for b in html_crf.blocks(page)]
    assert texts('<p title="a" b">One para.') == ["One para."]
    assert texts("<a href='x'y'>L") == ["L"]
    assert texts('<p title=">">q</p>') == ["q"]
    assert texts('x<y a="') == ["x"] and texts("1 < 2 <3") == ["1 < 2 <3"]
    assert texts("<script>if (a<b) x='</p>'</script><p>after") == ["after"]
    assert texts("<div><div><p>a<p>b</div>c</div>") == ["a", "b", "c"]


def test_long_odd_input_takes_linear_time():
    import time

    scores = toxicity.Scores({"t": 1.0})
    makers = [
        lambda n: toxicity.segments((["t"] + ["x"] * 20) * n, scores),
        lambda n: html_crf.blocks('<a "' * n),
        lambda n: html_crf.blocks('<a b="' * n),
        lambda n: html_crf.blocks("<span>" * n + "<h1>x</h1>" * n),
        lambda n: html_crf.blocks("<div>x" * n),
    ]
    for make in makers:
        took = []
        for n in (4000, 32000):
            began = time.process_time()
            make(n)
            took.append(time.process_time() - began)
        assert took[1] < 24 * max(took[0], 0.02)  # eight times the input; quadratic would be 64

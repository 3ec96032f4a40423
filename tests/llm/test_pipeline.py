import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sentrylake.llm import toxicity


def test_stages_in_order_keep_what_they_should(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    clean = [" ".join(word() for _ in range(80)) for _ in range(30)]
    rows = list(enumerate(clean))
    near = clean[3].split()
    near[40] = "changed"
    rows += [(100, clean[1]), (101, clean[1].upper()), (102, " ".join(near)), (103, "short"), (104, "x y z " * 40), (105, None)]
    rows += [(200 + i, clean[5 + i % 20] + f" vile nasty vile {i} nasty vile") for i in range(12)]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.Model(toxicity.Scores({"vile": 3.0, "nasty": 3.0}), 1.0, 0.001, (-4.0, 4.0, 1.0))
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: model)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in out}
    assert kept == (set(range(30)) - {1}) | {100}  # 101 shouts, 102 is near 3; of equal texts the largest id stays
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_id = dict(rows)
    assert all(r["doc_tokens"] == len(tok.encode(by_id[r["doc_id"]], add_special_tokens=False).ids) + 1 for r in out)
    assert sum(r["length"] for r in out) == sum({r["doc_id"]: r["doc_tokens"] for r in out}.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "exact dedup", "n-gram Jaccard join", "packing"]


def test_the_toxicity_stage_learns_from_labels_alone(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    toxic = {i for i in range(240) if i % 4 == 3}
    texts = {i: " ".join([word() for _ in range(60)] + (["vile", "nasty", "vile", "awful"] * 2 if i in toxic else [])) for i in range(240)}
    docs = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(None, None, "en", "s", None), (7, "", "en", "s", 0)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.toxicity_stage(spark, read, str(tmp_path))
    assert kept.columns == read.columns
    rows = kept.collect()
    assert {r["doc_id"] for r in rows if r["text"]} == set(range(240)) - toxic and sum(not r["text"] for r in rows) == 2
    assert corpus_pipeline.toxicity_stage(spark, read.limit(0), str(tmp_path)).count() == 0

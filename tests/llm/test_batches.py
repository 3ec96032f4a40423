"""Stages on large rows hand few of them to a Python task at once."""

import pyarrow as pa
import pytest

from sentrylake.llm import jaccard_partenum, lm_mixing, packing
from sentrylake.llm.common import materialise

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_a_written_table_bounds_its_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    before = spark.conf.get(NAME)
    made = materialise(spark.range(0, 100, 1, 1).mapInArrow(sizes, "n long"), "batches", batch=7)
    assert sorted(r["n"] for r in made.collect()) == [2] + [7] * 14
    assert spark.conf.get(NAME) == before


@pytest.mark.parametrize(("module", "tags"), [(lm_mixing, {"mixing-units", "mixing-sums", "mixing-documents", "mixing-scores"}), (jaccard_partenum, {"partenum-sets", "partenum-links", "partenum-more"})])
def test_large_rows_come_in_small_batches(spark, monkeypatch, module, tags):
    seen = {}

    def noted(df, tag, *a, batch=None, **k):
        seen[tag] = min(batch or 10_000, seen.get(tag, 10_000))
        return materialise(df, tag, *a, batch=batch, **k)

    monkeypatch.setattr(module, "materialise", noted)
    df = spark.createDataFrame([(k, f"one two three four five {k % 3}") for k in range(9)], "doc_id long, text string")
    if module is lm_mixing:
        from pyspark.sql import functions as F

        assert lm_mixing.train_and_score(df, F.lit(True)).count() == 9
    else:
        assert jaccard_partenum.near_duplicates(df).count() == 9
    assert all(seen[t] <= 2000 for t in tags & set(seen)) and seen.keys() & tags


def test_packing_gets_few_texts_at_once(spark, monkeypatch):
    import public_tokenizers

    seen = {}

    def noted(df, tag, *a, batch=None, **k):
        seen[tag] = batch
        return materialise(df, tag, *a, batch=batch, **k)

    monkeypatch.setattr(packing, "materialise", noted)
    df = spark.createDataFrame([(k, f"one two three {k % 3}") for k in range(9)], "doc_id long, text string")
    out = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"))
    assert out.select("row").distinct().count() == 9
    assert seen["packing-ids"] and seen["packing-ids"] <= 2000

"""The corpus pipeline: documents through five operators, each stage on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All stages but the last
return the columns of documents.

Defined cases: a null text is empty, has no words and goes with the quality
rules; a null doc_id takes part, is never learned from, and of equal or near
texts gives way to any id; repeated rows are copies of each other, one of them
stays; an empty table passes through all stages; without usable labels no
document is toxic beyond the smoothed share of none; other columns are kept up
to packing, which returns its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm import exact_trie, jaccard_partenum, packing, quality_rules, toxicity
from sentrylake.llm.common import discard, materialise, remainder, table

#: A document at or above this score is rejected as toxic.
TOXIC_CUT = 0.3
NEAR_WORDS, NEAR_PERCENT, SEQUENCE = 5, 80, 2048


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    policy = quality_rules.POLICIES[quality_rules.CURRENT]
    return quality_rules.ledger(docs).where(quality_rules.verdict(policy)).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity cut; labels are learned from the same rows as the operator's own query does."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, "toxic", remainder(F.col("doc_id"), 4) != 2)
    return toxicity.score(docs, model, cut=TOXIC_CUT).where("predicted = 0").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest doc_id."""
    return exact_trie.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return jaccard_partenum.keep_one(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences along the curve."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), sequence=SEQUENCE)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the segment model nor the packing; tests hold each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{k}")
        discard(before)
    return docs

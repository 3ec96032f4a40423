"""Registered queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_trie, html_crf, jaccard_partenum, lm_mixing, nbsvm, packing, quality_rules, sp_viterbi, token_counts, toxicity
from .common import remainder, table

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of every document with the current policy's verdict."""
    book = quality_rules.ledger(_documents(spark, sf_dir), keep=["doc_id"])
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.BASE_BITS).cast("long")) != 0
    return book.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "fail_bits",
        failed.alias("base_failed"),
        (~failed & quality_rules.verdict(quality_rules.POLICIES[quality_rules.CURRENT])).alias("kept"),
    )


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = remainder(F.col("doc_id"), 5)
    scored = lm_mixing.train_and_score(_documents(spark, sf_dir), fold != 1)
    return scored.select(
        "doc_id", _held_out(1, 5), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


def op3_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of each document's ids, and whether they decode to its text."""
    path = public_tokenizers.path(PIECE_MODEL)
    return sp_viterbi.digest_column(_documents(spark, sf_dir), path, keep=["doc_id"])


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_partenum.near_duplicates(_documents(spark, sf_dir), words=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECE_MODEL)
    return token_counts.token_counts(_documents(spark, sf_dir), path, limit=4096, keep=["doc_id"])


def _held_out(fold: int, folds: int):
    return F.coalesce(remainder(F.col("doc_id"), folds) == fold, F.lit(False)).alias("held_out")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", remainder(F.col("doc_id"), 4) != 2)
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", _held_out(2, 4), "score", "predicted")


def op8_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = nbsvm.train(docs, table(spark, sf_dir, "labels"), "quality", remainder(F.col("doc_id"), 5) != 0)
    return nbsvm.score(docs, model, keep=["doc_id"]).select("doc_id", _held_out(0, 5), "score", "predicted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_documents(spark, sf_dir), public_tokenizers.path(WORD_MODEL), sequence=2048)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_crf.extract(pages, keep=["page_id", "url"])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = exact_trie.assign(_documents(spark, sf_dir))
    return assigned.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_context_mixing,
        op3_sentencepiece_viterbi,
        op4_ngram_jaccard,
        op5_token_counts,
        op6_toxicity,
        op7_packing,
        op8_quality_nbsvm,
        op9_html_crf,
        op10_exact_dedup,
    )
}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w
  FROM documents),
win AS (
  SELECT rid, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS win
  FROM d, unnest(range(1, greatest(len(w) - 1, 1))) AS u(i) WHERE len(w) >= 3),
rep AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS k FROM win) WHERE k > 1)
  GROUP BY rid),
ln AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         (length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')))::BIGINT AS n_letters,
         (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_upper
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    | (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    | (CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END)
    | (CASE WHEN n_dup_lines * 2 > n_lines THEN 8 ELSE 0 END)
    | (CASE WHEN n_upper * 2 > n_letters THEN 16 ELSE 0 END)
    | (CASE WHEN word_chars < 2 * n_words OR word_chars > 30 * n_words THEN 32 ELSE 0 END)
    | (CASE WHEN n_letters * 4 < word_chars THEN 64 ELSE 0 END) AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits::BIGINT AS fail_bits,
       (bits & 3) <> 0 AS base_failed, bits = 0 AS kept FROM b
""",
    "op10_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256 FROM d
""",
}

"""Token counts from distinct pre-tokens.

Pieces are counted once per distinct pre-token of the whole table: tasks count
the occurrences of their own pre-tokens, equal ones meet, and each is encoded
once. The counts are joined to per-document pre-token frequencies and summed;
ids are never kept. Pre-tokens that make at least one occurrence in 2^HOT are
at most 2^HOT and are broadcast, so no key of the shuffled join is hot: the
rest are joined by a 64-bit hash. Pre-tokens that share one with another, if
there are any, are broadcast as well, so the join is exact.

For a model with word marks no piece crosses from a visible character to a
mark, so the words that start with marks are its pre-tokens.

Defined cases: null text is empty and has 0 tokens and 0 bytes; repeated rows
are counted each; an empty table gives no rows; an input column named like an
output column is replaced by it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, extend, hold, materialise, row_key

MARK = "▁"
#: A pre-token: the word with the marks before it. A line break is in no piece and cuts words further.
PRE_TOKEN = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
#: Characters of text handled at once, distinct pre-tokens a task holds before it passes them on, rank of a broadcast share.
BLOCK, HELD, HOT = 2_000_000, 400_000, 20


@functools.lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    whole = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in whole):
        raise ValueError("the model has pieces across words; its pre-tokens are not words")
    return sp


def piece_counts(sp, pre_tokens: list[str]) -> list[int]:
    """Tokens of each pre-token as it stands, without the dummy prefix."""
    # Encoded behind a line break, whose token no merge can join: the prefix and that token are two.
    lead = len(sp.encode("\n"))
    return [len(x) - lead for x in sp.encode(["\n" + w for w in pre_tokens], num_threads=1)]


def numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens, the number of each occurrence, and each text's end among these."""
    number: dict[str, int] = {}
    take = number.setdefault
    flat: list[int] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for k, text in enumerate(texts):
        if text:
            flat += [take(w, len(number)) for w in PRE_TOKEN.findall(MARK + text.replace(" ", MARK))]
        ends[k + 1] = len(flat)
    return list(number), np.array(flat, dtype=np.int32), ends


def blocks(column: pa.Array) -> Iterator[list[str]]:
    """Whole texts of a column, some BLOCK characters at a time; null as empty."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size > BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> pre_token, n: a task's own counts, passed on whenever it holds many."""
    hold(__name__)
    counts: dict[str, int] = {}

    def made() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pre_token", "n"])
        counts.clear()
        return out

    get = counts.get
    for batch in batches:
        for texts in blocks(batch.column(0)):
            words, flat, _ = numbered(texts)
            for w, n in zip(words, np.bincount(flat, minlength=len(words)).tolist()):
                counts[w] = get(w, 0) + n
            if len(counts) > HELD:
                yield made()
    yield made()


def pre_token_pieces(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """pre_token, n (occurrences in the table) and pieces, one row per distinct pre-token."""
    met = df.select(F.col(text_col).alias("text")).mapInArrow(_occurrences, "pre_token string, n long")

    def run(texts: list[str]) -> dict:
        return {"pieces": piece_counts(processor(model_path), texts)}

    distinct = met.groupBy("pre_token").agg(F.sum("n").alias("n"))
    return extend(distinct, "pre_token", run, [T.StructField("pieces", T.LongType())])


def token_counts(
    df: DataFrame, model_path: str, limit: int, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit."""
    new = ["n_bytes", "n_tokens", "over_limit"]
    keyed = pre_token_pieces(df, model_path, text_col).withColumn("key", F.xxhash64("pre_token"))
    pieces = materialise(keyed, "counts-pre-tokens")
    del keyed
    discard()  # the counts' shuffle only takes room from here on
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = total >> HOT
    # Hashes of several pre-tokens: hardly ever any, and no more than pairs over 2^64.
    twice = [r["key"] for r in pieces.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").toLocalIterator()]
    discard()
    common = (F.col("n") > share) | F.col("key").isin(twice)
    hot = {r["pre_token"]: r["pieces"] for r in pieces.where(common).select("pre_token", "pieces").toLocalIterator()}
    shared = df.sparkSession.sparkContext.broadcast(hot)
    wanted = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(wanted)]
    source = df.select(row_key().alias("row"), *kept, F.col(text_col).alias("text"))
    rest = T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.IntegerType())]))
    schema = T.StructType(
        [*source.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("hot", T.LongType()), T.StructField("rest", rest)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document: the sum over broadcast pre-tokens, and the frequencies of the others."""
        of = shared.value
        for batch in batches:
            low = 0
            for texts in blocks(batch.column(batch.num_columns - 1)):
                words, flat, ends = numbered(texts)
                known = np.fromiter((of.get(w, -1) for w in words), dtype=np.int64, count=len(words))
                each = known[flat]
                running = np.concatenate([[0], np.cumsum(np.maximum(each, 0))])
                doc = np.repeat(np.arange(len(texts)), np.diff(ends))
                cold = each < 0
                pair, times = np.unique(doc[cold] * max(len(words), 1) + flat[cold], return_counts=True)
                cuts = np.searchsorted(pair, np.arange(len(texts) + 1) * max(len(words), 1)).astype(np.int32)
                tail = (xxhash.xxh64_intdigest(w, seed=42) if k < 0 else 0 for w, k in zip(words, known))
                keys = np.fromiter(tail, dtype=np.uint64, count=len(words)).view(np.int64)[pair % max(len(words), 1)]
                part = batch.slice(low, len(texts))
                low += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(i) for i in range(batch.num_columns - 1)),
                        pa.array([len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass")) for x in texts], pa.int64()),
                        pa.array(np.diff(running[ends])),
                        pa.ListArray.from_arrays(
                            pa.array(cuts), pa.StructArray.from_arrays([pa.array(keys), pa.array(times, pa.int32())], names=["key", "n"])
                        ),
                    ],
                    names=schema.names,
                )

    documents = materialise(source.mapInArrow(run, schema), "counts-documents")
    discard()
    frequencies = documents.select("row", F.explode("rest").alias("e")).select("row", "e.key", "e.n")
    rare = pieces.where(~common).select("key", "pieces")
    sums = frequencies.join(rare.hint("shuffle_hash"), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("cold"))
    whole = documents.drop("rest").join(sums, "row", "left").withColumn("n_tokens", F.col("hot") + F.coalesce("cold", F.lit(0)))
    return whole.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(wanted)), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

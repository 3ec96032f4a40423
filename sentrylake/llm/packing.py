"""Packing along a space-filling curve.

Each document's ids are summed through a fixed random projection into three
dimensions; the point's Hilbert key orders the documents so that neighbours on
the curve are alike. Documents are range-partitioned by that key (ties are
spread by a hash, so a group of copies does not make one range heavy), every
range knows how many ids lie before it, and pieces are cut where the running
position meets a sequence boundary.

All sequences are full but those of the last ``sequence - 1`` ids at most,
which are cut into powers of two, so nothing is padded.

Defined cases: null text is empty and still gives its end id; repeated rows are
packed each; a null doc_id is carried through; an empty table gives no pieces;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, materialise, release, row_key

DIMS, BITS = 3, 10
#: Ids per range; distinct whitespace-separated words remembered per worker; words sent to the tokenizer at once.
RANGE_IDS, REMEMBERED, AT_ONCE = 4_000_000, 700_000, 4096
#: Texts that a Python task gets at once at most.
TEXT_ROWS = 1000
#: Most ranges (beyond that they grow and Spark's sort spills), and ids that count as one in cutting them.
MOST_RANGES, SHARE = 1 << 14, 512
#: Stretch of the projected mean before it is squashed into the grid.
SPREAD = 2.5
SEED = 20240229

TOKENS = "row long, doc_id long, curve long, n_ids long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, row long, curve long"
)


#: What a tokenizer must do for words to be coded one by one: these normalizers, and this pre-tokenizer before bytes.
LOWERING = ["NFC", "Replace", "Lowercase"]
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokens(dict):
    """Lower-cased words -> their ids as unsigned 32-bit numbers.

    A tokenizer with the steps above drops white space and merges within
    white-space-free runs only, so a text's ids are its words' ids one after
    another (``by_words``); any other one gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shape = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (shape["normalizer"] or {}).get("normalizers", [])]
        steps = (shape["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_words = kinds == LOWERING and steps[0].get("pattern", {}).get("Regex") == PRE_TOKEN and steps[-1].get("type") == "ByteLevel"
        self.parts: dict[str, bytes] = {}
        rng = np.random.default_rng(SEED)
        self.projection = rng.standard_normal((self.tokenizer.get_vocab_size(), DIMS)).astype(np.float32)

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(words)
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        parts = self.parts
        split = [parts_of(w) for w in new]
        merge, rest = self.tokenizer.model.tokenize, set()
        for x in split:
            for p in x:
                if p in parts:
                    continue
                if type(p) is bytes:
                    rest.add(p)
                else:  # a pre-token of its own: straight to the merges
                    signs = p if p.isascii() else p.encode().decode("latin-1").translate(SIGNS)
                    parts[p] = array("I", [t.id for t in merge(signs)]).tobytes()
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        whole = list(rest)
        for i in range(0, len(whole), AT_ONCE):
            some = whole[i : i + AT_ONCE]
            for p, e in zip(some, batch([p.decode("utf-8", "replace") for p in some], add_special_tokens=False)):
                parts[p] = array("I", e.ids).tobytes()
        for w, x in zip(new, split):
            self[w] = parts[x[0]] if len(x) == 1 else b"".join(map(parts.__getitem__, x))


#: Small Latin letters as far as U+017F, where lower-casing and composition change nothing of the tokenizer's.
PLAIN = re.compile(r"[!-~\u00a1-\u017f]+")
RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|.[^a-z0-9\u00aa\u00b2\u00b3\u00b5\u00b9\u00ba\u00bc-\u00be\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*")


#: Byte-level signs: bytes that are not printable in Latin-1 stand for the code points from 256 on.
SIGNS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}


def parts_of(word: bytes) -> list:
    """The tokenizer's own pre-tokens of a plain word; any other word whole, as bytes."""
    if len(word) > 200 or b"<|" in word:
        return [word]
    low = word.decode("utf-8", "replace")
    if not PLAIN.fullmatch(low):
        return [word]
    low = low.lower()
    return RUNS.findall(low) if PLAIN.fullmatch(low) and unicodedata.is_normalized("NFC", low) else [word]


@functools.lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (n, dims): Gray-code transform of the coordinates' bits."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - np.uint64(1)
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ swap)
        q >>= np.uint64(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        flip = np.where((x[dims - 1] & q) != 0, flip ^ (q - np.uint64(1)), flip)
        q >>= np.uint64(1)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def _words(text: str) -> list[bytes]:
    """White-space-free runs, A-Z lower-cased; the tokenizer's own lower-casing does the rest.

    A run with an opening of special strings stays as it is: the tokenizer looks for those in the given case.
    """
    raw = text.encode("utf-8", "replace")
    if b"<|" in raw:
        return [w if b"<|" in w else w.lower() for w in raw.split()]
    return raw.lower().split()


def tokenise(texts: list[str], path: str, end_id: int) -> tuple[list[bytes], np.ndarray]:
    """Per text its ids with the end id, and its curve position."""
    known = word_tokens(path)
    special = np.array([end_id], dtype="<u4").tobytes()
    ids: list[bytes] = []
    points = np.zeros((len(texts), DIMS), dtype=np.float32)
    for low in range(0, len(texts), 1000):
        if known.by_words:
            held = [_words(x) for x in texts[low : low + 1000]]
            known.learn(set().union(*held))
            bodies = (b"".join(map(known.__getitem__, words)) for words in held)
        else:
            coded = known.tokenizer.encode_batch(texts[low : low + 1000], add_special_tokens=False)
            bodies = (array("I", e.ids).tobytes() for e in coded)
        for body in bodies:
            if body:
                at = known.projection[np.frombuffer(body, dtype="<u4")]
                points[len(ids)] = at.mean(axis=0)
            ids.append(body + special)
    cells = ((np.tanh(points * SPREAD) + 1) / 2 * (1 << BITS)).astype(np.int64).clip(0, (1 << BITS) - 1)
    return ids, hilbert(cells)


def tokens_table(df: DataFrame, path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    source = df.select(row_key().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shift = 63 - DIMS * BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_tokens(path)
        hold(__name__, known, known.parts)
        for batch in batches:
            yield from coded(batch)
            release()  # else what a batch leaves behind is more than the words remembered

    def coded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low in range(0, batch.num_rows, TEXT_ROWS):
            part = batch.slice(low, TEXT_ROWS)
            ids, curve = tokenise([x or "" for x in part.column(2).to_pylist()], path, end_id)
            keys = [
                (c << shift) | (zlib.crc32(b"%d" % r, zlib.crc32(b)) & ((1 << shift) - 1))
                for c, r, b in zip(curve.tolist(), part.column(0).to_pylist(), ids)
            ]
            # 16 bits hold most ids: half the bytes to shuffle. A reader sees the width by the length.
            small = [(v if v.max() >> 16 else v.astype("<u2")).tobytes() for v in (np.frombuffer(b, dtype="<u4") for b in ids)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(keys, pa.int64()),
                    pa.array([len(b) // 4 for b in ids], pa.int64()),
                    pa.array(small, pa.binary()),
                ],
                names=["row", "doc_id", "curve", "n_ids", "ids"],
            )

    return source.mapInArrow(run, TOKENS)


class Layout:
    """Sequence boundaries over the global positions: full ones, then powers of two."""

    def __init__(self, total: int, sequence: int):
        self.sequence, self.full = sequence, total // sequence
        self.starts, at, rest = [], self.full * sequence, total % sequence
        size = 1 << max(sequence - 1, 1).bit_length()
        while rest:
            while size > rest:
                size >>= 1
            self.starts.append(at)
            at, rest = at + size, rest - size
        self.ends = [*self.starts[1:], at]

    def at(self, position: int) -> tuple[int, int, int]:
        """Sequence id, its start and its end."""
        i = position // self.sequence
        if i < self.full:
            return i, i * self.sequence, (i + 1) * self.sequence
        k = bisect.bisect_right(self.starts, position) - 1
        return self.full + k, self.starts[k], self.ends[k]


def pack(df: DataFrame, path: str, sequence: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """One row per piece of a document in a sequence."""
    spark = df.sparkSession
    tokens = materialise(tokens_table(df, path, id_col, text_col, end_id), "packing-ids", batch=TEXT_ROWS)
    n_rows, total = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    n_ranges = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_IDS + 1), MOST_RANGES)
    n_ranges = max(1, min(n_ranges, n_rows))
    # A document counts once per SHARE of its ids, so that ranges hold about as many ids each.
    weighed = tokens.select("curve", F.explode(F.sequence(F.lit(0), (F.col("n_ids") / SHARE).cast("int"))))
    cuts = sorted(set(weighed.approxQuantile("curve", [i / n_ranges for i in range(1, n_ranges)], 0.1 / n_ranges))) if n_ranges > 1 else []
    cuts = [int(c) for c in cuts]
    ranged = tokens.withColumn("range", _range_of(cuts))
    before, sizes = {}, ranged.groupBy("range").agg(F.sum("n_ids").alias("n")).collect()  # one row per range
    at = 0
    for r in sorted(sizes):
        before[r["range"]] = at
        at += r["n"]
    layout = Layout(total, sequence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(f"{__name__}.pieces")
        here, position = None, 0
        for batch in batches:
            out: list[tuple] = []
            ranges, rows, doc_ids, curves, sizes = (batch.column(i).to_pylist() for i in range(5))
            for r, row, doc_id, curve, n, body in zip(ranges, rows, doc_ids, curves, sizes, batch.column(5)):
                if r != here:
                    here, position = r, before[r]
                raw = body.as_py()
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                done = 0
                while done < n:
                    seq, start, end = layout.at(position)
                    length = min(n - done, end - position)
                    crc = zlib.crc32(ids[done : done + length].tobytes())
                    out.append((doc_id, done, length, crc, n, seq, position - start, end - start, row, curve))
                    done += length
                    position += length
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=NAMES)

    dealt = ranged.select("range", "row", "doc_id", "curve", "n_ids", "ids").repartitionById(len(cuts) + 1, F.col("range"))
    return dealt.sortWithinPartitions("range", "curve", "row").mapInArrow(run, PIECES)


NAMES = [x.split()[0] for x in PIECES.split(", ")]


def _range_of(cuts: list[int]):
    """Number of cuts at or below the curve key, by binary search within a constant array."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    bounds = F.array(*(F.lit(c).cast("long") for c in cuts))
    return F.aggregate(
        F.array(*(F.lit(s) for s in steps)),
        F.lit(0),
        lambda acc, s: F.when(
            (acc + s <= F.lit(len(cuts))) & (F.get(bounds, acc + s - 1) <= F.col("curve")), acc + s
        ).otherwise(acc),
    )

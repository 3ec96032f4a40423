"""Naive Bayes support vectors for text quality.

N-gram indicators (words, word shapes and repetition marks, hashed) are scaled
by the classes' log-count ratios; a linear hinge-loss model is fitted to them by
dual coordinate descent, mixed with its own mean weight, and calibrated on a
held-back part of the sample. The fit uses a bounded sample of labelled rows
(``bound``) in one task; scoring reads every whole text without a shuffle.

Defined cases: null text is empty and is scored like any other text; repeated
rows are scored each; with no usable label, or labels of one class only, every
score is the smoothed share of label 1; an empty table gives no rows; an input
column named like an output column is replaced by it.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extend, labelled_sample

WORD_BITS, SHAPE_BITS = 18, 14
SIZE = (1 << WORD_BITS) + (1 << SHAPE_BITS)
#: Labelled rows the fit may use, passes of the descent, its penalty, smoothing and mixing.
BOUND, PASSES, PENALTY, SMOOTH, MIX = 16_000, 12, 1.0, 1.0, 0.5
REMEMBERED = 700_000
#: Signs of a shape n-gram.
PIECE = 12



class Signs(dict):
    def __missing__(self, c: str) -> str:
        self[c] = k = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        return k


_SIGNS, _CAPITALS, _RUN = Signs(), re.compile("A{2,}"), re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    """A sign per run: A for one capital, B for more, a for small letters, 0 for digits, others themselves."""
    signs = "".join(map(_SIGNS.__getitem__, word))
    if "AA" in signs:
        signs = _CAPITALS.sub("B", signs)
    return _RUN.sub(r"\1", signs)


def pieces(word: str) -> list[int]:
    """Hashes of all runs of PIECE signs in a longer shape; none of a shorter one, which is a feature as a whole."""
    signs = shape(word)
    return [zlib.crc32(signs[k : k + PIECE].encode()) >> 1 for k in range(len(signs) - PIECE + 1)] if len(signs) > PIECE else []


class WordHashes(dict):
    """Words (bytes) -> hash of the lower-cased word << 32 | hash of its shape."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        text = word.decode("utf-8", "replace")
        made = zlib.crc32(text.lower().encode()) << 31 | zlib.crc32(shape(text).encode()) >> 1
        if len(word) <= 64:
            self[word] = made
        return made


class PieceHashes(dict):
    """Words (bytes) -> hashes of the pieces of a long shape."""

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) > REMEMBERED:
            self.clear()
        made = pieces(word.decode("utf-8", "replace"))
        if len(word) <= 64:
            self[word] = made
        return made


_HASHES, _PIECES = WordHashes(), PieceHashes()


def caches() -> tuple:
    return _HASHES, _PIECES


def features(text: str) -> np.ndarray:
    """Sorted distinct feature numbers of one whole text."""
    words = text.encode("utf-8", "replace").split()
    both = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    h = both >> np.uint64(31)
    s = both & np.uint64((1 << 31) - 1)
    word_mask, shape_mask = np.uint64((1 << WORD_BITS) - 1), np.uint64((1 << SHAPE_BITS) - 1)
    k1, k2, k3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    pairs = (h[:-1] * k1) ^ (h[1:] * k2)
    grams = [((h * k1) >> np.uint64(40)) & word_mask, (pairs >> np.uint64(40)) & word_mask]
    triples = pairs[:-1] ^ (h[2:] * k3)
    n = max(len(words), 1)
    repeated = 1 - len(np.unique(triples)) / len(triples) if len(triples) else 0.0
    doubled = float(np.count_nonzero(h[1:] == h[:-1])) / n
    marks = np.array(
        [
            1 + min(int(np.log2(n)), 20),
            32 + int(repeated * 10),
            64 + int(doubled * 10),
            96 + min(int(len(text) / n), 40) if words else 140,
            160 + int(10 * len(np.unique(h)) / n),
        ],
        dtype=np.uint64,
    )
    longer = [x for w in set(words) if len(w) > PIECE for x in _PIECES[w]]
    shapes = [s * k1, np.array(longer, dtype=np.uint64) * k1, (s[:-1] * k1) ^ (s[1:] * k2), (s[:-2] * k1) ^ (s[1:-1] * k2) ^ (s[2:] * k3), marks * k3]
    grams += [((x >> np.uint64(40)) & shape_mask) + np.uint64(1 << WORD_BITS) for x in shapes]
    return np.unique(np.concatenate(grams)).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # of the indicators: log-count ratio times fitted weight
    bias: float
    slope: float  # calibration of the margin
    shift: float

    def score(self, found: np.ndarray) -> float:
        margin = float(self.weights[found].sum()) / np.sqrt(max(len(found), 1)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def fit(docs: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
    """Dual coordinate descent on ratio-scaled indicators, each document scaled by its root length."""
    n = len(docs)
    ones = int(y.sum())
    prior = (ones + 1) / (n + 2)
    flat = Model(np.zeros(SIZE, np.float32), 0.0, 0.0, float(np.log(prior / (1 - prior))))
    if n < 20 or ones in (0, n):
        return flat
    order = np.random.default_rng(seed).permutation(n)
    held, used = order[: n // 5], order[n // 5 :]
    counts = np.full((2, SIZE), SMOOTH)
    for i in used:
        counts[y[i]][docs[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio = ratio.astype(np.float32)
    x = [ratio[docs[i]] / np.sqrt(len(docs[i])) for i in used]
    sign = np.where(y[used] == 1, 1.0, -1.0)
    # Rarer labels weigh more, so that both classes count alike.
    cost = np.where(y[used] == 1, n / (2 * ones), n / (2 * (n - ones))) * PENALTY
    square = np.array([float(v @ v) + 1 for v in x])
    w, bias, alpha = np.zeros(SIZE, np.float32), 0.0, np.zeros(len(used))
    rng = np.random.default_rng(seed + 1)
    for _ in range(PASSES):
        worst = 0.0
        for k in rng.permutation(len(used)):
            at, v, t = docs[used[k]], x[k], sign[k]
            gradient = t * (float(w[at] @ v) + bias) - 1
            new = min(max(alpha[k] - gradient / square[k], 0.0), cost[k])
            step = new - alpha[k]
            if step:
                w[at] += np.float32(step * t) * v
                bias += step * t
                alpha[k] = new
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    mean = float(np.abs(w).mean())
    mixed = ((1 - MIX) * mean + MIX * w) if mean else w
    model = Model((mixed * ratio).astype(np.float32), MIX * bias, 1.0, 0.0)
    margins = np.array([float(model.weights[docs[i]].sum()) / np.sqrt(max(len(docs[i]), 1)) + model.bias for i in held])
    model.slope, model.shift = calibrate(margins, y[held])
    return model


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, by Newton steps with a weak prior."""
    ones = int(y.sum())
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    scale = float(np.std(margin)) or 1.0
    x = np.stack([margin / scale, np.ones(len(margin))], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (p - target) + np.array([1e-3, 1e-3]) * b
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b = b - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0] / scale), float(b[1])


def train(
    df: DataFrame,
    labels: DataFrame,
    label_col: str,
    allowed: Column,
    bound: int = BOUND,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    sample = labelled_sample(df, labels, label_col, allowed, bound, id_col, text_col)
    numbers = extend(
        sample,
        "text",
        lambda texts: {"found": [features(x).tobytes() for x in texts]},
        [T.StructField("found", T.BinaryType())],
        ["doc_id", "y"],
        caches,
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(i).to_pylist() for i in range(3)))
        rows.sort(key=lambda r: (r[0], zlib.crc32(r[2])))  # as they come, tasks' rows have no order
        model = fit([np.frombuffer(r[2], np.int32) for r in rows], np.array([r[1] for r in rows], dtype=int))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return pickle.loads(numbers.repartition(1).mapInArrow(run, "model binary").first()[0])


def score(df: DataFrame, model: Model, cut: float = 0.3, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1) and predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> dict:
        scores = [shared.value.score(features(x)) for x in texts]
        return {"score": scores, "predicted": [int(s >= cut) for s in scores]}

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return extend(df, text_col, run, fields, keep, caches)

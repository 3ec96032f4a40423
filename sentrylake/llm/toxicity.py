"""Toxic passages by maximum-scoring segment search.

Token log-odds between toxic and other labelled texts, with a Dirichlet prior
from their common frequencies, give each significant token a positive score;
every other token costs a little. A linear-time scan finds all maximal
scoring segments of a text; a segment is significant by its extreme-value
(Gumbel) E-value, whose parameters come from labelled texts without the label.
A text's score is a calibrated function of its best and its significant
segments. The fit uses a bounded sample of labelled rows (``bound``); scoring
reads every whole text without a shuffle.

Defined cases: null text is empty and has no segment; repeated rows are scored
each; with no usable label every score is the smoothed share of label 1; an
empty table gives no rows; an input column named like an output column is
replaced by it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extend, labelled_sample

#: Labelled rows the fit may use; the prior's strength as a share of the counts; least z and log-odds of a
#: scored token.
BOUND, PRIOR, LEAST_Z, LEAST_ODDS = 60_000, 0.1, 3.0, 1.0
#: Cost of a token that is not scored: passages farther apart than a score's worth of it are separate.
COST = 0.12
#: Greatest E-value of a significant segment.
SIGNIFICANT = 0.01
#: Lengths of stems; tokens whose best form a worker remembers.
STEMS, REMEMBERED = (5, 7), 700_000
WORD = re.compile(r"\w+")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def forms(word: str) -> list[str]:
    """A token and its stems: long tokens also count by their beginnings."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


class Scores(dict):
    """Scores of forms; ``of`` remembers each token's best form, 0 for none."""

    def __init__(self, scores: dict[str, float]):
        super().__init__(scores)
        self.of = Best(self)

    def __reduce__(self):
        return Scores, (dict(self),)


class Best(dict):
    def __init__(self, scores: dict[str, float]):
        self.scores = scores

    def __missing__(self, word: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        best = max((self.scores.get(f, 0.0) for f in forms(word)), default=0.0)
        if len(word) <= 64:
            self[word] = best
        return best


def segments(words: list[str], scores: Scores, cost: float = COST) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a text, in order.

    The all-maximal-subsequences scan over the scored tokens; the cost of the
    unscored tokens between two of them is the fall in the running total.
    """
    # Start, end, total before, total after, and the nearest earlier segment that begins lower (-1: none). A
    # search follows those links; a segment it passes begins no lower than the new one, behind which no later
    # search visits it. So all searches together take linear time.
    found: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for i, score in [x for x in enumerate(map(scores.of.__getitem__, words)) if x[1]]:
        start, before = i, total - cost * (i - last - 1)
        last, total = i, before + score
        lower = len(found) - 1
        while lower >= 0 and found[lower][2] >= before:
            lower = found[lower][4]
        while lower >= 0 and found[lower][3] < total:  # joined with all from there
            start, _, before, _, further = found[lower]
            del found[lower:]
            lower = further
        found.append((start, i + 1, before, total, lower))
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


@dataclass
class Model:
    scores: Scores = field(default_factory=lambda: Scores({}))
    decay: float = 1.0  # lambda of the extreme-value law
    rate: float = 1.0  # its K
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)  # shift, best segment, significant segments

    def e_value(self, score: float, n: int) -> float:
        return float(self.rate * max(n, 1) * np.exp(-min(self.decay * score, 700.0)))

    def passages(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        return [(a, b, s, self.e_value(s, len(words))) for a, b, s in segments(words, self.scores)]

    def features(self, text: str) -> tuple[float, float]:
        words = tokens(text)
        found = self.passages(words)
        if not found:
            return 0.0, 0.0
        best = max(s for _, _, s, _ in found)
        strength = self.decay * best - np.log(self.rate * len(words))
        return float(np.log1p(max(strength, 0.0) + 1)), float(np.log1p(sum(e <= SIGNIFICANT for *_, e in found)))

    def score(self, text: str) -> float:
        best, count = self.features(text)
        a, b, c = self.weights
        return float(1 / (1 + np.exp(-np.clip(a + b * best + c * count, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    b = np.zeros(x.shape[1])
    b[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b)), x.T @ (p - y) + 1e-2 * b)
        b = b - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return b


def count_tokens(sample: DataFrame) -> DataFrame:
    """Texts with each token by label over the sample's whole texts, summed in each task first.

    A text counts a token once, so that one text full of a rare word proves nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[1 if y else 0].update({f for w in set(tokens(text or "")) for f in forms(w)})
            if len(counts[0]) + len(counts[1]) > 1_000_000:
                yield from rows(counts)
                counts = (Counter(), Counter())
        yield from rows(counts)

    def rows(counts):
        words = list(counts[0].keys() | counts[1].keys())
        for i in range(0, len(words), 100_000):
            part = words[i : i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), *(pa.array([c[w] for w in part], pa.int64()) for c in (counts[1], counts[0]))],
                names=["token", "ones", "zeros"],
            )

    each = sample.select("y", "text").mapInArrow(run, "token string, ones long, zeros long")
    return each.groupBy("token").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def train(
    df: DataFrame,
    labels: DataFrame,
    label_col: str,
    allowed: Column,
    bound: int = BOUND,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Scores from four fifths of the sample, laws and calibration from the rest."""
    sample = labelled_sample(df, labels, label_col, allowed, bound, id_col, text_col)
    spark = df.sparkSession
    rest = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(5)) == 0
    counts = count_tokens(sample.where(~rest)).cache()
    n1, n0 = counts.agg(F.coalesce(F.sum("ones"), F.lit(0)), F.coalesce(F.sum("zeros"), F.lit(0))).first()
    # The prior of a token is its common count, scaled; the prior of all tokens is the same share of all counts.
    a, total = F.lit(PRIOR) * (F.col("ones") + F.col("zeros")), PRIOR * (n1 + n0)
    odds = lambda n, name: F.log((F.col(name) + a) / (F.lit(n + total) - F.col(name) - a))
    delta = odds(n1, "ones") - odds(n0, "zeros")
    z = delta / F.sqrt(1 / (F.col("ones") + a) + 1 / (F.col("zeros") + a))
    scored = counts.where("ones > 1").select("token", delta.alias("delta"), z.alias("z")).where((F.col("z") >= LEAST_Z) & (F.col("delta") >= LEAST_ODDS))
    top = scored.collect()  # of the bounded sample's tokens
    model = Model(Scores({r["token"]: float(r["delta"]) for r in top}))
    counts.unpersist()
    shared = spark.sparkContext.broadcast(model.scores)

    def measure(texts: list[str]) -> dict:
        n, best = [], []
        for x in texts:
            words = tokens(x)
            n.append(len(words))
            best.append(max((s for _, _, s in segments(words, shared.value)), default=0.0))
        return {"n": n, "best": best}

    fields = [T.StructField("n", T.LongType()), T.StructField("best", T.DoubleType())]
    # Two numbers a row of the bounded sample.
    seen = extend(sample.where(rest), "text", measure, fields, ["y"]).collect()
    model.decay, model.rate = extreme_values([(r["n"], r["best"]) for r in seen if not r["y"]])
    shared_model = spark.sparkContext.broadcast(model)

    def describe(texts: list[str]) -> dict:
        found = [shared_model.value.features(x) for x in texts]
        return {"f1": [x[0] for x in found], "f2": [x[1] for x in found]}

    fields = [T.StructField("f1", T.DoubleType()), T.StructField("f2", T.DoubleType())]
    rows = extend(sample.where(rest), "text", describe, fields, ["y"]).collect()
    if rows:
        x = np.array([[1.0, r["f1"], r["f2"]] for r in rows])
        model.weights = tuple(logistic(x, np.array([float(r["y"]) for r in rows])))
    return model


def extreme_values(null: list[tuple[int, float]]) -> tuple[float, float]:
    """decay and rate of P(best > s) = 1 - exp(-rate * n * exp(-decay * s)) from texts without the label.

    Texts without any scored token say how rare one is; the mean excess of the
    others gives the decay.
    """
    if not null:
        return 1.0, 1.0
    hits = [s for _, s in null if s > 0]
    positions = sum(max(n, 1) for n, _ in null)
    if not hits:
        return 1.0, 0.5 / positions
    low = min(hits)
    decay = 1 / max(float(np.mean(hits)) - low + 0.5, 0.5)
    return float(decay), float(len(hits) / positions * np.exp(decay * low))


def score(df: DataFrame, model: Model, cut: float = 0.3, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1) and predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> dict:
        scores = [shared.value.score(x) for x in texts]
        return {"score": scores, "predicted": [int(s >= cut) for s in scores]}

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return extend(df, text_col, run, fields, keep, lambda: (shared.value.scores.of,))


def passages(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the significant segments: word numbers, score, E-value and the words."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("e_value", T.DoubleType()),
            T.StructField("words", T.StringType()),
        ]
    )

    def run(texts: list[str]) -> dict:
        out = []
        for x in texts:
            words = tokens(x)
            out.append(
                [
                    {"start": a, "end": b, "score": s, "e_value": e, "words": " ".join(words[a:b])}
                    for a, b, s, e in shared.value.passages(words)
                    if e <= SIGNIFICANT
                ]
            )
        return {"passages": out}

    return extend(df, text_col, run, [T.StructField("passages", T.ArrayType(kind))], keep, lambda: (shared.value.scores.of,))

"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores the failure bits
and the measurements. Policies are versioned masks applied afterwards, and
ablations come from bitwise aggregation of the bits: no text is read again.

Defined cases: a null or empty text has no words (all counts 0) and fails
``few_words``; repeated rows give repeated ledger rows; an empty table gives an
empty ledger; an input column named like a ledger column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extend

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper"]


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: Callable[[dict[str, Column]], Column]


#: A rule's bit never changes; new rules take new bits.
RULES = [
    Rule(0, "few_words", lambda m: m["n_words"] < 50),
    Rule(1, "repeated_windows", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 50),
    Rule(2, "symbols", lambda m: m["n_symbols"] > m["n_words"]),
    Rule(3, "duplicate_lines", lambda m: m["n_dup_lines"] * 2 > m["n_lines"]),
    Rule(4, "shouting", lambda m: m["n_upper"] * 2 > m["n_letters"]),
    Rule(5, "word_length", lambda m: (m["word_chars"] < m["n_words"] * 2) | (m["word_chars"] > m["n_words"] * 30)),
    Rule(6, "no_letters", lambda m: m["n_letters"] * 4 < m["word_chars"]),
]
BASE_BITS = 0b11


@dataclass(frozen=True)
class Policy:
    """Rejects a document when more than ``allowed`` of the masked rules fail."""

    version: str
    mask: int
    allowed: int = 0


POLICIES = {
    "v1-base": Policy("v1-base", BASE_BITS),
    "v2-content": Policy("v2-content", 0b1111111),
}
CURRENT = "v2-content"


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # splits at exactly 0x20 and 0x09-0x0D
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            first: dict[tuple, int] = {}
            covered = bytearray(n)
            for i, w in enumerate(windows):
                j = first.setdefault(w, i)
                if j != i:
                    covered[i : i + 3] = covered[j : j + 3] = b"\1\1\1"
            repeated = sum(covered)
    if raw.isascii():
        lower = text.lower()
        letters = sum(map(str.isalpha, text)) if len(raw) < 64 else len(raw) - len(raw.translate(None, _LETTERS))
        upper = sum(a != b for a, b in zip(text, lower)) if len(raw) < 64 else len(raw) - len(raw.translate(None, _CAPITALS))
    else:
        letters, upper = sum(map(str.isalpha, text)), sum(map(str.isupper, text))
    return n, word_chars, n_symbols, len(lines), len(lines) - len(set(lines)), repeated, letters, upper


_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _CAPITALS + _CAPITALS.lower()


def _columns(texts: list[str]) -> dict[str, list[int]]:
    rows = [measure(x) for x in texts]
    return dict(zip(MEASURES, map(list, zip(*rows)))) if rows else {m: [] for m in MEASURES}


def ledger(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: kept columns, measurements and ``fail_bits``."""
    measured = extend(df, text_col, _columns, [T.StructField(m, T.LongType()) for m in MEASURES], keep)
    m = {name: F.col(name) for name in MEASURES}
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(m), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def verdict(policy: Policy, bits: Column | None = None) -> Column:
    """True where the policy keeps a row of the ledger."""
    bits = F.col("fail_bits") if bits is None else bits
    return F.bit_count(bits.bitwiseAND(F.lit(policy.mask).cast("long"))) <= policy.allowed


def ablations(ledger_df: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: failures, sole failures, and kept rows without the rule.

    Rows collapse to distinct bit patterns first (at most 2^rules of them), so
    the shuffle holds patterns, not documents.
    """
    patterns = ledger_df.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = [r for r in RULES if policy.mask >> r.bit & 1]
    each = F.explode(
        F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("flag")) for r in rules))
    )
    long = patterns.select("fail_bits", "n", each.alias("r")).select("fail_bits", "n", "r.rule", "r.flag")
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    without = masked.bitwiseAND(F.bitwise_not(F.col("flag")))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return long.groupBy("rule").agg(
        F.lit(policy.version).alias("policy"),
        total(F.col("fail_bits").bitwiseAND(F.col("flag")) != 0).alias("n_failed"),
        total((F.bit_count(masked) > policy.allowed) & (F.bit_count(without) <= policy.allowed)).alias("n_only"),
        total(F.bit_count(masked) <= policy.allowed).alias("n_kept"),
        total(F.bit_count(without) <= policy.allowed).alias("n_kept_without"),
    )

"""Severity labels and their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER = ["none", "low", "medium", "high", "critical"]


def rank(label: str) -> int:
    return ORDER.index(label)


def rank_of(label: Column) -> Column:
    """0 for none and for unknown labels, up to 4 for critical."""
    out = F.lit(0)
    for k, name in enumerate(ORDER[1:], 1):
        out = F.when(label == name, k).otherwise(out)
    return out


def label_of(ordinal: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ORDER)), ordinal.cast("int") + 1)

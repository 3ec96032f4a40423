"""Aggregates over findings and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def findings_by(screened: DataFrame, *keys: str) -> DataFrame:
    """Flagged rows and findings by family over the given keys."""
    long = screened.select(*keys, F.explode("found").alias("f"))
    return long.groupBy(*keys, F.col("f.type").alias("family")).agg(F.count(F.lit(1)).alias("n_findings"))


def rollup(screened: DataFrame, *keys: str) -> DataFrame:
    """Row counts by the keys and all their prefixes; level says how many keys are summed over."""
    names = [F.col(k) for k in keys]
    return screened.rollup(*names).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def outcomes(decided: DataFrame, *keys: str) -> DataFrame:
    return decided.groupBy(*keys, "outcome").agg(F.count(F.lit(1)).alias("n"))

"""Usage attestation: continuity of sealed ranges and bounds from anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import as_of


def continuity_failures(seals: DataFrame, order_col: str = "pos") -> DataFrame:
    """pos, check, message for seals in proof order: range, billable, link and overlap.

    Columns: pos (from 1, without holes), seal_id, first_seq, last_seq, billable,
    prev_seal_hash, seal_hash. Holes between ranges are ordinary; overlaps are not.
    """
    before = seals.select((F.col(order_col) + 1).alias(order_col), F.col("seal_hash").alias("tip"), F.col("last_seq").alias("end"), F.lit(True).alias("has_before"))
    met = seals.join(before, order_col, "left")
    span = F.col("last_seq") - F.col("first_seq") + 1
    follows = F.col("has_before").isNotNull()
    tests = [
        (F.col("first_seq").isNull() | F.col("last_seq").isNull() | F.col("billable").isNull(), "malformed seal"),
        (F.col("last_seq") < F.col("first_seq"), "seal ends before it begins"),
        ((F.col("billable") < 0) | (F.col("billable") > span), "seal claims more than its leaves"),
        (follows & ~F.col("prev_seal_hash").eqNullSafe(F.col("tip")), "seal does not link to the one before"),
        (follows & (F.col("first_seq") <= F.coalesce("end", F.lit(0))), "seal overlaps the one before"),
    ]
    found = F.filter(
        F.array(*(F.when(t, F.struct(F.lit(k).alias("check"), F.lit(m).alias("message"))) for k, (t, m) in enumerate(tests, 1))),
        lambda x: x.isNotNull(),
    )
    return met.select(order_col, "seal_id", F.explode(found).alias("f")).select(order_col, "seal_id", "f.check", "f.message")


def continuity(seals: DataFrame, first_seq: int, last_seq: int, order_col: str = "pos") -> DataFrame:
    """One row: ok, error, billable. The first failure in proof order decides."""
    bad = continuity_failures(seals, order_col).agg(F.min(F.struct(order_col, "check", "message")).alias("bad"))
    whole = seals.agg(
        F.count(F.lit(1)).alias("n"), F.sum("billable").alias("billable"),
        F.min_by("first_seq", order_col).alias("opens"), F.max_by("last_seq", order_col).alias("closes"),
    )
    error = (
        F.when(F.col("n") == 0, F.when(F.lit(first_seq != last_seq), "empty continuity proof over a non-empty range"))
        .when(F.col("opens") != first_seq, "the proof opens elsewhere")
        .when(F.col("bad").isNotNull(), F.col("bad.message"))
        .when(F.col("closes") != last_seq, "the proof closes elsewhere")
    )
    return whole.crossJoin(bad).select(  # one row each
        error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull(), F.coalesce("billable", F.lit(0))).otherwise(0).alias("billable")
    )


def usage_bounds(anchors: DataFrame, first_seq: int, last_seq: int) -> DataFrame:
    """One row: lower and upper bound of the billable count over a range, from (last_seq, billable_through).

    lower: the widest rise among anchors within the range; upper: the rise
    between the anchors around it. Null where the anchors do not say.
    """
    at, through = F.col("last_seq"), F.col("billable_through")
    inside = at.between(first_seq - 1, last_seq)
    took = lambda fn, when: fn(F.when(when, through))
    known = anchors.where(at.isNotNull() & through.isNotNull())
    lower = F.when(took(F.count, inside) >= 2, took(F.max, inside) - took(F.min, inside))
    upper = took(F.min, at >= last_seq) - took(F.max, at <= first_seq - 1)
    return known.agg(lower.alias("lower"), upper.alias("upper"))


def anchor_before(starts: DataFrame, anchors: DataFrame, start_col: str = "start_seq") -> DataFrame:
    """The newest anchor at or before each start.

    Columns of anchors: chain, last_seq, billable_through; starts: chain, start_seq.
    """
    points = starts.select("chain", F.col(start_col).alias("at"))
    marks = anchors.select("chain", F.col("last_seq").alias("at"), "last_seq", "billable_through")
    found = as_of(points, marks, ["chain"], "at", F.struct("last_seq", "billable_through"))
    return found.select("chain", F.col("at").alias(start_col), "mark.last_seq", "mark.billable_through")


def attestation(seals: DataFrame, anchors: DataFrame, first_seq: int, last_seq: int, declared: int) -> DataFrame:
    """One row: continuity, bounds and whether the declared count stands."""
    proof = continuity(seals, first_seq, last_seq)
    bounds = usage_bounds(anchors, first_seq, last_seq)
    row = proof.crossJoin(bounds)  # one row each
    error = (
        F.when(~F.col("ok"), F.col("error"))
        .when(F.col("billable") != declared, "declared count is not the seals' sum")
        .when(F.col("lower") > declared, "declared count is below the anchors' lower bound")
        .when(F.col("upper") < declared, "declared count is above the anchors' upper bound")
    )
    return row.select(error.isNull().alias("ok"), error.alias("error"), "billable", "lower", "upper")

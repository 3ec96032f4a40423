"""Queries over orders reach every order, whatever its key."""

import pytest

from sentrylake.operators import usage
from sentrylake.plans import QUERIES

N = 9500


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orders"))
    spark.range(N).selectExpr("id AS o_orderkey").write.parquet(f"{path}/orders.parquet")
    return path


def test_leaf_failures_of_all_orders(spark, sf_dir):
    want = [(k, 3) for k in range(N) if k % 600 == 9] + [(k, 5) for k in range(1, N) if k % 500 == 7]
    assert sorted(map(tuple, QUERIES["bundle_leaf_failures"](spark, sf_dir).collect())) == sorted(want)


def test_continuity_of_all_orders(spark, sf_dir):
    want = [(g + 1, f"s{g}", 4) for g in range(N // 10) if g % 50 == 3]
    assert sorted(map(tuple, QUERIES["continuity_failures"](spark, sf_dir).collect())) == want
    assert QUERIES["continuity_check"](spark, sf_dir).first()["ok"] is False


def test_anchors_of_all_orders(spark, sf_dir):
    rows = sorted(tuple(r) for r in QUERIES["anchor_as_of"](spark, sf_dir).where("start_seq >= 3").collect())
    newest = [k - (k - 3) % 11 for k in range(3, N)]
    assert rows == [(1, k, a, 3 * a) for k, a in zip(range(3, N), newest)]
    early = QUERIES["anchor_as_of"](spark, sf_dir).where("start_seq < 3").collect()
    assert len(early) == 3 and all(r["last_seq"] is None for r in early)


def test_anchors_are_carried_over_empty_ranges(spark):
    anchors = spark.createDataFrame([(1, 5, 50), (1, 9000, 900), (2, 7, 70)], "chain long, last_seq long, billable_through long")
    starts = spark.createDataFrame([(1, 4), (1, 8999), (1, 90000), (2, 90000), (3, 1), (1, None)], "chain long, start_seq long")
    got = {(r["chain"], r["start_seq"]): r["billable_through"] for r in usage.anchor_before(starts, anchors).collect()}
    assert got == {(1, 4): None, (1, 8999): 50, (1, 90000): 900, (2, 90000): 70, (3, 1): None, (1, None): None}

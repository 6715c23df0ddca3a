"""Tables of pixels are merged, whatever size Spark takes them to have: they are not gathered to be broadcast."""

import pytest

from stradale.operators import skeleton
from stradale.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["skeletonize", "stitch_mosaic"])
def test_pixels_of_masks_are_not_broadcast(spark, name):
    df = QUERIES[name](spark, SF)
    assert "BroadcastHashJoin" not in plan(df) and df.count() > 0
    assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)


def test_pixels_of_skeletons_are_not_broadcast(spark, monkeypatch):
    seen, write = {}, skeleton.materialize
    monkeypatch.setattr(skeleton, "materialize", lambda df, name: seen.update({name: plan(df)}) or write(df, name))
    assert QUERIES["graph_edges"](spark, SF).count() > 0
    assert set(seen) == {"pixels", "touching", "kinds", "labelled", "member", "cross", "lines"}
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for name, p in seen.items() if name != "pixels")


def test_reports_are_told_one_after_the_other(spark):
    df = QUERIES["results_summary"](spark, SF)
    assert "Join" not in plan(df) and df.count() == 1

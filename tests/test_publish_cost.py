"""What publishing costs: lines are not shuffled by their keys, and bloom filters are as large as they need be."""

from pathlib import Path

from ledgerlens.plans import standins
from ledgerlens.sources import published


def test_flagging_shuffles_no_lines(spark):
    plan = standins.flagged_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(item_key" not in plan


def test_bloom_filters_fit_their_row_groups(spark, tmp_path):
    root = str(tmp_path / "p")
    published.publish(standins.flagged_lines(spark, "/root/testdata/sf0.001"), root)
    sizes = [f.stat().st_size for f in Path(root).glob("versions/*/facts/**/*.parquet")]
    assert sizes and max(sizes) < 400_000
    one = published.Published(spark, root)
    some = one.facts().first()["source_id"]
    assert one.by_ids([some]).count() >= 1


def test_whole_table_questions_do_not_publish(spark, monkeypatch):
    from ledgerlens.plans.registry import QUERIES

    def refused(*_):
        raise AssertionError("published")

    monkeypatch.setattr(standins, "_PUBLISHED", {})
    monkeypatch.setattr(published, "publish", refused)
    for name in ("flag_histogram", "price_trend_of_item", "catalog_adaptive_thresholds"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").columns

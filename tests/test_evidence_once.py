"""Lines that are checked, cited and derived from are the same rows: read from the table once."""


def test_evidence_reads_written_lines(spark):
    from ledgerlens.plans.registry import QUERIES

    plan = QUERIES["evidence_check"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and "sha1" not in plan

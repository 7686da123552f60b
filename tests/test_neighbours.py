"""Neighbours of all lines, and the work of finding them."""

from ledgerlens.operators import lines
from ledgerlens.plans.line_queries import QUERIES


def test_every_line_is_an_anchor(spark):
    found = QUERIES["neighbor_lines_all"](spark, "/root/testdata/sf0.001")
    assert found.select("anchor_id").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_neighbours_meet_by_blocks_of_rows(spark):
    rows = [(f"i{k}", "p" if k % 5 else "q", "s" if k % 3 else None, row) for k, row in enumerate([-9, -4, -3, 0, 1, 2, 3, 4, 5, 7, 8, 11, 12, 16, 17, 40, 41, 44, 45])]
    source = spark.createDataFrame(rows, "source_id string, source_path string, source_sheet string, source_row int")
    found = lines.neighbours(source, source, 4)
    want = sorted((a[0], b[0], b[3], b[3] - a[3]) for a in rows for b in rows if a[1:3] == b[1:3] and abs(a[3] - b[3]) <= 4)
    assert sorted(tuple(r) for r in found.collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in plan and "a_block" in plan  # the join's keys hold the block of rows

"""Where tables of unknown form begin and end, and that finding it doesn't grow with the square of a sheet."""

from ledgerlens.sources import layouts

HEAD, LINE, BLANK = ["a", "b", "c", "d"], ["x", "7"], ["", " "]
ROWS = "path string, sheet string, row_no int, cells array<string>"


def regions(spark, *cells):
    rows = spark.createDataFrame([("p", "s", n, c) for n, c in enumerate(cells, 1)], ROWS)
    return layouts.table_regions(rows)


def test_ends_of_tables(spark):
    places = lambda *cells: [tuple(r)[2:] for r in regions(spark, *cells).collect()]
    assert places(HEAD, LINE, LINE, BLANK, BLANK, LINE) == [(1, 2, 3)]
    # Two blank rows between a header and its first number end nothing.
    assert places(HEAD, BLANK, BLANK, LINE, LINE, ["note"]) == [(1, 4, 6)]
    assert places(HEAD, LINE, BLANK, BLANK, HEAD, LINE, LINE, BLANK, BLANK) == [(5, 6, 7)]
    assert places(HEAD, LINE, BLANK, BLANK, HEAD, LINE, BLANK, BLANK) == [(1, 2, 2)]
    assert places(HEAD, BLANK, BLANK, BLANK, LINE) == []


def test_no_frame_reaches_from_a_row_to_the_end(spark):
    plan = regions(spark, HEAD, LINE)._jdf.queryExecution().toString()
    assert "specifiedwindowframe(RowFrame, 1, unboundedfollowing$())" not in plan and "specifiedwindowframe(RowFrame, 1, 3)" in plan

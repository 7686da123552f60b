"""Groups of scanned files that hold outliers only."""

import duckdb
from pyspark.sql import functions as F

from ledgerlens.plans import validation_queries


def test_a_group_of_outliers_has_a_summary(spark):
    """The lines of sf0.01 that a summary raises by 5: one group has outliers only, and differs like any other."""
    data = "/root/testdata/sf0.01"
    found = validation_queries.validation_findings(spark, data).filter((F.col("check") == "V3") & (F.col("severity") == "soft"))
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(f"""SELECT subject, n, problems FROM ({validation_queries.ORACLES["validation_findings"]}) WHERE "check" = 'V3' AND severity = 'soft'""").fetchall()
    assert {(r["subject"], r["n"], r["problems"]) for r in found.collect()} == set(want)

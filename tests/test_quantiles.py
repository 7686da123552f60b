"""Exact percentiles, with a group that holds half of all rows, against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import catalog, quantiles, trends

SHARES = (0.0, 0.25, 0.5, 0.75, 0.995, 1.0)


def brute(rows):
    groups = {}
    for key, value in rows:
        if value is not None:
            groups.setdefault(key, []).append(value)
    return {k: (len(v), len(set(v)), min(v), max(v), [float(x) for x in np.quantile(np.array(v, float), SHARES)]) for k, v in groups.items()}


@pytest.mark.parametrize("ranged", [False, True])
def test_a_group_of_half_of_all_rows(spark, ranged):
    rng = random.Random(1)
    rows = [("hot", rng.choice((rng.randint(-50, 50), rng.randint(1, 10**6), 10**12 + rng.randint(0, 9)))) for _ in range(6000)]
    rows += [(f"g{k % 700}", rng.choice((0, None, rng.randint(1, 900)))) for k in range(6000)] + [("one", 7), ("same", 5), ("same", 5), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, v long").repartition(6)
    got = quantiles.spread(quantiles.value_counts(frame, ("k",), {"x": F.col("v")}).drop("kind"), ("k",), SHARES, ranged)
    want = brute(rows)
    found = {r["k"]: r for r in got.collect()}
    assert set(found) == set(want)
    for k, (n, d, low, high, p) in want.items():
        assert tuple(found[k])[1:5] == (n, d, low, high) and found[k]["p"] == pytest.approx(p, rel=1e-12)


def test_ranges_never_fall_and_split_a_hot_group(spark):
    rng = random.Random(2)
    values = sorted({0, 1, 2, 3, *(rng.choice((-1, 1)) * int(2 ** rng.uniform(0, 50)) for _ in range(900)), *range(1000, 1200), 2**62, -(2**62)})
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(quantiles.range_of(F.col("v"))).collect()]
    assert got == sorted(got) and max(map(abs, got)) <= 64 * quantiles.PARTS and len(set(got)) > 200


def test_both_plans_of_the_catalogue_agree(spark, monkeypatch):
    from ledgerlens.plans.catalog_queries import counted

    lines = counted(spark, "/root/testdata/sf0.001")
    rows = {}
    for name, size in (("small", 256 << 20), ("large", 0)):
        monkeypatch.setattr(quantiles, "RANGED_FROM", size)
        assert quantiles.large_input(lines) == (name == "large")
        rows[name] = [sorted(map(str, frame.collect())) for frame in (catalog.summaries(lines), trends.points(lines))]
    assert rows["small"] == rows["large"] and len(rows["small"][0]) > 50


def test_no_task_holds_a_group(spark):
    """In the plan for large inputs no aggregate gathers values: there is no percentile in it."""
    frame = spark.range(100).select(F.lit("a").alias("k"), F.col("id").alias("v"))
    plan = lambda ranged: quantiles.spread(quantiles.value_counts(frame, ("k",), {"x": F.col("v")}).drop("kind"), ("k",), (0.5,), ranged)._jdf.queryExecution().toString()
    assert "percentile(" in plan(False) and "percentile(" not in plan(True)

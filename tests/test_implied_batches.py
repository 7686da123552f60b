"""Implied prices of many groups at once: as of each alone, and no Python call for each group."""

from collections import Counter

import numpy as np

from ledgerlens.operators import implied


def _groups(n):
    rng = np.random.default_rng(7)
    for _ in range(n):
        base = int(rng.integers(1, 60_000)) if rng.random() < 0.7 else int(rng.integers(1, 9)) * 10 ** int(rng.integers(0, 6))
        size = int(rng.integers(1, 40))
        amounts = base * rng.integers(1, int(rng.choice([4, 30, 260])), size)
        amounts = np.where(rng.random(size) < rng.choice([0, 0.1, 0.3]), amounts + rng.integers(1, 9, size), amounts)
        found = Counter(amounts.tolist())
        yield np.array(sorted(found)), np.array([found[a] for a in sorted(found)])


def test_bases_of_many_groups_are_those_of_each():
    groups = list(_groups(1_500))
    want = {k: b for k, (values, counts) in enumerate(groups) if (b := implied.implied_base(values, counts))}
    starts = np.concatenate([[0], np.cumsum([len(values) for values, _ in groups])])
    got = implied.implied_bases(np.concatenate([v for v, _ in groups]), np.concatenate([c for _, c in groups]), starts)
    assert len(want) > 300 and {int(k): (int(b), int(s)) for k, b, s in zip(*got, strict=True)} == want


def test_groups_meet_python_in_batches(spark):
    rows = [(k, 27_900 * m) for k in range(1_200) for m in ((5, 8, 10) if k % 2 else (1, 2))]
    found = implied.implied_prices(spark.createDataFrame(rows, "k int, amount_thb long").repartition(3), "k")
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(k, 27_900, 3, 3) for k in range(1, 1_200, 2)]
    assert implied.implied_prices(spark.createDataFrame([], "k int, amount_thb long"), "k").count() == 0

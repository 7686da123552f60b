"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import ann
from ledgerlens.llm.hilbert import hilbert_keys


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = [x for n, x in enumerate(good) if not any(x[0] == y[0] and (x[1] == y[1]).all() for y in good[:n])]
    out = {}
    for i, v in good:
        if i % 50 == 0:
            near = sorted((-(v @ w) / np.sqrt((v @ v) * (w @ w)), j) for j, w in good if j != i)
            out[i] = [j for _, j in [(round(s, 12), j) for s, j in near]][:k]
    return out


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).round(3).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[50][1]) for k in range(20)] + [(50, rows[50][1])]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] + [1.0] * 7), (2003, [None] + [1.0] * 7), (2004, [1.0] * 3), (None, [1.0] * 8), (2050, [float("inf")] + [1.0] * 7)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    want = brute(rows, 5)
    assert set(got) == set(want)
    for q, near in got.items():
        assert [n for n, _ in near] == [1, 2, 3, 4, 5]
        assert [j for _, j in near] == want[q], q
    assert got[50] == [(n + 1, 1000 + n) for n in range(5)]


def test_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], kind), F.col("vec_id") % 50 == 0).count() == 0
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], kind), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(spark.createDataFrame([(0, [1.0, 0.0])], kind), F.col("vec_id") % 50 == 0).count() == 0


def test_recall_of_the_query_at_the_default_reach(spark):
    """The registered query on vectors without structure; other columns of the table are ignored."""
    from ledgerlens.llm.queries import op3_ann

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x = np.stack(table["embedding"].to_numpy()).astype(float)
    u, ids = x / np.linalg.norm(x, axis=1, keepdims=True), table["vec_id"].to_numpy()
    got = op3_ann(spark, "/root/testdata/sf0.1").toPandas()
    hits = 0
    for q, near in got.groupby("query_id"):
        at = int(np.flatnonzero(ids == q)[0])
        s = u @ u[at]
        assert near.sort_values("rank")["rank"].tolist() == [1, 2, 3, 4, 5] and near.sort_values("rank")["score"].is_monotonic_decreasing
        assert np.allclose(near["score"], [s[int(np.flatnonzero(ids == j)[0])] for j in near["vec_id"]], atol=1e-12)
        s[at] = -2
        hits += len(set(near["vec_id"]) & set(ids[np.argsort(-s)[:5]].tolist()))
    assert got["query_id"].nunique() == (ids % 50 == 0).sum() and hits / len(got) >= 0.9


def test_lots_of_guests_and_extra_columns_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=8).tolist(), "x", k) for k in range(1200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids string, entry long")
    once = sorted(map(tuple, ann.nearest(table, F.col("vec_id") % 50 == 0).collect()))
    monkeypatch.setattr(ann, "GUEST_ROWS", 3)
    assert sorted(map(tuple, ann.nearest(table, F.col("vec_id") % 50 == 0).collect())) == once and len(once) == 24 * 5


def test_recall_with_windows_that_matter(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 16))).astype(np.float32)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(table, F.col("vec_id") % 50 == 0, reach=0.05).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = set()
    for q in range(0, 4000, 50):
        s = u @ u[q]
        s[q] = -2
        want |= {(q, int(j)) for j in np.argsort(-s)[:5]}
    assert len(got & want) / len(want) >= 0.9


def test_hilbert_neighbours_touch():
    grid = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    keys = hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1

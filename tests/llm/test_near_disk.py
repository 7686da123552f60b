"""Disk of the near-dedup: shuffle files go with their query, quadratic groups write few pairs, the paths for many rows lose nothing."""

import os
import time

import numpy as np

from ledgerlens.llm import shared, simhash_dedup


def texts(n):
    """Texts of 60 words that begin with one of a few passages; every third one is a near copy of the one before."""
    rng, out = np.random.default_rng(5), []
    for k in range(n):
        own = [f"w{x}" for x in rng.integers(0, 100_000, 50)]
        out.append((k, out[-1][1] + " end" if k % 3 == 2 else " ".join([f"common{k % 2}"] * 3 + [f"passage{i}" for i in range(12)] + own)))
    return out


def kept(spark, rows):
    docs = shared.staged(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted(r["doc_id"] for r in simhash_dedup.keep_one(docs, words=5, similarity=0.8).collect())


def test_many_rows_give_what_few_give(spark, monkeypatch):
    rows = [*texts(240), (7, texts(8)[7][1]), (500, None), (501, None)]
    want = kept(spark, rows)
    assert len(want) == 161
    monkeypatch.setattr(simhash_dedup, "NAMED_LIMIT", 0)
    assert kept(spark, rows) == want


def test_a_sieve_keeps_what_is_looked_for(spark):
    rows, wanted = spark.range(5_000).withColumnRenamed("id", "k"), spark.range(0, 5_000, 7).withColumnRenamed("id", "k")
    got = {r["k"] for r in shared.sieved(rows, wanted, "k").filter("__may").collect()}
    assert got >= set(range(0, 5_000, 7)) and len(got) < 800
    assert shared.sieved(rows, wanted.limit(0), "k").filter("__may").count() == 0


def test_signatures_lose_no_similar_pair():
    rng = np.random.default_rng(3)
    for _ in range(200):
        both, a, b = (rng.integers(-(2**63), 2**63 - 1, n) for n in rng.integers(0, 300, 3))
        a, b = np.union1d(both, a), np.union1d(both, b)
        apart = int(np.unpackbits((simhash_dedup.signature(a) ^ simhash_dedup.signature(b)).view(np.uint8)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_shuffle_files_go_with_their_query(spark):
    roots = [spark._jsc.sc().env().blockManager().diskBlockManager().localDirs()[0].getPath()]
    files = lambda: sum(name.startswith("shuffle_") for root in roots for _, _, names in os.walk(root) for name in names)
    before, until = files(), time.monotonic() + 20
    shared.staged(spark.range(100_000).repartition(4, "id"))
    while files() > before and time.monotonic() < until:  # they are deleted beside the next query
        time.sleep(0.1)
    assert files() <= before

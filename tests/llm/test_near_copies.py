"""Near copies by the similarity of their shingles, against brute force."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import pipeline, simhash_dedup
from ledgerlens.llm.shared import staged
from tests.llm.test_documents_ops import brute_classes, brute_fingerprint
from tests.llm.test_pipeline import _cut, brute_similar


@pytest.mark.parametrize("limit, common", [(64, 20), (3, 20), (3, 3)])
def test_edited_copies_go(spark, monkeypatch, limit, common):
    monkeypatch.setattr(simhash_dedup, "STAR_LIMIT", limit)
    monkeypatch.setattr(simhash_dedup, "COMMON_DOCS", common)
    rng = random.Random(11)
    lexicon = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    passage, texts = [rng.choice(lexicon) for _ in range(60)], []
    for n in (8, 40, 90, 150):
        base = [rng.choice(lexicon) for _ in range(n)]
        texts += [" ".join(base), " ".join(base).upper().replace(" ", "\n")]
        for edits in (1, 1, 2, 2, 3, 3, 4, 6, 9):
            copy = list(base)
            for at in rng.sample(range(n), min(edits, n)):
                copy[at] = rng.choice(lexicon)
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [rng.choice(lexicon) for _ in range(n)]) for n in (0, 5, 5, 10, 20, 60)] + [None, "", " \n ", "ab cd", "AB cd"]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 1))
    kept = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=5, similarity=0.8)
    want = brute_similar(rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    far = [(a, b) for a in texts for b in texts if a and b and (brute_fingerprint(a) ^ brute_fingerprint(b)).bit_count() > 2]
    assert far and len(want) < len({tuple((t or "").lower().split()) for t in texts})


def test_near_duplicate_stage(spark):
    """The stage on given documents; edited copies that are more than two bits apart go. The next stage works on what is left."""
    docs = staged(pipeline.quality(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), ""))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    left = staged(pipeline.near_duplicates(spark, docs, ""))
    assert left.columns == docs.columns
    ids = {r["doc_id"] for r in left.collect()}
    assert ids == brute_similar(rows) and ids != {c for _, _, c in brute_classes([(i, brute_fingerprint(t)) for i, t in rows])}
    cut = pipeline.repeated_passages(spark, left, "")
    assert Counter((r["doc_id"], r["text"]) for r in cut.collect()) == Counter(_cut(left.collect()))


def test_fingerprints_find_near_copies(spark, monkeypatch):
    """Fingerprints and trees alone, without the search by shared shingles, join what lies within their radius and is similar."""
    monkeypatch.setattr(simhash_dedup, "_may_match", lambda percent: F.lit(False))
    rng = random.Random(4)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(5_000)}" for _ in range(400)]
        for _ in range(4):
            rows.append((len(rows) + 1, " ".join(base)))
            base[rng.randrange(400)] = "new"
    rows += [(len(rows) + k, "w " * k) for k in (1, 2, 9, 30)]  # one shingle or few, and repeats of one: fingerprints of a set
    sets = {i: simhash_dedup.shingle_set(t, 5) for i, t in rows}
    prints = {i: simhash_dedup.set_fingerprint(x) & (1 << 64) - 1 for i, x in sets.items()}
    label = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2 and 9 * len(set(sets[a].tolist()) & set(sets[b].tolist())) >= 4 * (len(sets[a]) + len(sets[b])):
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    kept = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=5, similarity=0.8)
    assert {r["doc_id"] for r in kept.collect()} == set(label.values()) and len(set(label.values())) < len(rows) - 12

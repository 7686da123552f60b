"""Terms found by forms against edit distance over the whole vocabulary; the kept index against one built anew."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import search
from ledgerlens.sources.search_index import KeptIndex


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def damaged(rng, word):
    for _ in range(rng.randint(0, max(1, len(word) // 4))):
        k, how = rng.randrange(len(word) + 1), rng.randrange(3)
        word = word[:k] + (rng.choice("abc") if how else "") + word[k + (how != 1) :]
    return word


def test_forms_lose_no_term(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 22))) for _ in range(300)} | {"12", "12.5", "125", "ab", "ก", "กขค", "กขคง"}
    terms = sorted({damaged(rng, w) for w in rng.sample(sorted(words), 60)} - {""} | {"12", "12.5", "ab", "กขคง", "abc"})
    vocabulary = spark.createDataFrame([(w,) for w in words], "term string")
    got = {(r["asked"], r["term"]): r["weight"] for r in search.matched_terms(search.spellings(vocabulary), terms).collect()}
    want = {}
    for a in terms:
        loose = len(a) > 2 and not a.replace(".", "", 1).isdigit()
        for w in words:
            e = edits(a, w)
            if w == a:
                want[a, w] = 1.0
            elif loose and w.startswith(a):
                want[a, w] = search.PREFIX_WEIGHT * len(a) / len(w)
            elif loose and e <= int(len(a) * search.FUZZY):
                want[a, w] = search.FUZZY_WEIGHT * len(a) / (len(a) + e)
    assert got == pytest.approx(want) and len(want) > 80


def test_no_nested_loop(spark):
    items = spark.createDataFrame([(k, f"item number {k} of kind {k % 7}") for k in range(50)], "id long, key string")
    plan = search.hits(search.build_index(items), ["itme", "numbers"], (50, 6.0))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.fixture
def texts():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(40)]
    return {k: " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for k in range(120)}


def frame(spark, texts):
    return spark.createDataFrame([(k, t, k % 5) for k, t in texts.items()], "id long, key string, n_lines long")


def same(index, items, queries):
    """The kept index against one built for the question."""
    assert sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, search.build_index(items).collect()))
    assert index.release.n == items.count()
    for q in queries:
        found = search.search(search.build_index(items), items, q, 20)
        got = index.search(items, q, 20)
        assert [(r["id"], r["rank_score"]) for r in got.collect()] == [(r["id"], r["rank_score"]) for r in found.collect()]
        assert {r["total"] for r in got.collect()} <= {index.ranked(items, q).count()}


def test_merging_changes_additions_and_removals(spark, tmp_path, texts):
    asked = [texts[20], texts[5][:3]]
    first = {k: t for k, t in texts.items() if k >= 8}
    index = KeptIndex(spark, f"{tmp_path}/i").build(frame(spark, first))
    same(index, frame(spark, first), asked)
    later = {k: (f"new {t}" if k % 20 == 0 else t) for k, t in texts.items() if k != 77}
    index, how = index.refresh(frame(spark, later))
    assert how == "merged" and len(index.release.segments) == 2
    same(index, frame(spark, later), asked)
    # back again: an id that went comes back, changed texts change once more
    index, how = index.refresh(frame(spark, texts))
    assert how == "merged" and len(index.release.segments) == 3
    same(index, frame(spark, texts), asked)
    assert index.refresh(frame(spark, texts).repartition(3))[1] == "fresh"
    assert KeptIndex(spark, f"{tmp_path}/i").release == index.release
    index, how = index.refresh(frame(spark, {k: t + " more" for k, t in texts.items()}))
    assert how == "rebuilt" and len(index.release.segments) == 1


def test_many_segments_are_built_anew(spark, tmp_path, texts, monkeypatch):
    monkeypatch.setattr("ledgerlens.sources.search_index.MOST_SEGMENTS", 2)
    index, states = KeptIndex(spark, f"{tmp_path}/i"), []
    for k in range(4):
        index, how = index.refresh(frame(spark, texts | {200 + j: "one more" for j in range(k)}))
        states.append(how)
    assert states == ["rebuilt", "merged", "rebuilt", "merged"]


def test_an_empty_index(spark, tmp_path, texts):
    none = frame(spark, texts).filter("id < 0")
    index = KeptIndex(spark, f"{tmp_path}/i").build(none)
    assert index.search(none, "abc").count() == 0 and index.refresh(none)[1] == "fresh"
    index, how = index.refresh(frame(spark, texts))
    assert how == "rebuilt" and index.release.n == len(texts)


def test_postings_of_other_letters_are_pruned(spark, tmp_path, texts):
    index = KeptIndex(spark, f"{tmp_path}/i").build(frame(spark, texts))
    plan = index.hits(["abc"])._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "NestedLoop" not in plan
    assert index.suggestions(frame(spark, texts), texts[3]).first()["key"] == texts[3]


def test_filters_come_before_the_limit(spark, tmp_path, texts):
    items = frame(spark, texts).withColumns({"years": F.array((F.col("id") % 3).cast("int")), "has_unit_price": F.col("id") % 2 == 0})
    index = KeptIndex(spark, f"{tmp_path}/i").build(items)
    got = index.search(items, texts[3], 3, years=(1,), priced_only=True)
    assert all(r["id"] % 3 == 1 and r["id"] % 2 == 0 for r in got.collect()) and {r["total"] for r in got.collect()} == {index.ranked(items, texts[3], (1,), True).count()}

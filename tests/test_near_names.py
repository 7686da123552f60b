"""Names that are like each other: found by pieces, the same as by comparing all with all."""

import random

from pyspark.sql import functions as F

from ledgerlens.operators import orgs


def _names():
    rng = random.Random(3)
    known = {f"Supplier#{k:09d}" for k in range(60)} | {"".join(rng.choices("abกข ", k=rng.randint(1, 60))).strip() for _ in range(120)}
    asked = set(known)
    for name in sorted(known) * 2:
        letters = list(name)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(letters))
            letters[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "a"])
        asked.add("".join(letters))
    return sorted(asked - {""}), sorted(known - {""})


def test_near_names_equal_all_pairs(spark):
    asked, known = _names()
    asked = spark.createDataFrame([(a, "p") for a in asked], "key string, parent string")
    known = spark.createDataFrame([(k, "p") for k in known] + [("Supplier#000000001", "q")], "spelling string, parent string")
    pairs = asked.join(known, "parent").filter(orgs.likeness(F.col("key"), F.col("spelling")) >= orgs.MIN_SIMILARITY)
    want = {(r["key"], r["spelling"]) for r in pairs.collect()}
    found = orgs._near(asked, known, ["parent"])
    assert len(want) > 300 and {(r["key"], r["near"]) for r in found.collect()} == want
    assert {(r["key"], r["near"]) for r in orgs._near(asked.drop("parent"), known.drop("parent").distinct(), []).collect()} == want

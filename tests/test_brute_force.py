"""Registered queries that SQL can't express, against plain Python."""

import re
import unicodedata
from collections import defaultdict
from itertools import combinations
from math import gcd

from ledgerlens.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def folded(text):
    x = unicodedata.normalize("NFC", text).lower()
    x = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", x)
    x = re.sub(r"(?<!\d)\.|\.(?!\d)", " ", x)
    x = "".join(" " if c != "." and unicodedata.category(c)[0] in "PS" else c for c in x)
    return " ".join(x.split())


def test_folding_of_whole_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: r["folded"] for r in QUERIES["fold_text"](spark, DATA).collect()}
    assert got == {k: folded(t) for k, t in texts.items()}


def best_base(amounts):
    """Tries every subset that drops up to three rows."""
    amounts = [a for a in amounts if a > 0]
    n = len(amounts)
    if n < 3:
        return None
    middle = sorted(amounts)[n // 2] if n % 2 else sum(sorted(amounts)[n // 2 - 1 : n // 2 + 1]) / 2
    for dropped in range(min(3, n - max(-(-n * 6 // 10), 3)) + 1):
        found = []
        for out in combinations(range(n), dropped):
            kept = [a for i, a in enumerate(amounts) if i not in out]
            base = gcd(*kept)
            multiples = {a // base for a in kept}
            if base >= middle * 0.01 and not (base >= 10_000 and len(str(base).rstrip("0")) <= 1) and max(multiples) <= 200 and len(multiples) >= 2:
                found.append(base)
        if found:
            return max(found), n - dropped
    return None


def test_implied_prices_of_all_small_parts(spark):
    import math

    amounts = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").collect():
        part = r["l_partkey"]
        price = r["l_extendedprice"]
        amounts[part].append(int(math.floor(price + 0.5)) if r["l_linenumber"] == 7 else int(r["l_quantity"] * (2500 + part % 97 * 100)))
    got = {r["l_partkey"]: (r["value_thb"], r["support_rows"]) for r in QUERIES["implied_unit_price"](spark, DATA).collect()}
    small = {k: v for k, v in amounts.items() if len(v) <= 24}
    want = {k: best_base(v) for k, v in small.items()}
    assert small and {k: v for k, v in got.items() if k in small} == {k: v for k, v in want.items() if v}

"""Host-level quality rules.

Each document is measured and judged by fixed base rules. The failures are counted
by host, each host's failure rate is shrunk towards the mean of all hosts by a beta prior
that is itself estimated from the hosts, and hosts whose shrunk rate is too high take all
their documents with them.

Defined results
* null text: no words, all measures zero, base rule failed.
* empty or blank text: as null text.
* null host: documents without a host form one host of their own.
* repeated rows count, and are judged, once for each row.
* an empty table gives an empty result.
* other columns are ignored; ``keep_good`` returns them untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType

from .shared import SPACES, free_name, staged

#: A document with fewer words fails.
MIN_WORDS = 10
#: A document with more than this percentage of its words in repeated windows fails.
MAX_REPEAT_PERCENT = 20
#: Words in a window.
WINDOW = 5
#: A host whose shrunk failure rate is above this is rejected.
MAX_HOST_RATE = 0.5
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of WINDOW words that occurs twice or more; exact."""
    n, windows = len(words), len(words) - WINDOW + 1
    if windows < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    code, base = ids[:windows].copy(), len(seen)
    top = base
    for k in range(1, WINDOW):
        if top * base >= 1 << 62:  # number the distinct codes so far, to keep products exact
            distinct, code = np.unique(code, return_inverse=True)
            top = len(distinct)
        code *= base
        code += ids[k : k + windows]
        top *= base
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    inside = np.zeros(n, bool)
    for k in range(WINDOW):
        inside[k : k + windows] |= again
    return int(inside.sum())


def measure_text(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes.split() splits at exactly the six characters of SPACES
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


@pandas_udf(StructType([StructField(name, LongType()) for name in MEASURES]))
def _measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure_text(t) for t in texts], columns=list(MEASURES), dtype="int64")


def base_failed(m: str = "") -> Column:
    n, r = F.col(f"{m}n_words"), F.col(f"{m}n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", host: str = "source") -> DataFrame:
    """``keep``, ``host``, the five measures and ``base_failed`` of each document."""
    out = docs.select(*[F.col(c) for c in keep], F.col(host).alias("host"), _measures(F.col(text)).alias("m"))
    return out.select(*keep, "host", "m.*").withColumn("base_failed", base_failed())


def host_verdicts(measured: DataFrame) -> DataFrame:
    """Per host: ``host_docs``, ``host_failed``, ``host_rate`` (shrunk) and ``host_good``.

    The beta prior's two parameters come from the mean and the variance of the hosts' own rates, by
    moments; without variance the prior weighs like one host of mean size.
    """
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    hosts = staged(hosts)
    rate = F.col("host_failed") / F.col("host_docs")
    row = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg("host_docs").alias("n")).first()
    m, v, n = (row["m"] or 0.0), (row["v"] or 0.0), (row["n"] or 1.0)
    weight = min(n, m * (1 - m) / v - 1) if v > 0 and m * (1 - m) > v else n
    shrunk = (F.col("host_failed") + F.lit(m * weight)) / (F.col("host_docs") + F.lit(weight))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_good", F.col("host_rate") <= MAX_HOST_RATE)


def judge(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """One row for each document: doc_id, host, the measures, base_failed, host_docs, host_failed, host_rate, kept."""
    measured = staged(measures(docs, text=text, host=host))
    verdicts = host_verdicts(measured)
    out = measured.join(verdicts.withColumnRenamed("host", "__host"), F.col("host").eqNullSafe(F.col("__host")), "left").drop("__host")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_good")).drop("host_good")


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that both the base rules and their host's verdict keep, with all their columns.

    Texts never move: they are measured once to count failures by host, and once more where they are kept.
    """
    counted = measures(docs, keep=(), text=text, host=host)
    m, rejected = free_name(docs, "__m"), free_name(docs, "__bad_host")
    bad = host_verdicts(counted).filter(~F.col("host_good")).select(F.col("host").alias(rejected))
    good = docs.withColumn(m, _measures(F.col(text))).filter(~base_failed(f"{m}.")).drop(m)
    return good.join(bad, good[host].eqNullSafe(bad[rejected]), "left_anti")

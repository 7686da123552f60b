"""Target-distribution importance resampling over hashed word n-grams.

Every run of one to two words of a text falls into a hash bucket. The buckets are counted over all
documents and over a target collection; a bucket's gain is the logarithm of how much commoner it is in
the target. A document weighs the mean gain of its features, and documents are drawn without replacement
by the largest weight plus Gumbel noise, which a hash of the document's id decides.

Texts are met in lots: the texts of a lot are joined with a separator that no word can hold, one pass of a
pattern finds all words, a binary search of the documents' offsets tells each word's document, and runs that
would reach over a separator are masked before the buckets are counted.

Each task counts all its texts into one dense row of buckets, which leaves as rows of ``WIDTH`` counts; these are
summed by Spark, and the driver gets one number for each bucket. The order of the draw is a range-partitioned sort;
ranks are a partition's first rank and the row's place in it, so no task holds all documents.

Defined results
* null, empty or blank text, or one without a word: no features, weight 0, never drawn.
* very long texts are counted whole, as a lot of their own.
* null doc_id: noise as for an empty id; last among equal scores.
* repeated rows: each row counts, is weighed and may be drawn; rows equal in score and id may change places.
* a target that is empty or null counts nothing: gains come from the smoothing alone. An empty table gives an empty result.
* other columns are ignored by ``ranked``, ``resample`` returns them untouched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import free_name, release, staged

BUCKETS = 10_000
#: Words of the longest feature.
LONGEST = 2
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Of lower-cased UTF-8: digits, small letters and everything beyond ASCII.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BETWEEN = b"\n"
#: Bytes of the texts that are joined at a time; it bounds memory only.
LOT_BYTES = 1 << 20
#: Counts in a row that a task sends.
WIDTH = 100


def lots(texts: pd.Series) -> Iterator[list[bytes]]:
    """The texts in order, lower-cased in A-Z, in lots of about LOT_BYTES."""
    lot, held = [], 0
    for text in texts:
        data = text.encode().lower() if text else b""
        if lot and held + len(data) > LOT_BYTES:
            yield lot
            lot, held = [], 0
        lot.append(data)
        held += len(data)
    if lot:
        yield lot


def features(lot: list[bytes], buckets: int, longest: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text of the lot; for each run length the buckets and the texts of all runs that stay within a text."""
    ends = np.cumsum([len(x) + len(_BETWEEN) for x in lot])
    words, starts = [], []
    for found in _WORD.finditer(_BETWEEN.join(lot)):
        words.append(found[0])
        starts.append(found.start())
    owner = np.searchsorted(ends, np.array(starts, np.int64), side="right")
    out, codes = [], list(map(crc32, words))
    for n in range(1, longest + 1):
        if n > 1:  # the code of n words goes on from that of the n - 1 before
            codes = list(map(crc32, words[n - 1 :], map(crc32, repeat(b" "), codes)))
        last = owner[n - 1 :]
        inside = owner[: len(last)] == last
        out.append((np.array(codes[: len(last)], np.int64)[inside] % buckets, last[inside]))
    return np.bincount(owner, minlength=len(lot)), out


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all ``docs`` fall into each bucket."""
    rows = -(-buckets // WIDTH)
    names = [f"c{k}" for k in range(WIDTH)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(rows * WIDTH, np.int64)
        for frame in batches:
            for lot in lots(frame["text"]):
                for codes, _ in features(lot, buckets, longest)[1]:
                    total += np.bincount(codes, minlength=len(total))
        if total.any():
            out = pd.DataFrame(total.reshape(rows, WIDTH), columns=names)
            out.insert(0, "slice", np.arange(rows, dtype="int32"))
            yield out

    sent = docs.select(F.col(text).alias("text")).mapInPandas(count, "slice int, " + ", ".join(f"{n} long" for n in names))
    out = np.zeros((rows, WIDTH), np.int64)
    for row in sent.groupBy("slice").agg(*[F.sum(n).alias(n) for n in names]).collect():  # one row for each slice
        out[row["slice"]] = row[1:]
    return out.ravel()[:buckets]


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio) of each bucket."""
    s_all, t_all, n = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weigher(gain: np.ndarray, longest: int = LONGEST):
    """A column function: text -> (n_words, n_features, weight)."""

    @pandas_udf("n_words long, n_features long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = []
            for lot in lots(texts):
                words, runs = features(lot, len(gain), longest)
                n, total = np.zeros(len(lot), np.int64), np.zeros(len(lot), np.int64)
                for codes, owner in runs:
                    n += np.bincount(owner, minlength=len(lot))
                    np.add.at(total, owner, gain[codes])
                parts.append(np.stack([words, n, total // np.maximum(n, 1)], 1))
            yield pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, 3), np.int64), columns=["n_words", "n_features", "weight"])

    return weigh


def noise(key: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) decided by sha256 of ``seed:key``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _ranked(docs: DataFrame, target: DataFrame, keep: list[str], percent: int, seed: int, least_words: int) -> DataFrame:
    gain = gains(bucket_counts(docs), bucket_counts(target))
    # Repeated calls of one function on one column are one evaluation; the struct is kept whole until it is written.
    met = docs.select(*keep, weigher(gain)(F.col("text")).alias("m"))
    score = F.col("m.weight") + noise(F.col("doc_id"), seed)
    scored = staged(met.select(*keep, "m.n_words", "m.n_features", "m.weight", score.alias("score"), F.monotonically_increasing_id().alias("__uid")))
    drawn = percent * scored.filter(F.col("n_words") >= least_words).count() // 100
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("n_words") < least_words, F.desc("score"), F.asc_nulls_last("doc_id"), F.col("__uid")]
    ordered = staged(scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    release(scored)
    part, at = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND((1 << 33) - 1)
    starts, before = [], 0
    for row in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():  # one row for each partition
        starts.append((row["p"], before))
        before += row["n"]
    firsts = docs.sparkSession.createDataFrame(starts, "__part int, __before long")
    rank = F.col("__before") + at + 1
    out = ordered.withColumn("__part", part).join(F.broadcast(firsts), "__part")
    return out.withColumn("rank", F.when(rank <= drawn, rank)).drop("__part", "__before", "__at", "__uid")


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn), n_words of each document of ``docs`` (doc_id, text), drawn towards ``target`` (text)."""
    out = _ranked(docs.select("doc_id", "text"), target, ["doc_id"], percent, seed, least_words)
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """The drawn documents with all their columns."""
    row, key = free_name(docs, "__row"), free_name(docs, "__drawn")
    whole = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    found = _ranked(whole.select("doc_id", "text", F.col(row).alias("row")), target, ["doc_id", "row"], percent, seed, least_words)
    drawn = found.filter(F.col("rank").isNotNull()).select(F.col("row").alias(key))
    return whole.join(drawn.hint("merge"), F.col(row) == F.col(key), "left_semi").select(*docs.columns)

"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A document's features are the hashed n-grams of 3 to 6 bytes that its lower-cased text holds (present or
not). Counts of documents by feature and class give log-count ratios; the features with the strongest
ratios are scaled by them, and a logistic regression is fitted on the scaled features.

The fit takes a bounded sample: about ``SAMPLE_ROWS`` labelled documents of each class at most, chosen by a
hash, whole texts of these, one text for each doc_id; classes are weighed back to their true sizes. The model's parameters
are the ``FEATURES`` strongest features that are in ``MIN_DOCS`` sampled documents at least, and the penalty ``L2``.

Defined results
* null or empty text: the score of a text without features.
* documents whose labels contradict each other are not learnt from; rows without doc_id are neither learnt from nor held out.
* no label, or one class only: the share of label 1 (0.5 without any) is everyone's score.
* of several texts with one doc_id, the one of the smallest hash is learnt from, so that the sample is bounded in rows.
* repeated rows are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .shared import staged

SAMPLE_ROWS = 4_000
GRAMS = (3, 4, 5, 6)
BUCKET_BITS = 20
#: Features that the regression gets, and in how many sampled documents each is at least.
FEATURES = 6_000
MIN_DOCS = 5
SMOOTH = 1.0
STEPS = 300
L2 = 1.0
_PIECE = 1 << 20


def buckets(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct hash buckets of the text's n-grams, if ``wanted`` (a mask by bucket) is given only those in it."""
    data = np.frombuffer(f" {(text or '').lower()} ".encode(), np.uint8)
    found = []
    for at in range(0, len(data), _PIECE):
        piece = data[at : at + _PIECE + max(GRAMS) - 1].astype(np.uint64)
        code = piece[:0]
        for size in range(1, max(GRAMS) + 1):
            if len(piece) < size:
                break
            code = piece if size == 1 else (code[: len(piece) - size + 1] << np.uint64(8)) | piece[size - 1 :]
            if size in GRAMS:
                with np.errstate(over="ignore"):
                    hashed = (code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size) * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9)
                hashed = (hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
                found.append(hashed if wanted is None else hashed[wanted[hashed]])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int32)
    for rows in batches:
        for text, toxic in zip(rows["text"], rows["toxic"], strict=True):
            counts[int(toxic), buckets(text)] += 1
    hit = np.flatnonzero(counts.any(axis=0))
    yield pd.DataFrame({"bucket": hit, "no": counts[0, hit], "yes": counts[1, hit]})


@dataclass
class Model:
    weights: np.ndarray  # by bucket; 0 where the bucket is no feature
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias + (float(self.weights[buckets(text, self.weights != 0)].sum()) if text else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _regress(columns: np.ndarray, starts: np.ndarray, toxic: np.ndarray, scale: np.ndarray, case: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over the rows' features; row i has columns[starts[i]:starts[i + 1]]."""
    rows = np.repeat(np.arange(len(toxic)), np.diff(starts))
    values, n = scale[columns], len(toxic)
    w, b = np.zeros(len(scale)), float(np.log((case @ toxic + 1e-9) / (case @ (1 - toxic) + 1e-9)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    case = case / case.sum()
    for t in range(1, STEPS + 1):
        z = b + np.bincount(rows, values * w[columns], n)
        error = case * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - toxic)
        g, gb = np.bincount(columns, values * error[rows], len(w)) + L2 * w / n, float(error.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 * (1 - t / (STEPS + 1))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**t)) / (vb**0.5 / (1 - 0.999**t) ** 0.5 + 1e-9)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic (0 or 1)."""
    agreed = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    agreed = agreed.filter(F.col("toxic") == F.col("most")).select("doc_id", "toxic")
    sizes = {r["toxic"]: r["n"] for r in agreed.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, none = sum(sizes.values()), np.zeros(1 << BUCKET_BITS)
    if len(sizes) < 2:
        share = sizes.get(1, 0) / total if total else 0.5
        return Model(none, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(13), "doc_id"), 11) / float(1 << 53)
    share = F.when(F.col("toxic") == 1, min(1.0, sample_rows / sizes[1])).otherwise(min(1.0, sample_rows / sizes[0]))
    chosen = agreed.filter(chance < share)  # about 2 * sample_rows rows at most: small enough to send to all
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    sample = staged(texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).drop("doc_id"))
    counts = sample.mapInPandas(_count, "bucket long, no long, yes long").groupBy("bucket").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    found = counts.filter(F.col("no") + F.col("yes") >= MIN_DOCS).toPandas().sort_values("bucket")
    seen = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    no, yes = found["no"].to_numpy(), found["yes"].to_numpy()
    ratio = np.log((yes + SMOOTH) / (seen.get(1, 0) + 2 * SMOOTH)) - np.log((no + SMOOTH) / (seen.get(0, 0) + 2 * SMOOTH))
    best = np.sort(np.argsort(-np.abs(ratio) * np.sqrt(no + yes), kind="stable")[:FEATURES])
    features, scale = found["bucket"].to_numpy()[best], ratio[best]
    wanted = np.zeros(1 << BUCKET_BITS, bool)
    wanted[features] = True
    mask = docs.sparkSession.sparkContext.broadcast(wanted)

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"toxic": rows["toxic"], "hits": [buckets(t, mask.value).tobytes() for t in rows["text"]]})

    rows = sample.mapInPandas(hits, "toxic int, hits binary").collect()
    toxic = np.array([r["toxic"] for r in rows], np.float64)
    lists = [np.searchsorted(features, np.frombuffer(r["hits"], np.int32)) for r in rows]
    case = np.where(toxic == 1, sizes[1] / max(1, seen.get(1, 0)), sizes[0] / max(1, seen.get(0, 0)))
    if not lists:
        return Model(none, float(np.log(sizes[1] / sizes[0])))
    w, b = _regress(np.concatenate(lists), np.cumsum([0, *map(len, lists)]), toxic, scale, case)
    none[features] = w * scale
    return Model(none, b)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf(DoubleType())
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", scores(F.col(text)))


def rate(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from labels of documents that aren't held out, scored for all."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    docs = docs.select("doc_id", "text")
    model = fit(docs, labels.filter(fold != held))
    scored = score(docs.withColumn("held_out", F.coalesce(fold == held, F.lit(False))), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

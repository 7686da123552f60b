"""Periodic runs of words: seeds of guaranteed overlap, extended along diagonals.

A run is a stretch of words with smallest period q, at least ``LEAST_WORDS`` and three periods long, that no neighbour
extends. Its words equal those q further on over at least max(LEAST_WORDS - q, 2q) places: that is one stretch on the
diagonal of lag q, and every k-gram in it occurs again q words later.

Lags are met in classes. Lags up to a third of LEAST_WORDS share k = LEAST_WORDS - that third; beyond, lags from Q to 1.5 Q have
k = 2 Q, so each run has a k-gram pair in its class. A k-gram of a run of that class can't have a period of Q / 2
or less (both periods together would fit into it, and their common divisor would be a smaller period of the run), so its next
occurrences are over Q / 2 apart, and the pair of lag q is among its next two: the pairs that are enumerated are at most two
for each place, and no run is lost. A table holds, for each lag, the place up to which its diagonal has been covered: a pair
below it lies on a stretch already extended. A stretch whose lag is a multiple of a smaller period is dropped.

Documents don't meet each other, so nothing is shuffled: a document is one row, and takes time n log n in its words.

Defined results
* null, empty or blank text: no words, no run.
* null doc_id: ``planted`` leaves the words as they are.
* very long texts are taken whole. Repeated rows give a row each. An empty table gives an empty result.
* ties of the strongest run go to the smaller start, then to the smaller period.
* other columns are ignored by ``digests``, ``collapse`` returns them untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: A run has at least so many words,
LEAST_WORDS = 24
#: and so many periods.
LEAST_PERIODS = 3


def lag_classes(n: int) -> Iterator[tuple[int, int, int]]:
    """(smallest lag, largest lag, k) of each class that a text of n words may have runs of."""
    low, high, k = 1, LEAST_WORDS // LEAST_PERIODS, LEAST_WORDS - LEAST_WORDS // LEAST_PERIODS
    while low * LEAST_PERIODS <= n and n >= LEAST_WORDS:
        yield low, high, k
        low = high + 1
        high, k = low * 3 // 2, low * 2


class Grams:
    """Names of the k-grams of a text: equal names, equal words. Doubled from shorter names, and only where these occur twice."""

    def __init__(self, ids: np.ndarray):
        self.size, self.names, self.at = 1, ids, np.arange(len(ids))

    def _joined(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and names of the grams of ``size`` words, from two overlapping grams of self.size, where both occur twice."""
        place = np.full(self.at[-1] + 1 if len(self.at) else 0, -1)
        place[self.at] = np.arange(len(self.at))
        second = self.at + (size - self.size)
        has = second < len(place)
        has[has] = place[second[has]] >= 0
        pair = self.names[has] * (int(self.names.max(initial=0)) + 1) + self.names[place[second[has]]]
        _, names, counts = np.unique(pair, return_inverse=True, return_counts=True)
        twice = counts[names] > 1
        return self.at[has][twice], names[twice]

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places, in order, and names of all k-grams that occur twice or more; k never falls between calls."""
        while self.size * 2 <= k and len(self.at):
            self.at, self.names = self._joined(self.size * 2)
            self.size *= 2
        return (self.at, self.names) if self.size == k or not len(self.at) else self._joined(k)


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words of two stretches are equal; blocks of doubling size."""
    n, done, block = min(len(a), len(b)), 0, 32
    while done < n:
        end = min(n, done + block)
        differ = a[done:end] != b[done:end]
        if differ.any():
            return done + int(differ.argmax())
        done, block = end, block * 2
    return n


def _has_shorter(ids: np.ndarray, start: int, lag: int) -> bool:
    """Whether a run of period ``lag`` has a smaller one: with three periods it would divide ``lag``."""
    block, rest, factor = ids[start : start + 2 * lag], lag, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            p = lag // factor
            if (block[p:] == block[:-p]).all():
                return True
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return False


def find_runs(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    grams, runs = Grams(ids), []
    for low, high, k in lag_classes(len(ids)):
        at, names = grams.of(k)
        if not len(at):
            break  # no k-gram occurs twice, so no longer one does
        order = np.argsort(names, kind="stable")
        same = names[order][1:] == names[order][:-1]
        places = at[order]
        seeds = [(places[:-1][same], places[1:][same])]
        both = same[1:] & same[:-1]
        seeds.append((places[:-2][both], places[2:][both]))
        here = np.concatenate([a for a, _ in seeds])
        lag = np.concatenate([b - a for a, b in seeds])
        fits = (lag >= low) & (lag <= high)
        here, lag = here[fits], lag[fits]
        order = np.lexsort((here, lag))
        here, lag = here[order], lag[order]
        first = np.ones(len(here), bool)  # pairs side by side lie on one stretch
        first[1:] = (lag[1:] != lag[:-1]) | (here[1:] != here[:-1] + 1)
        covered: dict[int, int] = {}
        for t, q in zip(here[first].tolist(), lag[first].tolist(), strict=True):
            if t < covered.get(q, 0):
                continue
            end = t + k + _reach(ids[t + k :], ids[t + k + q :])
            start = t - _reach(ids[:t][::-1], ids[q : t + q][::-1])
            covered[q] = end
            length = end - start + q
            if length >= max(LEAST_WORDS, LEAST_PERIODS * q) and not _has_shorter(ids, start, q):
                runs.append((start, length, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run repeats: each run leaves its first period only."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        drop[start + q] += 1
        drop[start + length] -= 1
    inside = np.cumsum(drop[:-1]) > 0
    return [w for w, d in zip(words, inside.tolist(), strict=True) if not d] if runs else words


def words_of(text: str | None) -> list[str]:
    # bytes.split() splits at exactly the six white-space characters of ASCII.
    return [w.decode() for w in text.encode().split()] if text else []


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words of one document in ten, chosen by its id, made periodic from some word on."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, compared exactly; ties to the smaller start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_DIGEST = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words", "n_kept")


def _digest(doc_id: int | None, text: str | None) -> tuple:
    words = planted(words_of(text), doc_id)
    runs = find_runs(words)
    kept, top = kept_words(words, runs), strongest(runs)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    peak = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return len(runs), *peak, sha256(listed.encode()).hexdigest(), sha256(" ".join(kept).encode()).hexdigest(), len(words), len(kept)


@pandas_udf(StructType([StructField(n, StringType() if n.endswith("sha256") else LongType()) for n in _DIGEST]))
def _digests(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for ids, texts in batches:
        rows = [_digest(None if i is None else int(i), t) for i, t in zip(ids, texts, strict=True)]
        frame = pd.DataFrame(rows, columns=list(_DIGEST))
        yield frame.astype({n: "Int64" for n in _DIGEST if not n.endswith("sha256")})


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the count of runs, the strongest run, and digests of all runs and of the collapsed text; words as ``planted`` leaves them."""
    # The id goes as text, as a column of numbers with nulls would become floating point.
    found = _digests(F.col("doc_id").cast("string"), F.col(text))
    return docs.select("doc_id", found.alias("r")).select("doc_id", "r.*")


def _mapped(kind: str, of: Callable[[list[str]], object]):
    @pandas_udf(kind)
    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([of(words_of(t)) for t in texts], dtype=object)

    return mapped


def with_runs(docs: DataFrame, text: str = "text", out: str = "runs") -> DataFrame:
    """``docs`` and ``out``: all runs of the text as it is, as an array of (start, length, period)."""
    kind = "array<struct<start:long,length:long,period:long>>"
    return docs.withColumn(out, _mapped(kind, lambda w: [{"start": s, "length": n, "period": q} for s, n, q in find_runs(w)])(F.col(text)))


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every run of ``text`` cut to its first period and words joined by one blank; null stays null."""
    cut = _mapped("string", lambda w: " ".join(kept_words(w, find_runs(w))))
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), cut(F.col(text))))

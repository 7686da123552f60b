"""Language identification: known words first, then shorter and shorter character n-grams.

A model has, for each language, log frequencies of words and of character n-grams of 1 to ``GRAM``
letters (a word's ends are letters too). A known word adds its log frequencies to the languages'
sums. An unseen word adds the mean over its longest n-grams of which any is known. The language of the
largest sum wins (ties: the first by code point); its score is its share of the posterior.

The model is fitted on a bounded sample: of each language, about ``SAMPLE_ROWS`` training documents at most,
chosen by a hash; whole texts of these. Its parameters: a word must be seen ``LEAST_SEEN`` times in a language's sample, and the
``MAX_WORDS`` most frequent words and ``MAX_GRAMS`` n-grams of each length and language are kept, fewer if the tables of all
languages would have more than ``TABLE_CELLS`` numbers: this bounds what the driver and each executor hold. ``fit`` takes
other values, and None for no limit. A word that isn't kept is scored by its n-grams, so none is ever left out.

Defined results
* null text, or text without a letter: ``und``, score 0.
* nothing to learn from: ``und`` for all, score 0.
* a training document without doc_id, text or lang is not learnt from; without doc_id, it isn't held out.
* repeated rows weigh each in the fit and are predicted each; an empty table gives an empty result.
* other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import staged

SAMPLE_ROWS = 4_000
MAX_WORDS = 40_000
MAX_GRAMS = 20_000
LEAST_SEEN = 2
TABLE_CELLS = 16_000_000
GRAM = 5
UNKNOWN = "und"
#: Added to each count; the weight of what a language has never shown.
SMOOTH = 0.5
CACHE_WORDS = 150_000
_RUNS = re.compile(r"[^\W\d_]+")
_FLUSH = 200_000


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters (numerals that are no digits may be in them; ``letters`` drops those)."""
    return _RUNS.findall(text.lower()) if text else []


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, Counter] = {}

    def rows() -> pd.DataFrame:
        found = [(lang, word, n) for lang, c in counts.items() for word, n in c.items()]
        counts.clear()
        return pd.DataFrame(found, columns=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            counts.setdefault(lang, Counter()).update(w for w in map(letters, words_of(text)) if w)
            if sum(map(len, counts.values())) > _FLUSH:
                yield rows()
    yield rows()


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, word, n in zip(batch["lang"], batch["word"], batch["n"], strict=True):
            for size in range(1, GRAM + 1):
                for gram in grams(word, size):
                    counts[lang, gram] += n
        yield pd.DataFrame([(lang, gram, n) for (lang, gram), n in counts.items()], columns=["lang", "gram", "n"])


def grams(word: str, size: int) -> list[str]:
    marked = f"\x02{word}\x03"
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray

    def of_word(self, word: str) -> np.ndarray:
        """What a word adds to each language's sum."""
        if (row := self.words.get(word)) is not None:
            return self.word_logs[row]
        for size in range(GRAM, 0, -1):
            if found := [row for g in grams(word, size) if (row := self.grams.get(g)) is not None]:
                return self.gram_logs[found].mean(axis=0)
        return np.zeros(len(self.languages))


def _log_table(rows: list, key: str, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    names = {k: i for i, k in enumerate(sorted({r[key] for r in rows}))}
    counts = np.zeros((len(names), len(languages)))
    at = {lang: i for i, lang in enumerate(languages)}
    for r in rows:
        counts[names[r[key]], at[r["lang"]]] = r["n"]
    return names, np.log(counts + SMOOTH) - np.log(counts.sum(axis=0) + SMOOTH * max(1, len(names)))


def fit(training: DataFrame, sample_rows: int = SAMPLE_ROWS, max_words: int | None = MAX_WORDS, max_grams: int | None = MAX_GRAMS, least_seen: int = LEAST_SEEN) -> Model:
    """``training``: doc_id, text, lang, all non-null."""
    sizes = {r["lang"]: r["n"] for r in training.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    share = F.element_at(F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample_rows / sizes[lang]))]), F.col("lang"))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id", F.xxhash64("text")), 11) / float(1 << 53)
    sample = training.filter(chance < share).select("lang", "text")
    words = sample.mapInPandas(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = staged(words)
    counted = words.mapInPandas(_count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    room = max(1, TABLE_CELLS // len(languages) ** 2)

    def top(rows: DataFrame, key: str, limit: int | None, *by) -> list:
        if limit is None:
            return rows.select("lang", key, "n").collect()
        limit = min(limit, room // (GRAM if by else 1))
        order = Window.partitionBy("lang", *by).orderBy(F.desc("n"), key)
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("lang", key, "n").collect()

    known, word_logs = _log_table(top(words.filter(F.col("n") >= least_seen), "word", max_words), "word", languages)
    parts, gram_logs = _log_table(top(counted, "gram", max_grams, F.length("gram")), "gram", languages)
    return Model(languages, known, word_logs, parts, gram_logs)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf(StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        n = len(m.languages)
        at: dict[str, int] = {}
        table, filled = np.zeros((1024, n + 1)), 0  # last column: 1 if the run has a letter
        for texts in batches:
            out = []
            for text in texts:
                runs = words_of(text) if n else []
                if filled > CACHE_WORDS:
                    at.clear()
                    filled = 0
                for run in set(runs):
                    if run not in at:
                        if filled == len(table):
                            table = np.concatenate([table, np.zeros_like(table)])
                        word = letters(run)
                        table[filled, :n] = m.of_word(word) if word else 0.0
                        table[filled, n] = bool(word)
                        at[run] = filled
                        filled += 1
                sums = table[np.fromiter(map(at.__getitem__, runs), np.int64, len(runs))].sum(axis=0)
                if not n or not sums[n]:
                    out.append((UNKNOWN, 0.0))
                    continue
                best = int(np.argmax(sums[:n]))
                out.append((m.languages[best], float(1 / np.exp(np.clip(sums[:n] - sums[best], -700, 0)).sum())))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.withColumn("__guess", guess(F.col(text))).select(*[c for c in docs.columns if c not in ("lang_pred", "score")], "__guess.*")


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the documents that aren't held out, predicted for all."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    docs = docs.select("doc_id", "text", "lang", F.coalesce(fold == held, F.lit(False)).alias("held_out"))
    training = docs.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return predict(docs.select("doc_id", "held_out", "text"), fit(training)).drop("text")

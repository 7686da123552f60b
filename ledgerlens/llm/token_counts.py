"""Exact token-length histogram of a corpus.

Documents are encoded once and aggregated by encoded length; everything asked of the corpus
afterwards is answered from the histogram, whose size is the number of distinct lengths:
totals, quantiles, and how many tokens remain when documents are cut at a context limit.

Defined results
* null or empty text: length 0; such documents count.
* special-token strings inside a text are ordinary text.
* repeated rows count once for each row; an empty table gives an empty histogram.
* other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from .shared import running_sums, staged, tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text; 0 for null."""

    @pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(vocabulary).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, ``n_tokens``, ``n_docs``: how many documents have each encoded length."""
    lengths = docs.select(*by, token_count(F.col(text), vocabulary).alias("n_tokens"))
    return lengths.groupBy(*by, "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(lengths: DataFrame) -> DataFrame:
    """The histogram with suffix sums: one row for each length, taken as a context limit.

    ``docs_longer`` and ``tokens_longer`` are what lies beyond the limit, ``docs_within`` and
    ``tokens_within`` what fits whole, ``truncated_tokens`` the total if each document is cut at
    the limit, ``rank_share`` the share of documents that fit: the length is the quantile of
    every share above the preceding row's and up to this.
    """
    lengths = staged(lengths.withColumn("tokens_here", F.col("n_tokens") * F.col("n_docs")))
    total = lengths.agg(F.sum("n_docs").alias("docs"), F.sum("tokens_here").alias("tokens")).first()
    docs, tokens = total["docs"] or 0, total["tokens"] or 0
    sums = running_sums(lengths, "n_tokens", ["n_docs", "tokens_here"])
    within, inside = F.col("n_docs_before") + F.col("n_docs"), F.col("tokens_here_before") + F.col("tokens_here")
    return sums.select(
        "n_tokens", "n_docs", within.alias("docs_within"), (F.lit(docs) - within).alias("docs_longer"),
        inside.alias("tokens_within"), (F.lit(tokens) - inside).alias("tokens_longer"),
        (inside + F.col("n_tokens") * (F.lit(docs) - within)).alias("truncated_tokens"), (within / F.lit(docs)).alias("rank_share"),
    )


def quantile(limits: DataFrame, share: float) -> int | None:
    """The smallest length that at least ``share`` of the documents do not exceed."""
    return limits.filter(F.col("rank_share") >= share).agg(F.min("n_tokens")).first()[0]


def truncated_total(lengths: DataFrame, limit: int) -> int:
    """Tokens left when each document is cut at any ``limit``, whether a document has that length or not."""
    cut = F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")
    return lengths.agg(F.coalesce(F.sum(cut), F.lit(0))).first()[0]

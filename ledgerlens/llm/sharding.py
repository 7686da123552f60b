"""A uniform shuffle of all rows into shards of exact size.

How many rows each input partition sends to each shard follows the multivariate hypergeometric law;
this communication matrix is drawn exactly from the partitions' row counts, which alone reach the
driver. Each partition then deals its rows to the shards by a random permutation of the labels that
the matrix grants it, and each shard permutes what it has received. Every arrangement of the
rows is equally likely, and shard sizes differ by one at most.

The second permutation sorts by a random key in buckets of it, so that no task holds a whole shard.

Defined results
* null, empty, very long texts, ties and repeated rows: rows are dealt as they are, whatever they hold.
* an empty table gives an empty result.
* an input column named ``shard`` or ``slot`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from .shared import free_name, staged

#: Rows in a bucket of a shard, about.
BUCKET_ROWS = 20_000
_INDEX_BITS = 33  # monotonically_increasing_id: the partition above, the row's number in it below


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows taken without replacement from good + bad are good.

    By inversion over all values within 14 standard deviations of the mean (beyond lies less than
    double precision can tell); numpy's own draws end at populations of 10**9.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mean = draws * good / total
    sd = (mean * (bad / total) * max(0.0, (total - draws) / max(1, total - 1))) ** 0.5
    a, b = max(low, int(mean - 14 * sd) - 2), min(high, int(mean + 14 * sd) + 2)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weights = np.concatenate(([0.0], np.cumsum(steps)))
    chance = np.cumsum(np.exp(weights - weights.max()))
    return a + int(np.searchsorted(chance, rng.random() * chance[-1], side="right").clip(0, b - a))


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard. Shard sizes differ by one at most; chance says which are larger."""
    rng, total = np.random.default_rng(seed), sum(counts)
    room = np.full(shards, total // shards, np.int64)
    room[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(counts), shards), np.int64)
    for i, count in enumerate(counts):
        left, rest = count, int(room.sum())
        for s in range(shards):
            rest -= int(room[s])
            out[i, s] = hypergeometric(rng, int(room[s]), rest, left)
            left -= int(out[i, s])
        room -= out[i]
    return out


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """All rows with ``shard`` (from 0) and ``slot`` (from 0, gapless in a shard)."""
    columns = [c for c in rows.columns if c not in ("shard", "slot")]
    row, key, bucket, size, start, at = (free_name(rows, n) for n in ("__row", "__key", "__bucket", "__n", "__start", "__at"))
    fixed = staged(rows.select(*columns).withColumn(row, F.monotonically_increasing_id()))
    part, index = F.shiftright(row, _INDEX_BITS).cast("int"), F.col(row).bitwiseAND((1 << _INDEX_BITS) - 1)
    found = sorted((r["part"], r["n"]) for r in fixed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in found)
    matrix = communication_matrix([n for _, n in found], shards, seed)
    granted = fixed.sparkSession.sparkContext.broadcast({p: matrix[i].astype(np.int32) for i, (p, _) in enumerate(found)})

    @pandas_udf(IntegerType())
    def label(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        @lru_cache(maxsize=2)
        def labels(p: int) -> np.ndarray:
            return np.random.default_rng([seed, p]).permutation(np.repeat(np.arange(shards, dtype=np.int32), granted.value[p]))

        for parts, at in batches:
            p, i, out = parts.to_numpy(), at.to_numpy(), np.zeros(len(parts), np.int32)
            for one in np.unique(p):
                mine = p == one
                out[mine] = labels(int(one))[i[mine]]
            yield pd.Series(out)

    buckets = max(1, -(-total // (shards * BUCKET_ROWS)))
    dealt = fixed.withColumn("shard", label(part, index)).withColumn(key, F.xxhash64(F.lit(seed), row))
    dealt = dealt.withColumn(bucket, F.floor(F.shiftrightunsigned(key, 32) * buckets / float(1 << 32)).cast("int"))
    sizes = dealt.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias(size))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", bucket, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(start))
    order = F.shiftrightunsigned(key, 32), F.col(key), F.col(row)
    placed = dealt.withColumn(at, F.row_number().over(Window.partitionBy("shard", bucket).orderBy(*order)) - 1)
    return placed.join(starts, ["shard", bucket]).select(*columns, "shard", (F.col(start) + F.col(at)).alias("slot"))

"""An implied unit price: the base that most of a group's amounts are small whole multiples of."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed limits of the rule.
MIN_ROWS, MIN_SUPPORT, MAX_DROPPED = 3, 0.6, 3
MAX_MULTIPLE, MIN_MULTIPLES = 200, 2
MIN_SHARE_OF_MEDIAN = 0.01
ROUND_FROM = 10_000
#: Groups that a task looks at together: bounds what it holds, whatever an Arrow batch has.
GROUPS_AT_ONCE = 500


def too_round(base: int) -> bool:
    return base >= ROUND_FROM and len(str(base).rstrip("0")) <= 1


def implied_base(values: np.ndarray, counts: np.ndarray) -> tuple[int, int] | None:
    """(base, supporting rows) of distinct positive amounts, ascending, with their numbers of rows.

    At most MAX_DROPPED rows stand aside, so that of any five rows two support the base: it is a whole part of the
    greatest common divisor of a pair of these, and not less than a MAX_MULTIPLE-th of them. Every such base is tried.
    """
    rows = int(counts.sum())
    if rows < MIN_ROWS:
        return None
    least = max(int(np.ceil(rows * MIN_SUPPORT)), MIN_ROWS, rows - MAX_DROPPED)
    order = np.repeat(values, np.minimum(counts, MAX_DROPPED + 2))[: MAX_DROPPED + 2]
    at = np.searchsorted(np.cumsum(counts), [(rows - 1) // 2, rows // 2], side="right")
    middle = values[at].mean()
    tried = {g // m for a, b in combinations(order.tolist(), 2) for g in [gcd(int(a), int(b))] for m in range(1, MAX_MULTIPLE + 1) if g % m == 0}
    best = None
    for base in tried:
        if base < middle * MIN_SHARE_OF_MEDIAN or too_round(base):
            continue
        fits = (values % base == 0) & (values // base <= MAX_MULTIPLE)
        support = int(counts[fits].sum())
        if support < least or fits.sum() < MIN_MULTIPLES or np.gcd.reduce(values[fits]) != base:
            continue
        best = max(best or (0, 0), (support, base))
    return (best[1], best[0]) if best else None


def implied_bases(values: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``implied_base`` of many groups at once: (group, base, supporting rows) of those that have one.

    ``values`` and ``counts`` hold the groups one after the other, ``starts`` where each begins and, last, the end.
    """
    ends, groups = np.cumsum(counts), np.arange(len(starts) - 1)
    before = np.concatenate([[0], ends])[starts[:-1]]
    rows = np.concatenate([[0], ends])[starts[1:]] - before
    least = np.maximum(np.maximum(np.ceil(rows * MIN_SUPPORT).astype(np.int64), MIN_ROWS), rows - MAX_DROPPED)
    at = [np.searchsorted(ends, before + np.maximum(k, 0), side="right") for k in ((rows - 1) // 2, rows // 2)]
    middle = (values[at[0]].astype(float) + values[at[1]]) / 2
    # The first rows of each group, a value as often as it counts; groups of fewer rows repeat their last, which adds no base of others.
    order = np.stack([values[np.searchsorted(ends, before + np.minimum(k, rows - 1), side="right")] for k in range(MAX_DROPPED + 2)], axis=1)
    pairs = [(a, b) for a, b in combinations(range(MAX_DROPPED + 2), 2)]
    common = np.stack([np.where(b < rows, np.gcd(order[:, a], order[:, b]), 0) for a, b in pairs], axis=1)
    tried = []
    for m in range(1, MAX_MULTIPLE + 1):
        base = common // m
        group, _ = hit = np.nonzero((common > 0) & (base * m == common) & (base >= (middle * MIN_SHARE_OF_MEDIAN)[:, None]) & (rows >= MIN_ROWS)[:, None])
        tried.append(np.stack([group, base[hit]], axis=1))
    group, base = np.unique(np.concatenate(tried), axis=0).T
    kept = ~np.array([too_round(b) for b in base.tolist()], dtype=bool)
    group, base = group[kept], base[kept]
    if not len(group):
        return group, base, base
    # Every base against all values of its group.
    sizes = (starts[1:] - starts[:-1])[group]
    first = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(first - starts[:-1][group], sizes)
    value, each = values[place], np.repeat(base, sizes)
    fits = (value % each == 0) & (value // each <= MAX_MULTIPLE)
    support = np.add.reduceat(np.where(fits, counts[place], 0), first)
    common = np.gcd.reduceat(np.where(fits, value, 0), first)
    good = np.nonzero((support >= least[group]) & (np.add.reduceat(fits.astype(np.int64), first) >= MIN_MULTIPLES) & (common == base))[0]
    good = good[np.lexsort((-base[good], -support[good], group[good]))]
    group, at = np.unique(group[good], return_index=True)
    return group, base[good][at], support[good][at]


def _of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), GROUPS_AT_ONCE):
            part = batch.slice(start, GROUPS_AT_ONCE)
            lists = part.column(1)
            flat, starts = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            values, counts = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            group, base, support = implied_bases(values, counts, starts)
            total = np.add.reduceat(counts, starts[:-1])[group]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(group)), *map(pa.array, (base, support, total))], [batch.schema.names[0], "value_thb", "support_rows", "total_rows"])


def implied_prices(lines: DataFrame, by: str, amount: str = "amount_thb") -> DataFrame:
    """by, value_thb, support_rows, total_rows: for groups that have such a base. Equal amounts are counted before they meet.

    All but MAX_DROPPED rows must be one of MAX_MULTIPLE multiples: a group of more distinct amounts has no base and
    never meets in a task. Groups reach Python as rows of (amount, n) lists, many at a time.
    """
    counts = lines.filter(F.col(amount) > 0).groupBy(by, F.col(amount).cast("long").alias("amount")).agg(F.count(F.lit(1)).alias("n"))
    kind = dict(counts.dtypes)[by]
    few = counts.groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") <= MAX_MULTIPLE + MAX_DROPPED)
    counts = counts.join(few, F.col(by).eqNullSafe(F.col("__by")), "left_semi")
    groups = counts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("amount", "n"))).alias("amounts"))
    return groups.mapInArrow(_of_batches, f"{by} {kind}, value_thb long, support_rows long, total_rows long")

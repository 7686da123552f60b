"""Mixing sources to target weights by pivotal dependent rounding.

Sources get targets in words: shares of the whole by weight, where none may exceed
``MAX_REPEAT`` times its own size (what is cut goes to the others by weight). A document's copies are
the whole part of target / size of its source, and one more with a probability equal to the fraction.
Those fractions are rounded together: two documents of a source pass words between them, in a random
direction that keeps each one's expectation, until one of them has 0 or 1 copies more; the other meets
the next. The last document left open in a source takes the nearer of 0 and 1: the words taken from a
source are right up to half the size of that document.

A source's documents are dealt to chunks; each (source, chunk) is rounded by itself and leaves one open document
at most; those of a source meet in a reduction tree of fan-in ``FAN_IN`` over its chunks, so a node above the first level has at most
``FAN_IN`` rows. The larger documents of a chunk come first, which leaves a small one open. Equal sizes: by a hash of the document.

Defined results
* null or blank text: size 0; such documents bring no words, and their copies follow the bare probability.
* null source: a source of its own, last in order.
* null doc_id, repeated rows: each row is a document.
* an empty table gives an empty result; other columns are ignored by ``rounded``, ``mix`` returns them untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD_PATTERN, free_name, staged

#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: A target is at most this many times its source's size.
MAX_REPEAT = 3
CHUNK_ROWS = 50_000
FAN_IN = 64
_OPEN = "uid long, source string, size long, whole int, p double, chunk long, dice long"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target for each source of ``sized`` (source, size)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").isNull(), F.col("source")
    ranked = sums.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranked = staged(ranked.withColumn("__at", F.monotonically_increasing_id()))
    part, at = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = {r["p"]: r["n"] for r in ranked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [sum(n for p, n in counts.items() if p < k) for k in range(max(counts, default=-1) + 1)] or [0]
    rank = F.array(*[F.lit(int(x)).cast("long") for x in starts])[part] + at
    weight = F.array(*[F.lit(float(w)) for w in WEIGHTS])[F.pmod(rank, F.lit(len(WEIGHTS))).cast("int")]
    weighed = ranked.select("source", "source_size", weight.alias("weight"))
    top, level, capped = MAX_REPEAT * F.col("source_size"), 0.0, -1
    while True:
        below = top / F.col("weight") < level
        row = weighed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(below, top).otherwise(0)).alias("cut"),
            F.sum(F.when(below, 0.0).otherwise(F.col("weight"))).alias("w"), F.count_if(below).alias("n"),
        ).first()
        if row["n"] == capped or not row["w"]:
            break
        capped, level = row["n"], (row["all"] - row["cut"]) / row["w"]
    return weighed.select("source", "source_size", F.least(top.cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def pivot(a: float, p: float, b: float, q: float, u: float) -> tuple[float, float]:
    """Two open probabilities of documents of sizes a and b after words have passed between them; one of the results is 0 or 1."""
    up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
    if u * (up + down) < down:
        return (1.0, q - up / b) if (1 - p) * a <= q * b else (p + up / a, 0.0)
    return (0.0, q + down / b) if p * a <= (1 - q) * b else (p - down / a, 1.0)


def _round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by chunk, source and falling size; each such run leaves its last open row with its probability, all others end at 0 or 1."""
    from .shared import mix64

    here, held = None, None  # the run's key; its open row as [uid, source, size, whole, p, chunk]
    names = [x.split()[0] for x in _OPEN.split(", ")]
    for rows in batches:
        out = []
        chance = (mix64(rows["dice"].to_numpy().astype("uint64") + 0x9E3779B97F4A7C15) >> 11).astype("float64") / float(1 << 53)
        for row, u in zip(rows[names].itertuples(index=False, name=None), chance.tolist(), strict=True):
            row = list(row)
            if (key := (row[5], row[1])) != here:
                out += [held] if held else []
                here, held = key, None
            if held is None:
                held = row
                continue
            held[4], row[4] = pivot(held[2], held[4], row[2], row[4], u)
            ended = held[4] in (0.0, 1.0) or held[4] < 1e-12 or held[4] > 1 - 1e-12
            done, still = (held, row) if ended else (row, held)
            out.append([*done[:4], float(round(done[4])), *done[5:]])
            held = still
            if held[4] < 1e-12 or held[4] > 1 - 1e-12:
                held[4] = float(round(held[4]))
                out.append(held)
                held = None
        yield pd.DataFrame(out, columns=names)
    if held:
        yield pd.DataFrame([held], columns=names)


def dealt(level: DataFrame, parts: int) -> DataFrame:
    """Open rows of a level by (source, chunk), each such node in order: rows of different sources never need to meet, so however many
    sources there are, their nodes spread over all tasks."""
    return level.repartition(parts, "source", "chunk").sortWithinPartitions("source", "chunk", F.desc("size"), "dice", "uid")


def rounded(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, copies of each document."""
    sized = docs.select("doc_id", "source", word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("mark"), F.monotonically_increasing_id().alias("uid"))
    return _round_copies(staged(sized)).drop("uid", "mark")


def _round_copies(sized: DataFrame) -> DataFrame:
    """``sized``, staged: uid, doc_id, source, size, mark (a hash of the text); adds source_size, target and copies."""
    spark = sized.sparkSession
    targets = staged(source_targets(sized))
    renamed = targets.withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = sized.join(renamed, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    aimed = aimed.withColumn("__rate", rate)
    whole, part = F.floor("__rate").cast("int"), F.col("__rate") - F.floor("__rate")
    # All chance and order come from the document, so that neither files nor partitions change the result: rows equal in
    # doc_id, source and text may change places among themselves only.
    dice = F.xxhash64(F.lit(5), "doc_id", "source", "mark")
    coin = F.shiftrightunsigned(dice, 11) / float(1 << 53)
    rows = sized.count()
    chunks = max(1, -(-rows // CHUNK_ROWS))
    chunk = F.pmod(F.xxhash64(dice, F.lit(3)), F.lit(chunks))
    level = aimed.filter((F.col("size") > 0) & (part > 0)).select("uid", "source", "size", whole.alias("whole"), part.alias("p"), chunk.alias("chunk"), dice.alias("dice"))
    parts, closed = int(spark.conf.get("spark.sql.shuffle.partitions")), None
    while True:
        out = staged(dealt(level, parts).mapInPandas(_round, _OPEN))
        done = out.filter(F.col("p").isin(0.0, 1.0))
        closed = done if closed is None else closed.unionByName(done)
        level = out.filter(~F.col("p").isin(0.0, 1.0))
        if chunks == 1:
            last = level.withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0))
            closed = closed.unionByName(last)
            break
        chunks = -(-chunks // FAN_IN)
        level = level.withColumn("chunk", F.floor(F.col("chunk") / FAN_IN).cast("long"))
    extra = closed.select(F.col("uid").alias("__uid"), F.col("p").cast("int").alias("__more"))
    bare = F.when(coin < part, 1).otherwise(0)
    got = aimed.join(extra, F.col("uid") == F.col("__uid"), "left")
    copies = whole + F.coalesce(F.col("__more"), F.when(F.col("size") > 0, 0).otherwise(bare))
    return got.withColumn("copies", copies.cast("int")).drop("__uid", "__more", "__rate")


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents, each as often as the mix takes it, with all their columns."""
    uid, size, mark, of, copies, copy = (free_name(docs, n) for n in ("__uid", "__size", "__mark", "__of", "__copies", "__copy"))
    whole = staged(docs.withColumns({uid: F.monotonically_increasing_id(), size: word_count(F.col(text)), mark: F.xxhash64(text)}))
    sized = whole.select("doc_id", "source", F.col(size).alias("size"), F.col(mark).alias("mark"), F.col(uid).alias("uid"))
    times = staged(_round_copies(sized).filter(F.col("copies") > 0).select(F.col("uid").alias(of), F.col("copies").alias(copies)))
    # The decisions grow with the documents: they are merged at any size, never sent to all executors.
    taken = whole.join(times.hint("merge"), F.col(uid) == F.col(of))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)

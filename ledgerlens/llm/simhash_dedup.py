"""Near-duplicates by SimHash fingerprints, linked with BK-trees.

Fingerprints of 64 bits that differ in at most two bits agree in at least one of three blocks of
bits. Every distinct fingerprint goes to the shard of each of its three block values; in a shard, a
BK-tree (children keyed by their Hamming distance to the parent) is built and searched, following only
edges within the radius. As only distinct fingerprints take part, any number of equal texts weighs as one.

A shard of more than ``SHARD_LIMIT`` distinct fingerprints is divided in the same way: of the bits in which its members may
differ, three blocks are made, and members within two bits agree in one of these too. This goes on until all shards
are small, at any size of the input. Trees aren't sent to all executors: all trees together hold all fingerprints, which
has no bound, so a tree is built and searched in the task of its shard.

``keep_one(docs, words=5, similarity=0.8)`` asks of its links an exact Jaccard similarity of the shingles, for stages that
remove near copies. The same fingerprints (of shingle sets) and trees find the first links, each verified on the whole sets.
Fingerprints of similar pairs lie up to a dozen bits apart, though, and blocks for such a radius are so short that nearly all
pairs would meet. So an exact search follows, of pairs that the fingerprints have not joined: of n shingles in one order, similar
sets share one of the first n - ceil(similarity * n) + 1. Shingles that a sample shows to be common go last in the order;
this decides the work only, not the result. These candidates are verified too.

Links become classes by repeated minimum over neighbours with pointer jumping; nothing is collected.

Defined results
* null, empty or blank text: fingerprint zero, linked like any other.
* fewer than three words: the whole sequence is the one shingle.
* null doc_id: the row gets the smallest non-null doc_id of its class, or null if it has none.
* repeated rows: one row each in the result; an empty table gives an empty result.
* other columns are ignored by ``classes``; ``keep_one`` returns them untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from .shared import bound_batches, free_name, release, sieved, staged

RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
#: Fingerprints in a shard's tree.
SHARD_LIMIT = 1_000
#: Shards whose members may differ in so few bits have no more members than 2 to their power: they aren't divided.
LEAST_FREE = 6
#: Documents that are asked for common shingles, and in how many of them a shingle is common.
COMMON_SAMPLE, COMMON_DOCS = 20_000, 20
#: A shingle shared by more sets than this is compared with its most central set first.
STAR_LIMIT = 64
#: Up to so many candidate sets, the rows that name them are broadcast to find their texts; of more, a map of bits is, and only
#: the texts that pass it are shuffled.
NAMED_LIMIT = 200_000
#: Bits of a set's signature: the parity of how many of its shingles fall on each bit.
SIGNATURE_BITS = 1024
_PIECE = 1 << 15


def _shingle_bounds(text: str | None, words_in_shingle: int) -> tuple[bytes, list[int], list[int]]:
    """The text's words joined by single blanks, and where each shingle starts and ends."""
    words = (text or "").encode().lower().split()  # bytes: lower() changes A-Z only, split() cuts at ASCII space only
    if not words:
        return b"", [], []
    size = min(len(words), words_in_shingle)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    return b" ".join(words), starts, ends[size - 1 :].tolist()


def shingle_set(text: str | None, words_in_shingle: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending (int64)."""
    import xxhash

    joined, starts, ends = _shingle_bounds(text, words_in_shingle)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64).view(np.int64))


def fingerprint(text: str | None, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """The text's SimHash as a signed 64-bit number."""
    import xxhash

    joined, starts, ends = _shingle_bounds(text, words_in_shingle)
    if not starts:
        return 0
    digest = xxhash.xxh64_intdigest
    pieces = ((starts[at : at + _PIECE], ends[at : at + _PIECE]) for at in range(0, len(starts), _PIECE))
    return _majority(np.array([digest(joined[a:b], SEED) for a, b in zip(*piece, strict=True)], np.uint64) for piece in pieces)


def set_fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a set of shingles as a signed 64-bit number; of the empty set 0."""
    return _majority(shingles[at : at + _PIECE] for at in range(0, len(shingles), _PIECE))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles by SIGNATURE_BITS places (as int64). Two sets differ in as many shingles as their signatures in bits, at least."""
    odd = np.bincount(shingles & (SIGNATURE_BITS - 1), minlength=SIGNATURE_BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _majority(pieces: Iterable[np.ndarray]) -> int:
    """The bits that over half the 64-bit hashes have set."""
    n, counts = 0, np.zeros(64, np.int64)
    for hashes in pieces:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def _fingerprints(words: int):
    @pandas_udf(LongType())
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return prints


class BKTree:
    """Fingerprints; the children of a node are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(self.values[node])
            todo += [child for key, child in self.children[node].items() if d - radius <= key <= d + radius]
        return found

    def add(self, value: int) -> None:
        node = 0
        self.values.append(value)
        self.children.append({})
        while node != len(self.values) - 1:
            node = self.children[node].setdefault((self.values[node] ^ value).bit_count(), len(self.values) - 1)


def shard_links(members: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join what lies within the radius of each other, without those that join what is joined already."""
    tree, parent, links = BKTree(), {}, []

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for value in members:
        for other in tree.search(value & 0xFFFFFFFFFFFFFFFF, radius):
            if (a := root(value & 0xFFFFFFFFFFFFFFFF)) != (b := root(other)):
                parent[a] = b
                links.append((value & 0xFFFFFFFFFFFFFFFF, other))
        tree.add(value & 0xFFFFFFFFFFFFFFFF)
    return links


def _tree_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (mask, bits, fp); a shard may run over batches."""
    rest = pd.DataFrame({"mask": [], "bits": [], "fp": []}, dtype="int64")
    for rows in chain_last(batches):
        last = rows is None
        rows = rest if last else pd.concat([rest, rows[["mask", "bits", "fp"]]], ignore_index=True)
        if rows.empty:
            continue
        mask, bits, fp = (rows[c].to_numpy() for c in ("mask", "bits", "fp"))
        cuts = [0, *(np.flatnonzero((np.diff(mask) != 0) | (np.diff(bits) != 0)) + 1).tolist(), len(rows)]
        ended = len(cuts) - 1 if last else len(cuts) - 2
        links = [x for a, b in zip(cuts[:ended], cuts[1 : ended + 1], strict=True) for x in shard_links(fp[a:b].tolist())]
        rest = rows.iloc[cuts[ended] :]
        if links:
            pairs = np.array(links, np.uint64).view(np.int64)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def chain_last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    """The batches, then None."""
    yield from batches
    yield None


def signed(bits: int) -> int:
    """A 64-bit pattern as the signed number that Spark has for it."""
    return bits - (1 << 64) if bits >> 63 else bits


def divided(mask: int) -> list[int]:
    """Masks of the shards below the one whose members agree in the bits of ``mask``: one more block than the radius, of the other bits."""
    free = [k for k in range(64) if not mask >> k & 1]
    cuts = [len(free) * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return [mask | sum(1 << k for k in free[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of fingerprints within the radius that connect all that is so connected. ``distinct``: column fp."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowded, masks, trees = distinct.select("fp", F.lit(0).cast("long").alias("mask")), [0], None
    while True:
        below = {m: divided(m) for m in masks}
        masks = sorted({x for many in below.values() for x in many})
        of = F.create_map(*[x for m, many in below.items() for x in (F.lit(signed(m)).cast("long"), F.array(*[F.lit(signed(x)).cast("long") for x in many]))])
        members = crowded.select("fp", F.explode(F.element_at(of, F.col("mask"))).alias("mask")).distinct()
        members = members.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = members.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        sized = staged(members.join(sizes, ["mask", "bits"]))
        fits = (F.col("n") <= SHARD_LIMIT) | (F.bit_count("mask") >= 64 - LEAST_FREE)
        small = sized.filter(fits).select("mask", "bits", "fp")
        trees = small if trees is None else trees.unionByName(small)
        crowded = sized.filter(~fits).select("fp", "mask")
        if crowded.isEmpty():
            break
    return trees.repartition(parts, "mask", "bits").sortWithinPartitions("mask", "bits").mapInPandas(_tree_links, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """``node``, ``label``: the smallest node that each node of the edges (a, b) is connected with."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = staged(labels)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = labels.join(jump, F.col("label") == F.col("via")).join(near, F.col("node") == F.col("a"))
        new = staged(new.select("node", F.least("far", "near").alias("label"), F.col("label").alias("old")))
        release(labels)
        labels = new.select("node", "label")
        if new.filter(F.col("label") != F.col("old")).isEmpty():
            release(both)
            return labels


def _classes(prints: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """fp, label for each distinct fingerprint; ``prints`` is staged. ``found``: the links, if they are not those of the radius."""
    distinct = prints.select("fp").distinct()
    found = staged(links(distinct)) if found is None else found
    if found.isEmpty():
        return distinct.withColumn("label", F.col("fp"))
    labels = connected(found)
    return distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("label", "fp").alias("label"))


def _set_id(shingles: np.ndarray) -> int:
    """One number for a set of shingles; 0 for the empty set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED)).view(np.int64)) if len(shingles) else 0


def _shingle_sets(words: int):
    @pandas_udf(ArrayType(LongType()))
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words) for t in texts], dtype=object)

    return sets


def common_shingles(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """Hashes of shingles that are in many documents of a sample, ascending. At most shingles of the sample / COMMON_DOCS."""
    share = min(1.0, COMMON_SAMPLE / max(1, docs.count()))
    chosen = docs.filter(F.pmod(F.xxhash64(F.lit(SEED), F.col(text)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    found = chosen.select(F.explode(_shingle_sets(words)(F.col(text))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    kept = staged(found.filter(F.col("n") >= COMMON_DOCS).select("h"))
    hashes = np.sort(kept.toPandas()["h"].to_numpy(np.int64))
    release(kept)
    return hashes


def _prefixes(docs: DataFrame, text: str, words: int, percent: int):
    """A function of a text: fp (the id of its set of shingles), print (the set's SimHash), n (its size), sig (its signature) and prefix."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text, words))

    @pandas_udf("fp long, print long, n long, sig array<long>, prefix array<long>")
    def prefixes(texts: pd.Series) -> pd.DataFrame:
        last, rows = common.value, []
        for t in texts:
            x = shingle_set(t, words)
            often = last[np.minimum(np.searchsorted(last, x), len(last) - 1)] == x if len(last) else np.zeros(len(x), bool)
            length = len(x) - -(-len(x) * percent // 100) + 1 if len(x) else 0
            rows.append((_set_id(x), set_fingerprint(x), len(x), signature(x), np.concatenate((x[~often], x[often]))[:length]))
        return pd.DataFrame(rows, columns=["fp", "print", "n", "sig", "prefix"])

    return prefixes


def _may_match(percent: int) -> Column:
    """Whether rows a and b of one shingle (size n, place pos of the shingle) can be similar: the shingles from there on suffice.

    A similar pair also meets at the first shingle that both have, where this always holds.
    """
    shared = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    return (F.col("a.fp") != F.col("b.fp")) & ((100 + percent) * shared >= percent * (F.col("a.n") + F.col("b.n")))


def _signatures_allow(percent: int, one: str, other: str, n: Column) -> Column:
    """Whether sets of ``n`` shingles together can be similar by their signatures: an upper bound of what they share, so it loses no pair."""
    apart = sum((F.bit_count(F.col(one)[k].bitwiseXOR(F.col(other)[k])) for k in range(1, SIGNATURE_BITS // 64)), F.bit_count(F.col(one)[0].bitwiseXOR(F.col(other)[0])))
    return (100 + percent) * (n - apart) >= 2 * percent * n


def near_prints(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of set ids that join the sets with fingerprints (``print``) within the radius; ``sets``: one row each, staged."""
    firsts = staged(sets.groupBy("print").agg(F.min("fp").alias("first"), F.count(F.lit(1)).alias("sets")))
    shared = firsts.filter("sets > 1").select("print", "first")
    shared = F.broadcast(shared) if shared.count() <= NAMED_LIMIT else shared
    equal = sets.select("print", F.col("fp").alias("b")).join(shared, "print").filter("first <> b").select(F.col("first").alias("a"), "b")
    near = links(firsts.select(F.col("print").alias("fp")))
    for side in "ab":
        near = near.join(firsts.select(F.col("print").alias(side), F.col("first").alias(f"x{side}")), side)
    return equal.union(near.select(F.least("xa", "xb").alias("a"), F.greatest("xa", "xb").alias("b")))


def _named(rows: DataFrame, wanted: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` to look for the keys of ``wanted`` (staged) in, and ``wanted`` as it is to be joined: rows that can't match don't meet a shuffle."""
    if wanted.count() <= NAMED_LIMIT:
        return rows, F.broadcast(wanted)
    return sieved(rows, wanted, *key).filter("__may").drop("__may"), wanted


def similar(prints: DataFrame, docs: DataFrame, mark: dict, text: str, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of set ids with a Jaccard similarity of at least ``percent`` of 100. ``prints`` is staged."""
    chosen = F.min_by(F.struct("print", "n", "sig", "prefix", *mark), F.struct("__crc", "__id"))
    sets = staged(prints.filter("n > 0").groupBy("fp").agg(chosen.alias("s")).select("fp", "s.*"))
    release(prints)
    keyed = sets.select("fp", "n", F.posexplode("prefix").alias("pos", "h"))
    shared = staged(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1"))
    within, few = _named(keyed, shared, "h")
    keyed = staged(within.join(few, "h"))
    release(shared)

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = a.alias("a").join(b.alias("b"), "h").filter(_may_match(percent))
        if "sig" in a.columns:
            pairs = pairs.filter(_signatures_allow(percent, "a.sig", "b.sig", F.col("a.n") + F.col("b.n")))
        return pairs.select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b")).distinct()

    def both_sides(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(of.select(F.col("fp").alias(side), F.col(column).alias(f"x{side}"), *([F.col("n").alias(f"n{side}")] if "n" in of.columns else [])), side)
        return pairs

    def verified(pairs: DataFrame) -> DataFrame:
        def of_ends(pairs: DataFrame, column: str) -> DataFrame:
            """``pairs`` with a column of both sets; sets that are in no pair are not moved."""
            ends = staged(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct())
            within, few = _named(sets.select("fp", "n", column), ends, "fp")
            return both_sides(pairs, staged(within.join(few, "fp", "left_semi")), column)

        # Most candidates go by their short signatures, before the longer prefixes are moved.
        met = staged(pairs)
        close = staged(of_ends(met, "sig").filter(_signatures_allow(percent, "xa", "xb", F.col("na") + F.col("nb"))).select("a", "b"))
        # What prefixes don't share can only be shared by what follows one of the two.
        most = F.size(F.array_intersect("xa", "xb")) + F.greatest(F.col("na") - F.size("xa"), F.col("nb") - F.size("xb"))
        pairs = staged(of_ends(close, "prefix").filter((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b"))
        release(met, close)
        asked = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct().join(sets.select("fp", *mark), "fp")
        asked = staged(asked)
        within, few = _named(docs.withColumns(mark), asked, *mark)
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in mark]
        texts = within.alias("l").join(few.alias("r"), same).select("r.fp", F.col(f"l.{text}").alias("t"))
        whole = staged(texts.select("fp", _shingle_sets(words)(F.col("t")).alias("x")).dropDuplicates(["fp"]))
        alike = (100 + percent) * F.size(F.array_intersect("xa", "xb")) >= percent * (F.size("xa") + F.size("xb"))
        alike_pairs = staged(both_sides(pairs, whole, "x").filter(alike).select("a", "b"))
        release(pairs, asked, whole)
        return alike_pairs

    found = verified(near_prints(sets))
    joined = connected(found)
    joined = F.broadcast(joined) if joined.count() <= NAMED_LIMIT else joined

    def apart(pairs: DataFrame, a: str, b: str) -> DataFrame:
        """Without pairs of sets that links of fingerprints connect."""
        for side, label in ((a, "label_a"), (b, "label_b")):
            pairs = pairs.join(joined.select(F.col("node").alias(side), F.col("label").alias(label)), side, "left")
        return pairs.filter(~F.coalesce(F.col("label_a") == F.col("label_b"), F.lit(False))).drop("label_a", "label_b")

    few, many = keyed.filter(F.col("sets") <= STAR_LIMIT), keyed.filter(F.col("sets") > STAR_LIMIT)
    # The centre has the fewest shingles before the shared one: the copied text itself, if it is there.
    centres = staged(many.groupBy("h").agg(F.min(F.struct("pos", "n", "fp")).alias("c")).select("h", "c.*"))
    out = found.union(verified(apart(meet(few, few).union(meet(many, centres)).distinct(), "a", "b").select("a", "b")))
    # Sets that aren't joined to the centre by fingerprints and aren't like the centre of a large group are compared with all of the group.
    centred = out.union(out.select("b", "a")).select(F.col("a").alias("fp"), F.col("b").alias("centre"))
    rest = many.join(centres.select("h", F.col("fp").alias("centre")), "h").filter(F.col("fp") != F.col("centre"))
    rest = staged(apart(rest, "fp", "centre").join(centred, ["fp", "centre"], "left_anti").select("h", "fp", "n", "pos"))
    if not rest.isEmpty():
        # Signatures are compared where the members of a group meet, so that what is written doesn't grow with the square of its size.
        crowded, signs = staged(rest.select("h").distinct()), sets.select("fp", "sig")
        within, few = _named(many, crowded, "h")
        groups = within.join(few, "h", "left_semi").join(signs, "fp")
        out = out.union(verified(apart(meet(rest.join(signs, "fp"), groups), "a", "b").select("a", "b"))).distinct()
    release(sets, keyed, centres, rest)
    return out


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp (long) and component_id of each document."""
    prints = staged(docs.select("doc_id", _fingerprints(SHINGLE_WORDS)(F.col(text)).alias("fp")))
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    of = _classes(prints).join(firsts, "fp")
    least = of.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = staged(of.join(least, "label").select("fp", "component_id"))
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", words: int = SHINGLE_WORDS, similarity: float | None = None) -> DataFrame:
    """One document of each class, with all its columns: the smallest doc_id (nulls last), then the smallest text hash.

    Classes are those of the fingerprints within the radius, or with ``similarity`` (of two decimals) those that pairs of
    at least this Jaccard similarity of shingles of ``words`` words connect: found by fingerprints, then completed.
    The documents that go are looked up by doc_id and text hash; of rows that agree in both, one stays.
    """
    mark = {"__id": F.col("doc_id"), "__crc": F.xxhash64(F.coalesce(F.col(text), F.lit(""))), "__none": F.col(text).isNull()}
    if clash := [c for c in docs.columns if c in mark]:
        back = {free_name(docs, f"{c}_of_caller"): c for c in clash}
        out = keep_one(docs.withColumnsRenamed({c: n for n, c in back.items()}), text, words, similarity)
        return out.withColumnsRenamed(back)
    if similarity is None:
        prints = staged(docs.select(*[c.alias(n) for n, c in mark.items()], _fingerprints(words)(F.col(text)).alias("fp")))
        of = _classes(prints)
    else:
        bound_batches(docs.sparkSession)
        percent = round(100 * similarity)
        whole = staged(docs.select(*[c.alias(n) for n, c in mark.items()], _prefixes(docs, text, words, percent)(F.col(text)).alias("p"))).select(*mark, "p.*")
        prints = staged(whole.select(*mark, "fp"))
        of = _classes(prints, similar(whole, docs, mark, text, words, percent))
    order = F.struct(F.col("__id").isNull().alias("n"), F.col("__id"), F.col("__crc"), F.col("__none"))
    by_fp = prints.groupBy("fp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows"))
    stay = of.join(by_fp, "fp").groupBy("label").agg(F.min("first").alias("s")).select("s.__id", "s.__crc", "s.__none")
    rows = prints.groupBy(*mark).agg(F.count(F.lit(1)).alias("__rows"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in mark]
    judged = staged(rows.alias("l").join(stay.withColumn("__stays", F.lit(True)).alias("r"), same, "left").select("l.*", F.coalesce("r.__stays", F.lit(False)).alias("__stays")))

    marked = docs.withColumns(mark)
    goes, again = staged(judged.filter(~F.col("__stays")).select(*mark)), F.col("__stays") & (F.col("__rows") > 1)

    def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
        if gone.count() <= NAMED_LIMIT:
            return rows.alias("l").join(F.broadcast(gone).alias("r"), same, "left_anti")
        # Only rows that may be among those that go meet a shuffle.
        told = sieved(rows, gone, *mark)
        doubtful = told.filter("__may").drop("__may").alias("l").join(gone.alias("r"), same, "left_anti")
        return told.filter("NOT __may").drop("__may").unionByName(doubtful)

    left = without(marked, goes)
    if judged.filter(again).isEmpty():
        return left.select(*docs.columns)
    repeated = staged(judged.filter(again).select(*mark))
    within, few = _named(marked, repeated, *mark)
    twice = within.alias("l").join(few.alias("r"), same, "left_semi")
    return without(left, repeated).select(*docs.columns).unionByName(twice.dropDuplicates(list(mark)).select(*docs.columns))

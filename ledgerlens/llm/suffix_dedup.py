"""Repeated passages by a distributed suffix array.

Every byte of a text that lies in a string of ``LENGTH`` bytes which also starts earlier (in a document with a
smaller doc_id, or earlier in the same one) is found, exactly, over whole texts. Equality is always decided on bytes.

Tokens. Of the 69 substrings of GRAM bytes in each string of LENGTH, the one with the smallest hash is its anchor; equal
strings have equal anchors at equal places. Neighbouring strings share anchors, so that the anchors cut a text into
tokens of about 35 bytes. A run is the strings of one anchor; its cover is the text from the first string's start to the
last one's end. The suffixes that are sorted start at anchors.

1. Sieve. A run whose anchor occurs nowhere else has no partner and goes. Anchors are compared by 64-bit hashes: different
   hashes prove different anchors, and equal hashes only let a run pass.
2. Suffix array. The suffixes of all other runs are range-partitioned by their leading token (the anchor and what follows
   it), then by what precedes it, document and position, at sampled splitters. Each bucket is sorted by multikey quicksort
   on successive words of 8 bytes. A cover equal to its neighbour's is a repeat as a whole. Where one anchor has several
   covers, the strings of these are sorted in the same way, and equal neighbours are repeats.
3. Across boundaries. Anchors at the two ends of a bucket (a very frequent one fills many buckets) may go on in the next
   bucket: the strings of their different covers are range-partitioned themselves, by string, document and position, sorted
   in buckets, and the last string of each bucket is compared with the first of the next.

As document and position are part of the order, what occurs everywhere is spread over many buckets.

Defined results
* null text is an empty text; texts shorter than LENGTH have no repeats.
* null doc_id comes after all others; documents with equal ids are ordered by a hash of the text. Ids that aren't whole
  numbers are ordered as Spark orders them.
* of rows equal in doc_id and text, one counts as the document, the others as later copies.
* an empty table gives an empty result. Other columns stay; columns named as the new ones are replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, IntegralType, LongType, StructField, StructType

from .shared import mix64, release, staged

LENGTH = 100
GRAM = 32
LEFT = LENGTH - GRAM
#: Anchors in a bucket of the sieve, suffixes in a bucket of the suffix array, strings in a bucket of the last step, about.
SIEVE_RECORDS = 250_000
BUCKET_SUFFIXES = 60_000
BUCKET_STRINGS = 100_000
#: Most buckets of a step: their splitters, 192 bytes each, go to every executor. Beyond, buckets grow.
MOST_BUCKETS = 1 << 20
#: Records that a task holds before it hands them on.
FLUSH_RECORDS = 60_000
#: Text in a part of the documents, about.
PART_BYTES = 6 << 20
SAMPLE_DOCS = 2_000
SAMPLE_RECORDS = 60_000
#: Ranges of so few rows are sorted by comparing them.
_LEAF = 40
_GROUP = 1 << 18
_IDX = np.uint64((1 << 20) - 1)
_LAST_ID = (1 << 63) - 1
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = [np.uint64(int(x) | 1) for x in mix64(np.arange(301, 312, dtype=np.uint64))]
_DEALT = StructType([StructField("bucket", IntegerType()), StructField("blob", BinaryType())])
_FOUND = StructType([StructField("kind", IntegerType()), StructField("at", IntegerType()), StructField("n", LongType()), StructField("blob", BinaryType())])
#: Kinds of found rows: repeats (at: part), runs that stay (at: part), covers for the last step, first and last string of a bucket (at: bucket).
REPEAT, OPEN, FAR, EDGE = 0, 1, 2, 3


# ---- anchors


def anchor_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """segment, start in it, further strings, place of the anchor from the start on, and anchor hash of each run."""
    count = np.maximum(0, ends - starts - LENGTH + 1)
    total = int(count.sum())
    if not total:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    h, size = _TABLE[data], 1
    with np.errstate(over="ignore"):
        while size < GRAM:
            h = h[:-size] * _ODD[size.bit_length()] + h[size:]
            size *= 2
    grams = mix64(h)
    low = (grams & ~_IDX) | np.arange(len(grams), dtype=np.uint64)
    width, places = 1, LEFT + 1
    while 2 * width <= places:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (places - width)], low[places - width :])
    segment = np.repeat(np.arange(len(starts)), count)
    at = np.arange(total) + np.repeat(starts - (np.cumsum(count) - count), count)
    anchor = (low[at] & _IDX).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(segment) != 0))))
    last = np.concatenate((first[1:], [total])) - 1
    a, p = at[first], anchor[first]
    return segment[first], a - starts[segment[first]], at[last] - a, p - a, grams[p]


class Runs:
    """Columns of runs: doc (row of the table ids, ties), pos, more (further strings), off (from pos to the anchor) and, in the sieve, k (the anchor's hash)."""

    def __init__(self, ids, ties, doc, pos, more, off, k=None):
        self.ids, self.ties, self.doc, self.pos, self.more, self.off, self.k = ids, ties, doc, pos, more, off, k

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, which: np.ndarray) -> Runs:
        used, doc = np.unique(self.doc[which], return_inverse=True)
        return Runs(self.ids[used], self.ties[used], doc, self.pos[which], self.more[which], self.off[which], None if self.k is None else self.k[which])

    def pack(self) -> bytes:
        """Bytes of equal weight lie together, which Spark's own compression then shrinks."""
        columns = [(self.doc, np.uint32), (self.pos, np.uint32), (self.more, np.uint8), (self.off, np.uint8)]
        if self.k is not None:
            columns.append((np.diff(self.k, prepend=np.uint64(0)), np.uint64))
        planes = [np.ascontiguousarray(c.astype(t)).view(np.uint8).reshape(len(c), -1).T.tobytes() for c, t in columns]
        head = np.array([len(self.ids), len(self.doc), self.k is not None], np.int64)
        return b"".join([head.tobytes(), self.ids.astype(np.int64).tobytes(), self.ties.astype(np.int64).tobytes(), *planes])

    @staticmethod
    def unpack(blob: bytes) -> Runs:
        docs, n, keyed = np.frombuffer(blob, np.int64, 3).tolist()
        at, out = 24 + 16 * docs, []
        for t in (np.uint32, np.uint32, np.uint8, np.uint8, np.uint64)[: 5 if keyed else 4]:
            w = np.dtype(t).itemsize
            out.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, w * n, at).reshape(w, n).T).view(t).reshape(n))
            at += w * n
        ids, ties = np.frombuffer(blob, np.int64, docs, 24), np.frombuffer(blob, np.int64, docs, 24 + 8 * docs)
        with np.errstate(over="ignore"):
            return Runs(ids, ties, *(c.astype(np.int64) for c in out[:4]), np.cumsum(out[4], dtype=np.uint64) if keyed else None)

    @staticmethod
    def joined(many: list[Runs]) -> Runs:
        shift = np.cumsum([0, *(len(r.ids) for r in many)])
        doc = np.concatenate([r.doc + s for r, s in zip(many, shift, strict=False)])
        rest = [None if many[0].k is None and c == "k" else np.concatenate([getattr(r, c) for r in many]) for c in ("pos", "more", "off", "k")]
        return Runs(np.concatenate([r.ids for r in many]), np.concatenate([r.ties for r in many]), doc, *rest)


# ---- suffixes as rows of bytes


#: A row of the suffix array: LENGTH bytes from the anchor on, LEFT bytes up to it (each padded by zeros), both lengths; then id, tie, position.
CONTENT = LENGTH + LEFT + 2
TAIL = 22
#: A row of the last step: a string, six zeros; then id, tie, position.
STRING_CONTENT = LENGTH + 6


def _tails(ids: np.ndarray, ties: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """id, tie and position as bytes in their order."""
    out = np.empty((len(ids), TAIL), np.uint8)
    for at, value in ((0, ids), (8, ties)):
        out[:, at : at + 8] = (value.astype(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 16:] = pos.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return out


def _untailed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, tie and position of rows."""
    tail = np.zeros((len(rows), 24), np.uint8)
    tail[:, :16], tail[:, 18:] = rows[:, -TAIL:-6], rows[:, -6:]
    ids, ties, pos = tail.view(">u8").astype(np.uint64).T
    top = np.uint64(1 << 63)
    return (ids ^ top).astype(np.int64), (ties ^ top).astype(np.int64), pos.astype(np.int64)


def _windows(data: np.ndarray, at: np.ndarray, width: int, keep: np.ndarray) -> np.ndarray:
    """The ``width`` bytes at each place, with zeros from ``keep`` bytes on. ``data`` reaches that far."""
    out = np.lib.stride_tricks.sliding_window_view(data, width)[at]
    return np.where(np.arange(width) < keep[:, None], out, np.uint8(0))


def suffix_rows(data: np.ndarray, begin: np.ndarray, more: np.ndarray, off: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The rows of runs that begin at some places of ``data``, which has LENGTH idle bytes at its end."""
    right = more + LENGTH - off
    return np.concatenate((_windows(data, begin + off, LENGTH, right), _windows(data, begin, LEFT, off), np.stack((right, off), axis=1).astype(np.uint8), tails), axis=1)


def string_rows(rows: np.ndarray) -> np.ndarray:
    """The strings of the runs whose suffixes are given."""
    right, left = rows[:, LENGTH + LEFT].astype(np.int64), rows[:, LENGTH + LEFT + 1].astype(np.int64)
    place = np.arange(LENGTH + LEFT)
    source = np.where(place < left[:, None], LENGTH + place, np.minimum(place - left[:, None], LENGTH - 1))  # the cover: left part, then right part
    cover = np.take_along_axis(rows, source, axis=1)
    count = left + right - LENGTH + 1
    of = np.repeat(np.arange(len(rows)), count)
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    strings = np.lib.stride_tricks.sliding_window_view(cover, LENGTH, axis=1)[of, step]
    ids, ties, pos = _untailed(rows)
    return np.concatenate((strings, np.zeros((len(of), STRING_CONTENT - LENGTH), np.uint8), _tails(ids[of], ties[of], pos[of] + step)), axis=1)


def string_counts(rows: np.ndarray) -> np.ndarray:
    return rows[:, LENGTH + LEFT].astype(np.int64) + rows[:, LENGTH + LEFT + 1] - LENGTH + 1


def multikey_quicksort(rows: np.ndarray) -> np.ndarray:
    """Order of rows of bytes: a range is parted at a pivot's word into less, equal and more; what is equal goes on with the next word."""
    words, order, todo = rows.view(">u8"), np.arange(len(rows)), [(0, len(rows), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == words.shape[1]:
            continue
        part = order[a:b]
        if b - a <= _LEAF:
            keys = [x.tobytes() for x in rows[part, 8 * depth :]]
            order[a:b] = part[sorted(range(b - a), key=keys.__getitem__)]
            continue
        word = words[part, depth].astype(np.uint64)
        some = np.sort(word[:: max(1, (b - a) // 15)])
        pivot = some[len(some) // 2]
        less, equal = word < pivot, word == pivot
        order[a:b] = np.concatenate((part[less], part[equal], part[~(less | equal)]))
        low = a + int(np.count_nonzero(less))
        high = low + int(np.count_nonzero(equal))
        todo += [(a, low, depth), (low, high, depth + 1), (high, b, depth)]
    return order


def bucket_of(rows: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """How many splitters are at or below each row. Only rows that share a splitter's first word are compared beyond it."""
    lead = lambda x: np.ascontiguousarray(x[:, :8]).view(">u8").ravel().astype(np.uint64)
    ours, theirs = lead(rows), lead(splitters)
    out, above = np.searchsorted(theirs, ours, side="left"), np.searchsorted(theirs, ours, side="right")
    tied = np.flatnonzero(out < above)
    if len(tied):
        keys = [x.tobytes() for x in splitters]
        for i in tied.tolist():
            out[i] = bisect_right(keys, rows[i].tobytes(), int(out[i]), int(above[i]))
    return out


def choose_splitters(sample: np.ndarray, buckets: int) -> np.ndarray:
    """Rows of the sample, all different, that cut it into about equal shares."""
    order = multikey_quicksort(sample)
    return sample[order[np.unique((np.arange(1, buckets) * len(order)) // buckets)]] if len(sample) else sample


def _packed(rows: np.ndarray) -> bytes:
    return len(rows).to_bytes(4, "little") + rows.shape[1].to_bytes(2, "little") + pa.compress(rows.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    n, width = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:6], "little")
    return np.frombuffer(pa.decompress(memoryview(blob)[6:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(n, width)


def _all_rows(blobs) -> np.ndarray:
    many = [_unpacked(b.as_py()) for b in blobs]
    return many[0] if len(many) == 1 else np.concatenate(many)


# ---- tasks


def _rows(schema: StructType, *columns: list) -> pa.RecordBatch:
    kinds = {IntegerType(): pa.int32(), LongType(): pa.int64(), BinaryType(): pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(columns, schema.fields, strict=True)], names=schema.names)


def _cut_at_changes(values: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.diff(values, prepend=-1, append=-1)).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


def _dealt(rows: np.ndarray, splitters: np.ndarray) -> pa.RecordBatch:
    bucket = bucket_of(rows, splitters)
    order = np.lexsort((np.ascontiguousarray(rows[:, :8]).view(">u8").ravel(), bucket))  # like beside like: packs well
    bucket = bucket[order]
    cuts = _cut_at_changes(bucket)
    return _rows(_DEALT, [int(bucket[a]) for a, _ in cuts], [_packed(rows[order[a:b]]) for a, b in cuts])


def _texts(batch) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the binary column ``text``."""
    column = batch.column("text")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _groups(offsets: np.ndarray) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """Documents, or pieces of long ones that overlap by LENGTH - 1 bytes, in lots of neighbours: rows, begins, ends."""
    rows, begins, ends = [], [], []
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a < LENGTH:
            continue
        if rows and b - begins[0] > _GROUP:
            yield rows, begins, ends
            rows, begins, ends = [], [], []
        if b - a <= _GROUP:
            rows.append(row)
            begins.append(a)
            ends.append(b)
            continue
        for at in range(a, b - LENGTH + 1, _GROUP - LENGTH + 1):
            yield [row], [at], [min(b, at + _GROUP)]
    if rows:
        yield rows, begins, ends


def _longs(batch, name: str) -> np.ndarray:
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.to_numpy(zero_copy_only=False), np.int64)


def _runs_of(batch) -> Iterator[Runs]:
    data, offsets = _texts(batch)
    ids, ties = _longs(batch, "id"), _longs(batch, "tie")
    for rows, begins, ends in _groups(offsets):
        rows, begins, ends = np.array(rows), np.array(begins), np.array(ends)
        segment, start, more, off, k = anchor_runs(data[begins[0] : ends[-1]], begins - begins[0], ends - begins[0])
        used = np.unique(rows)
        if len(segment):
            yield Runs(ids[used], ties[used], np.searchsorted(used, rows[segment]), start + (begins - offsets[rows])[segment], more, off, k)


def _sieve_rows(r: Runs) -> np.ndarray:
    """The order of runs in the sieve, as rows of bytes: anchor hash, document, position."""
    return np.concatenate((r.k.astype(">u8").view(np.uint8).reshape(-1, 8), _tails(r.ids[r.doc], r.ties[r.doc], r.pos), np.zeros((len(r), 2), np.uint8)), axis=1)


def _sieve_bucket(r: Runs, splitters: np.ndarray) -> np.ndarray:
    """As ``bucket_of``; whole rows are made only of runs whose anchor is a splitter's."""
    theirs = np.ascontiguousarray(splitters[:, :8]).view(">u8").ravel().astype(np.uint64)
    out, above = np.searchsorted(theirs, r.k, side="left"), np.searchsorted(theirs, r.k, side="right")
    tied = np.flatnonzero(out < above)
    if len(tied):
        out[tied] = bucket_of(_sieve_rows(r.take(tied)), splitters)
    return out


def _sieve(splitters):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(held: list[Runs]) -> pa.RecordBatch:
            r = Runs.joined(held)
            bucket = _sieve_bucket(r, splitters.value)
            order = np.lexsort((r.k, bucket))
            bucket = bucket[order]
            cuts = _cut_at_changes(bucket)
            return _rows(_DEALT, [int(bucket[a]) for a, _ in cuts], [r.take(order[a:b]).pack() for a, b in cuts])

        held, n = [], 0
        for batch in batches:
            for r in _runs_of(batch):
                held.append(r)
                n += len(r)
                if n >= 4 * FLUSH_RECORDS:
                    yield dealt(held)
                    held, n = [], 0
        if held:
            yield dealt(held)

    return deal


def part_of(ids: Column, ties: Column, parts: int) -> Column:
    return F.pmod(ids.bitwiseXOR(ties), F.lit(parts)).cast("int")


def _by_part(r: Runs, kind: int, parts: int) -> list[tuple[int, int, int, bytes]]:
    """Runs packed by part, which is the same as ``part_of``."""
    if not len(r):
        return []
    part = np.mod(r.ids ^ r.ties, parts)[r.doc]
    order = np.lexsort((r.pos, r.doc, part))
    part = part[order]
    return [(kind, int(part[a]), b - a, r.take(order[a:b]).pack()) for a, b in _cut_at_changes(part)]


def _found(rows: list) -> pa.Table:
    return pa.Table.from_batches([_rows(_FOUND, *(map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])))])


def _settle_sieve(parts: int):
    """The runs of a bucket whose anchor's hash is there again; those at the bucket's ends stay, as it may be in the next bucket."""

    def settle(table: pa.Table) -> pa.Table:
        r = Runs.joined([Runs.unpack(b.as_py()) for b in table.column("blob")])
        order = np.argsort(r.k, kind="stable")
        k = r.k[order]
        again = np.concatenate(([True], k[1:] == k[:-1]))
        again |= np.concatenate((again[1:], [True])) | (k == k[0]) | (k == k[-1])
        r = r.take(order[again])
        r.k = None
        return _found(_by_part(r, OPEN, parts))

    return settle


def _to_runs(rows: np.ndarray, more: np.ndarray) -> Runs:
    ids, ties, pos = _untailed(rows)
    both, doc = np.unique(np.stack((ids, ties), axis=1), axis=0, return_inverse=True)
    return Runs(both[:, 0], both[:, 1], doc.ravel(), pos, more, np.zeros(len(rows), np.int64))


def _settle_suffixes(parts: int):
    """What a bucket's sorted suffixes tell: repeats, and the covers that the last step must look at."""

    def settle(table: pa.Table) -> pa.Table:
        rows = _all_rows(table.column("blob"))
        rows = rows[multikey_quicksort(rows)]
        equal = np.concatenate(([False], (rows[1:, :CONTENT] == rows[:-1, :CONTENT]).all(axis=1)))
        anchor = np.cumsum(np.concatenate(([0], (rows[1:, :GRAM] != rows[:-1, :GRAM]).any(axis=1))))
        found = _by_part(_to_runs(rows[equal], string_counts(rows[equal]) - 1), REPEAT, parts)
        strings = np.bincount(anchor[~equal], string_counts(rows[~equal]), anchor[-1] + 1).astype(np.int64)
        several = np.bincount(anchor[~equal], minlength=anchor[-1] + 1) > 1
        away = strings > 2 * BUCKET_STRINGS
        away[[0, -1]] = True
        if (far := ~equal & away[anchor]).any():
            found.append((FAR, 0, int(string_counts(rows[far]).sum()), _packed(rows[far])))
        here = ~equal & several[anchor] & ~away[anchor]
        rows, anchor = rows[here], anchor[here]
        lot = np.cumsum(np.where(several & ~away, strings, 0)) // BUCKET_STRINGS  # whole anchors, so many strings at a time
        for a, b in _cut_at_changes(lot[anchor]) if len(rows) else []:
            some = string_rows(rows[a:b])
            some = some[multikey_quicksort(some)]
            again = 1 + np.flatnonzero((some[1:, :LENGTH] == some[:-1, :LENGTH]).all(axis=1))
            found += _by_part(_to_runs(some[again], np.zeros(len(again), np.int64)), REPEAT, parts)
        return _found(found)

    return settle


def _settle_strings(parts: int):
    """Repeats among a bucket's sorted strings, and its first and last string."""

    def settle(table: pa.Table) -> pa.Table:
        rows = _all_rows(table.column("blob"))
        rows = rows[multikey_quicksort(rows)]
        again = 1 + np.flatnonzero((rows[1:, :LENGTH] == rows[:-1, :LENGTH]).all(axis=1))
        found = _by_part(_to_runs(rows[again], np.zeros(len(again), np.int64)), REPEAT, parts)
        return _found([*found, (EDGE, table.column("bucket")[0].as_py(), 2, rows[[0, -1]].tobytes())])

    return settle


def _open_suffixes(splitters, thin: int = 1):
    """The suffixes of a part's runs, by bucket; with ``thin``, every so many-th."""

    def suffixes(docs: pa.Table, blobs: pa.Table) -> pa.Table:
        out, schema = [], pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
        if docs.num_rows and blobs.num_rows:
            r = Runs.joined([Runs.unpack(b.as_py()) for b in blobs.column("blob")])
            data, offsets = _texts(docs)
            data = np.concatenate((data, np.zeros(LENGTH, np.uint8)))
            row = {key: n for n, key in enumerate(zip(_longs(docs, "id").tolist(), _longs(docs, "tie").tolist(), strict=True))}
            at = np.array([row.get(key, -1) for key in zip(r.ids.tolist(), r.ties.tolist(), strict=True)], np.int64)
            ours = np.flatnonzero(at[r.doc] >= 0)[::thin]
            for cut in range(0, len(ours), FLUSH_RECORDS):
                i = ours[cut : cut + FLUSH_RECORDS]
                tails = _tails(r.ids[r.doc[i]], r.ties[r.doc[i]], r.pos[i])
                out.append(_dealt(suffix_rows(data, offsets[at[r.doc[i]]] + r.pos[i], r.more[i], r.off[i], tails), splitters.value))
        return pa.Table.from_batches(out, schema)

    return suffixes


def _far_strings(splitters, thin: int = 1):
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                rows = _unpacked(blob.as_py())
                for cut in range(0, len(rows), 2_000):
                    some = string_rows(rows[cut : cut + 2_000])[::thin]
                    yield _dealt(some, splitters.value)

    return strings


def _first_repeats(parts: int):
    """Rows of two edges: the bucket's first string, of which the bucket before holds another."""

    def repeats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(b.as_py()[: STRING_CONTENT + TAIL] for b in batch.column("blob")), np.uint8).reshape(-1, STRING_CONTENT + TAIL)
            yield from _found(_by_part(_to_runs(rows, np.zeros(len(rows), np.int64)), REPEAT, parts)).to_batches()

    return repeats_of


def _spans_by_doc(blobs: pa.Table) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Per document: starts and ends (exclusive) of the runs of string starts in a part's blobs."""
    if not blobs.num_rows:
        return {}
    r = Runs.joined([Runs.unpack(b.as_py()) for b in blobs.column("blob")])
    ids, ties = r.ids[r.doc], r.ties[r.doc]
    order = np.lexsort((r.pos, ties, ids))
    ids, ties, start, end = ids[order], ties[order], r.pos[order], (r.pos + r.more + 1)[order]
    cuts = np.concatenate(([0], np.flatnonzero((np.diff(ids) != 0) | (np.diff(ties) != 0)) + 1, [len(ids)])).tolist()
    return {(int(ids[a]), int(ties[a])): (start[a:b], end[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}


def _merged(start: np.ndarray, end: np.ndarray, join: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs, united where the next begins before ``join`` beyond the end so far."""
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] >= reach[:-1] + join))
    return start[new], reach[np.concatenate((new[1:], [True]))]


def _cut(text: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    edges = [0, *np.stack((start, end), axis=1).ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _whole_characters(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs without characters that lie in them in part only."""
    lead = np.concatenate(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, [True]))
    at = np.flatnonzero(lead)
    a, b = at[np.searchsorted(at, start, side="left")], at[np.searchsorted(at, end, side="right") - 1]
    return a[a < b], b[a < b]


def _remove(schema: pa.Schema, as_text: bool):
    def remove(docs: pa.Table, blobs: pa.Table) -> pa.Table:
        lists, none = _spans_by_doc(blobs), (np.zeros(0, np.int64),) * 2
        size, gone, runs, kept = [], [], [], []
        for i, t, text in zip(docs.column("id").to_pylist(), docs.column("tie").to_pylist(), docs.column("text"), strict=True):
            text = text.as_py()
            start, end = lists.get((i, t), none)
            if len(start):
                start, end = _merged(start, end + LENGTH - 1, join=1)
                start, end = _whole_characters(text, start, end) if as_text else (start, end)
            size.append(len(text))
            gone.append(int((end - start).sum()))
            runs.append(len(start))
            kept.append(_cut(text, start, end) if len(start) else text)
        values = {"n_bytes": size, "n_removed": gone, "n_spans": runs, "kept": kept}
        return pa.Table.from_arrays([pa.array(values[f.name], f.type) if f.name in values else docs.column(f.name).cast(f.type) for f in schema], schema=schema)

    return remove


# ---- the operator


def _with_order(docs: DataFrame) -> DataFrame:
    """The documents with ``__id``: whole numbers in the order of doc_id, nulls last."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, IntegralType):
        return docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").alias("__of")).filter("__of is not null").distinct().repartitionByRange(parts, "__of").sortWithinPartitions("__of")
    ranks = staged(ids.withColumn("__id", F.monotonically_increasing_id()))
    return docs.join(ranks, F.col("doc_id") == F.col("__of"), "left").drop("__of").withColumn("__id", F.coalesce("__id", F.lit(_LAST_ID)))


def _keyed(docs: DataFrame, text: str, parts: int) -> DataFrame:
    """The documents with ``text`` as bytes, their order keys id and tie, and their part. Other columns get a prefix."""
    whole = F.coalesce(F.col(text), F.lit(""))
    other = [F.col(c).alias(f"c_{c}") for c in docs.columns if c != text]
    frame = _with_order(docs).select(*other, F.col("__id").alias("id"), F.xxhash64(whole).alias("tie"), whole.cast("binary").alias("text"))
    return frame.withColumn("part", part_of(F.col("id"), F.col("tie"), parts))


def _collected(frame: DataFrame, width: int) -> np.ndarray:
    rows = [_unpacked(bytes(r["blob"])) for r in frame.select("blob").collect()]
    return np.concatenate(rows) if rows else np.zeros((0, width), np.uint8)


def _thin(n: int) -> int:
    return max(1, n // SAMPLE_RECORDS)


def _sampled_runs(thin: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _runs_of(batch):
                some = r.take(np.arange(0, len(r), thin))
                yield _rows(_DEALT, [0], [_packed(_sieve_rows(some))])

    return sample


def repeats(lean: DataFrame, parts: int, rows: int, total: int) -> DataFrame:
    """at (part), blob: packed runs of string starts that are repeats. ``lean``: id, tie, text (bytes), part; (id, tie) is unique."""
    spark = lean.sparkSession
    share = spark.sparkContext.broadcast
    none = {w: share(np.zeros((0, w), np.uint8)) for w in (CONTENT + TAIL, STRING_CONTENT + TAIL)}
    # A part is chosen by a hash of the document: the first parts are a sample of the documents.
    first = max(1, -(-parts * SAMPLE_DOCS // max(1, rows)))
    some = lean.filter(F.col("part") < first)
    buckets = lambda n, size: int(min(MOST_BUCKETS, max(1, round(n / size))))
    anchors = total * 2 / (LEFT + 2)
    sample = _collected(some.mapInArrow(_sampled_runs(_thin(int(anchors * first / parts))), _DEALT), 32)
    splitters = share(choose_splitters(sample, buckets(anchors, SIEVE_RECORDS)))
    lots = lean.select("id", "tie", "text").mapInArrow(_sieve(splitters), _DEALT)
    still = staged(lots.groupBy("bucket").applyInArrow(_settle_sieve(parts), _FOUND))
    # Suffix array.
    sums = still.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("at") < first, F.col("n"))).alias("some")).first()
    runs = still.select(F.col("at").alias("part"), "blob")
    seen = some.groupBy("part").cogroup(runs.filter(F.col("part") < first).groupBy("part")).applyInArrow(_open_suffixes(none[CONTENT + TAIL], _thin(sums["some"] or 0)), _DEALT)
    splitters = share(choose_splitters(_collected(seen, CONTENT + TAIL), buckets(sums["all"] or 0, BUCKET_SUFFIXES)))
    suffixes = lean.groupBy("part").cogroup(runs.groupBy("part")).applyInArrow(_open_suffixes(splitters), _DEALT)
    found = staged(suffixes.groupBy("bucket").applyInArrow(_settle_suffixes(parts), _FOUND))
    release(still)
    out = found.filter(F.col("kind") == REPEAT).select("at", "blob")
    # Across boundaries.
    far = found.filter(F.col("kind") == FAR)
    count = far.agg(F.sum("n")).first()[0] or 0
    if not count:
        return out
    sample = _collected(far.select("blob").mapInArrow(_far_strings(none[STRING_CONTENT + TAIL], _thin(count)), _DEALT), STRING_CONTENT + TAIL)
    splitters = share(choose_splitters(sample, buckets(count, BUCKET_STRINGS)))
    strings = far.select("blob").mapInArrow(_far_strings(splitters), _DEALT)
    last = staged(strings.groupBy("bucket").applyInArrow(_settle_strings(parts), _FOUND))
    edges, width = last.filter(F.col("kind") == EDGE), STRING_CONTENT + TAIL
    before = edges.select((F.col("at") + 1).alias("next"), F.substring("blob", width + 1, LENGTH).alias("end"))
    again = edges.join(before, (F.col("at") == F.col("next")) & (F.substring("blob", 1, LENGTH) == F.col("end"))).select("blob")
    out = out.unionByName(last.filter(F.col("kind") == REPEAT).select("at", "blob"))
    return out.unionByName(again.mapInArrow(_first_repeats(parts), _FOUND).select("at", "blob"))


def remove_repeats(docs: DataFrame, text: str = "text", as_text: bool = False) -> DataFrame:
    """The documents with ``n_bytes``, ``n_removed``, ``n_spans`` and what is left.

    What is left is ``kept`` (bytes), or, with ``as_text``, the column ``text`` itself, where characters that
    a repeat covers in part only stay.
    """
    sizes = docs.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-sizes["bytes"] // PART_BYTES)) | 1
    keyed = _keyed(docs, text, parts)
    twins = staged(keyed.groupBy("id", "tie").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "tie"))
    lone, twice = keyed, None
    if not twins.isEmpty():  # rows equal in id and text: texts are grouped before they move
        lone, twice = keyed.join(twins, ["id", "tie"], "left_anti"), keyed.join(twins, ["id", "tie"], "left_semi")
        single = staged(twice.groupBy("id", "tie", "part").agg(F.first("text").alias("text")))
    names = ["id", "tie", "text", "part"]
    lean = lone.select(names) if twice is None else lone.select(names).unionByName(single.select(names))
    spans = repeats(lean, parts, sizes["rows"], sizes["bytes"]).withColumnRenamed("at", "part")
    new = ("n_bytes", "n_removed", "n_spans")
    gone = (*new, text) if as_text else (*new, text, "kept")
    other = [f for f in docs.schema.fields if f.name not in gone]
    results = [*[StructField(n, LongType()) for n in new], StructField("kept", BinaryType())]

    def cut(frame: DataFrame, columns: list[StructField]) -> DataFrame:
        schema = StructType([*columns, *results])
        return frame.select(*[f.name for f in columns], *[n for n in names if n not in {f.name for f in columns}]).groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_remove(to_arrow_schema(schema), as_text), schema)

    prefixed = [StructField(f"c_{f.name}", f.dataType) for f in other]
    out = cut(lone, prefixed)
    if twice is not None:
        one = cut(single, [StructField("id", LongType()), StructField("tie", LongType())])
        numbered = staged(twice.select("id", "tie", *[f.name for f in prefixed]).withColumn("uid", F.monotonically_increasing_id()))
        chosen = numbered.groupBy("id", "tie").agg(F.min("uid").alias("chosen"))
        copies = numbered.join(chosen, ["id", "tie"]).join(one, ["id", "tie"])
        later = (F.col("uid") != F.col("chosen")) & (F.col("n_bytes") >= LENGTH)
        instead = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept": F.lit("").cast("binary")}
        out = out.unionByName(copies.select(*[f.name for f in prefixed], "n_bytes", *[F.when(later, x).otherwise(F.col(n)).alias(n) for n, x in instead.items()]))
    kept = F.col("kept").cast("string").alias(text) if as_text else F.col("kept")
    left = out.select(*[F.col(f"c_{f.name}").alias(f.name) for f in other], *new, kept)
    return left.select(*[c for c in docs.columns if c not in new], *new) if as_text else left

"""SentencePiece encoding through a table of distinct chunks.

No piece of the vocabulary runs from another character into a white-space marker (checked when the
model is loaded), so no merge does either: a text splits before each run of markers into chunks
that are segmented independently.

1. The chunks of all documents are counted, combined in each task before they are shuffled.
2. Those that are frequent (at most ``TABLE_CHUNKS``, none longer than ``CHUNK_BYTES``) are a Spark table in which each is
   segmented once. Its size is bounded by these two, so it goes to all executors.
3. Each document's chunks are looked up and their ids joined by position. Chunks that are not in the table are segmented
   by the task that meets them, each once for a lot of documents at least; these are kept until there are ``TASK_CHUNKS``.

How often a chunk occurs decides where it is segmented only: ids are the library's own in any case.

Defined results
* null or empty text: no ids; decoded to the empty text.
* repeated rows: each is encoded; an empty table gives an empty result.
* other columns stay; an input column named like an output column is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .shared import release, staged, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARKER = "▁"
#: Chunks of the table that goes to all executors, and the longest of them: 200,000 of 48 bytes are about 30 MB in a task.
TABLE_CHUNKS = 200_000
CHUNK_BYTES = 48
#: Other chunks that a task keeps; different chunks that a task counts before it hands them on.
TASK_CHUNKS = 100_000
COUNTED_CHUNKS = 300_000
#: Documents, or characters of theirs, that are looked up at a time.
LOT_DOCS, LOT_CHARS = 512, 2_000_000
_CHUNK = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")


def chunks_of(text: str | None) -> list[str]:
    return _CHUNK.findall(MARKER + text.replace(" ", MARKER)) if text else []


@lru_cache(maxsize=2)
def library(model: str):
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(model))
    if any(re.search(f"[^{MARKER}]{MARKER}", found.id_to_piece(i)) for i in range(found.get_piece_size())):
        raise ValueError("pieces of this model cross white-space markers: texts can't be cut there")
    return found


def segmented(chunks: list[str], model: str = MODEL) -> list[bytes]:
    """The ids of each chunk, as the bytes of whole numbers of 32 bits."""
    sp = library(model)
    # The library puts a marker before what it is given: the chunk goes without its first one.
    ids = sp.encode([c[1:] for c in chunks], num_threads=1) if chunks else []
    return [np.array([sp.piece_to_id(MARKER)] if c == MARKER else x, np.int32).tobytes() for c, x in zip(chunks, ids, strict=True)]


class Encoder:
    """Ids of texts, by the table of frequent chunks and what else was met."""

    def __init__(self, table: dict[str, bytes], model: str = MODEL):
        self.table, self.model, self.met = table, model, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [chunks_of(t) for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.table, self.met)
        if len(self.met) > TASK_CHUNKS:
            new |= set(chain.from_iterable(cut)).intersection(self.met)
            self.met.clear()
        listed = list(new)
        self.met.update(zip(listed, segmented(listed, self.model), strict=True))
        table, met = self.table, self.met
        return [b"".join([table[c] if c in table else met[c] for c in chunks]) for chunks in cut]


def count_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """chunk, n: how often each chunk occurs in the texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["chunk", "n"])
            counts.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                counts.update(chunks_of(t.as_py()))
                if len(counts) > COUNTED_CHUNKS:
                    yield rows()
        yield rows()

    return docs.select(text).mapInArrow(counted, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def frequent_chunks(docs: DataFrame, text: str = "text", model: str = MODEL) -> dict[str, bytes]:
    """The table of frequent chunks with their ids: as many of the classes of frequency (a factor of 1.19 each) as fit, from the top."""
    level = F.floor(4 * F.log2(F.col("n").cast("double"))).cast("int")
    counts = staged(count_chunks(docs, text).filter(F.octet_length("chunk") <= CHUNK_BYTES).withColumn("level", level))
    sizes = {r["level"]: r["n"] for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    least, room = max(sizes, default=0) + 1, TABLE_CHUNKS
    while least - 1 in range(min(sizes, default=0), max(sizes, default=-1) + 1) and sizes.get(least - 1, 0) <= room:
        least -= 1
        room -= sizes.get(least, 0)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"chunk": batch["chunk"], "ids": segmented(batch["chunk"].tolist(), model)})

    found = counts.filter(F.col("level") >= least).select("chunk").mapInPandas(rows, "chunk string, ids binary").toArrow()
    release(counts)
    return dict(zip(found.column("chunk").to_pylist(), found.column("ids").to_pylist(), strict=True))


def lots(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The texts in lots of bounded size."""
    for batch in batches:
        size, first = 0, 0
        for at, n in enumerate(pc.binary_length(batch).to_pylist()):
            if at > first and (at - first >= LOT_DOCS or size + (n or 0) > LOT_CHARS):
                yield batch.slice(first, at - first)
                size, first = 0, at
            size += n or 0
        if len(batch) > first:
            yield batch.slice(first)


def _listed(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def round_trip(docs: DataFrame, text: str = "text", model: str = MODEL, decoded: bool = True) -> Column:
    """A column of ``docs``: token_ids and, if wanted, decoded_text of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_chunks(docs, text, model))
    fields = [StructField("token_ids", ArrayType(IntegerType())), *([StructField("decoded_text", StringType())] if decoded else [])]

    @arrow_udf(StructType(fields))
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, sp = Encoder(shared.value, model), library(model)
        for texts in lots(batches):
            ids = encoder.encode(texts.to_pylist())
            out = [_listed(ids)]
            if decoded:
                out.append(pa.array([sp.decode(np.frombuffer(x, np.int32).tolist()) if x else "" for x in ids], pa.string()))
            yield pa.StructArray.from_arrays(out, names=[f.name for f in fields])

    return both(F.col(text))


def decoded_text(ids: Column, model: str = MODEL) -> Column:
    @arrow_udf(StringType())
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sp = library(model)
        for batch in batches:
            yield pa.array([sp.decode(x.as_py()) if x.as_py() else "" for x in batch], pa.string())

    return texts(ids)


def encode(docs: DataFrame, text: str = "text", ids: str = "token_ids", model: str = MODEL) -> DataFrame:
    """The documents with the ids of their whole texts."""
    return docs.withColumn(ids, round_trip(docs, text, model, decoded=False)["token_ids"])


def decode(encoded: DataFrame, ids: str = "token_ids", text: str = "decoded_text", model: str = MODEL) -> DataFrame:
    """The encoded documents with the library's decoding of their ids."""
    return encoded.withColumn(text, decoded_text(F.col(ids), model))

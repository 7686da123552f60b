"""The training-corpus pipeline: quality rules, near-duplicates, repeated passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's documents. All stages but the last return the columns of ``documents``.

Defined results
* null, empty or blank text: such documents have fewer words than the quality rules ask for, so they go in the first stage.
  A later stage that is given one keeps it (one of each class of near-duplicates), with no tokens in the end.
* null doc_id: the document is kept or dropped like any other, and comes last where order matters. Null source: a source of
  its own. Null lang: kept as it is.
* very long texts are read, compared, cut and encoded whole.
* ties: of near-duplicates the smallest doc_id stays; of rows equal in doc_id and text one stays.
* documents of which the third stage leaves nothing go; one copy more of a document in the mix is a row more.
* an empty table gives an empty result with the same columns.
* extra columns are carried along by the first four stages, whatever their names, and are left out by the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, quality_rules, sentence_pieces, simhash_dedup, suffix_dedup
from .shared import free_name, read_table, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, and all of rejected hosts, go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: shingles of five words with a Jaccard similarity of 0.8 or more.

    SimHash fingerprints, searched in BK-trees, give the first links; what lies further apart in bits is found by shared shingles.
    """
    return simhash_dedup.keep_one(docs, words=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier go from the texts; documents of which nothing is left go."""
    names = {n: free_name(docs, f"{n}_of_caller") for n in ("n_bytes", "n_removed", "n_spans") if n in docs.columns}
    cut = suffix_dedup.remove_repeats(docs.withColumnsRenamed(names), as_text=True)
    cut = cut.filter((F.col("n_removed") == 0) | (F.length("text") > 0)).drop("n_bytes", "n_removed", "n_spans")
    cut = cut.withColumnsRenamed({n: c for c, n in names.items()}).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is there as often as the mix takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of the whole text."""
    encoded = sentence_pieces.encode(docs.select("doc_id", "lang", "source", "text"))
    return encoded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", tokens),
]
#: SQL expresses neither the fingerprints' hash nor the mix's rounding nor the encoding: the tests hold brute force against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, sf_dir)
        docs = staged(docs) if k < len(STAGES) else docs
    return docs

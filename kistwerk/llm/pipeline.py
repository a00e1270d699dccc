"""The corpus pipeline: quality filter, near-dedup, removal of repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all but the last return the columns
of documents. A text that the third stage cuts keeps its doc_id; n_chars follows its new length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classifier import keep_good
from .common import table, written
from .minhash import deduplicated
from .packing import packed_documents
from .suffix import without_repeats

#: The stages keep state of their own, so SQL can't express them; tests compare them with brute force.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.7; the classifier learns from labels and all of sf_dir's documents, once for any ``docs``."""
    return keep_good(docs, table(spark, sf_dir, "labels"), learn_from=table(spark, sf_dir, "documents"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group that five-word shingles link at 0.8 or more."""
    return deduplicated(docs, "doc_id", "text", share=80)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts from what is left of their bytes; where a cut falls inside a character, the rest of that character goes."""
    for b in batches:
        texts = [x.as_py().decode("utf-8", "ignore") for x in b.column(4)]
        cut = pa.array([n > 0 for n in b.column(2).to_pylist()], pa.bool_())
        yield pa.RecordBatch.from_arrays([*b.column(0).flatten(), pa.array(texts, pa.string()), cut], ["doc_id", "lang", "source", "n_chars", "text", "cut"])


def unrepeated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words, or of 400 bytes or more, that stand anywhere else; documents of which nothing is left go."""
    key = F.struct("doc_id", "lang", "source", "n_chars").alias("key")
    cut = without_repeats(docs.select(key, "text"), "key", "text", words=51)
    cut = cut.mapInArrow(_decode, "doc_id long, lang string, source string, n_chars long, text string, cut boolean")
    chars = F.when(F.col("cut"), F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars")
    return cut.where("text <> '' or not cut").select("doc_id", "text", "lang", "source", chars)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in as few sequences as can be."""
    import public_tokenizers

    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good_documents),
    ("minhash near-dedup", distinct_documents),
    ("suffix-array dedup", unrepeated_documents),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

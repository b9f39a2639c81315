"""From raw documents to packed training bins: five stages, each reading what the one before it kept.

Every stage but the last returns the columns of its input; its decisions are in
its rows and texts. Stages cover all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumensift.functions.durable import removed, temporary, written
from lumensift.llm import decontaminate, jaccard, packing, quality, substring


# Odd input, for all stages: a null or blank text has no words; a null id comes after all others; rows of equal id and text are the
# same place, and ties between others are broken by id, then text; repeated rows are judged alike; an empty table gives an empty
# one; columns beyond those named pass through whatever they are called. Each docstring says what this means for its rows.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 of the rule ledger keeps, unchanged; null, blank and short texts go, and repeated rows stay or go together."""
    return quality.filter_documents(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles with a Jaccard similarity of 0.8 or more connect: the one with the smallest id
    (null last), then text hash, then other columns, so of repeated rows one stays. Documents without words stay."""
    return jaccard.distinct_documents(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; words of 20-word windows that also start earlier (smaller id, null last; then text hash; then start) are cut out of
    their texts. Repeated rows are one place and lose the same words. n_chars follows the text where it changes."""
    return substring.dedup_documents(docs, length="n_chars")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with passages of the benchmark, unchanged; decided by the text, so repeated rows stay or go
    together, and null texts and an empty benchmark contaminate nothing."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """shard, bin, doc_id, piece, first_word and n_tokens of all pieces of all documents with a word; those without have no row. Ties in
    size are broken by id, text hash and piece; repeated rows never share a bin."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packed_bins", packed_bins),
]

#: Packing is sequential within a shard, which SQL can't express; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read by the next. Only the last table stays: those that a stage made on its way, and its input, are removed once it is written."""
    out, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with temporary(spark):
            out = written(stage(spark, out, sf_dir), keep=True)
        if last is not None:
            removed(last)
        last = out
    return out

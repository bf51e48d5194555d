"""Corpus pipeline: from raw documents to packed training sequences.

STAGES are applied in order; each takes (spark, docs, sf_dir), works on all that its predecessor
kept, and all but the last return the columns of documents. Between stages the rows are written as
Parquet to the session's shared checkpoint folder and read again. The result is the placement of each
piece of the documents that are left. No SQL oracle: quality and packing are not expressible in
SQL; the tests hold the stages against brute force. A stage's folder is deleted once the next one is written, the last once the result is kept.

Nulls: a null text is an empty one to each stage, a null doc_id is a document like others. Ties and repeated rows: of rows of one id and text
one goes on after near_dedup; of equal documents the smallest doc_id. Very long texts are worked on whole. Empty tables: no rows, or all
documents where labels or the benchmark are empty. Other columns, whatever their names, are kept as they are by all stages but the last.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagemark.llm import decontaminate, minhash, packing, quality, recompress
from pagemark.llm.common import discard, keep, shared_folder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field finds good; without labels all. An empty or null text has the field's score of one empty line."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies: five words a shingle, similarity 0.8 or more. Texts without words are in no group."""
    return minhash.one_of_each(docs, size=5, least=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows that a smaller doc_id has; documents with a null id come after all others. A text that loses nothing stays as it is."""
    return recompress.without_repeats(docs, size=13)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; an item without words, or a null one, has none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), size=10)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; an empty or null text is a piece of its end alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, spent = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if spent is not None:
            discard(spark, spent)
        spent = f"{folder}/{name}"
        docs = spark.read.parquet(spent)
    packed = keep(STAGES[-1][1](spark, docs, sf_dir))
    discard(spark, folder)
    return packed

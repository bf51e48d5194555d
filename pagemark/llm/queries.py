"""Queries opN_<name> of the training-data operators, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fingerprints, language, merkle, minhash, oracles, packing, quality, recompress, suffix_dedup, token_files, whitening, wrappers
from .common import discard, keep, shared_folder, table

TOKENIZER = "byte_bpe_50k.json"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_documents(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return decontaminate.digest(found)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.digest(recompress.remove_repeats(table(spark, sf_dir, "documents")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_documents(table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4()}"
    found = keep(token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), folder))
    discard(spark, folder)
    return found


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_decontaminate, op3_suffix_dedup, op4_language, op5_near_dedup,
        op6_quality, op7_chat, op8_main_text, op9_packing, op10_substring_dedup, op11_whitening, op12_merkle, op13_token_files,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": oracles.OP2,
    "op3_suffix_dedup": oracles.OP3,
    "op5_near_dedup": oracles.OP5,
    "op10_substring_dedup": oracles.OP10,
    "op12_merkle": oracles.OP12,
}

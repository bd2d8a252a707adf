"""One query per operator, over whole tables, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetmill.llm import (
    byte_bpe,
    chat,
    collocations,
    decontaminate,
    embeddings,
    merkle,
    packing,
    pii,
    quality,
    simhash,
    substring,
    toxicity,
    warc,
)
from fleetmill.llm.common import read_table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(read_table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return chat.preferences(chat.with_cut_answer(chat.conversations(turns)))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, x) for x in ("documents", "labels"))
    return toxicity.scored(docs, labels)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return byte_bpe.token_digests(
        docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.word_digests(read_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proof_digests(read_table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (read_table(spark, sf_dir, x) for x in ("documents", "benchmark"))
    return decontaminate.contamination(docs, items)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_chat_formatting,
        op3_best_fit_packing,
        op4_simhash,
        op5_toxicity,
        op6_warc,
        op7_quality,
        op8_byte_bpe,
        op9_substring_dedup,
        op10_embedding_dedup,
        op11_merkle_manifest,
        op12_phrase_collocations,
        op13_benchmark_decontamination,
    )
}

ORACLES: dict[str, str] = {
    "op2_chat_formatting": chat.PREFERENCES_SQL,
    "op11_merkle_manifest": merkle.MANIFEST_SQL,
    "op12_phrase_collocations": collocations.COLLOCATIONS_SQL,
    "op13_benchmark_decontamination": decontaminate.CONTAMINATION_SQL,
}

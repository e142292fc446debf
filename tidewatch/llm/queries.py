"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, collocations, decontam, embed_dedup, lattice_lm, minhash, periodic, secrets, substring_dedup, token_counts, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), words=4)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_read(spark, sf_dir, "conversations"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(periodic.with_repeats(_read(spark, sf_dir, "documents")))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(_read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_collocations(_read(spark, sf_dir, "documents"))


def embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's operator where there are links: all vectors, and changed copies of every third."""
    return embed_dedup.near_duplicates(embed_dedup.with_copies(_read(spark, sf_dir, "embeddings")))


QUERIES = {
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_secret_scan": op7_secret_scan,
    "op10_toxicity": op10_toxicity,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op8_warc_round_trip": op8_warc_round_trip,
    "op3_lattice_lm": op3_lattice_lm,
    "op1_chat_format": op1_chat_format,
    "embedding_copies": embedding_copies,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_collocations": op13_collocations,
}

SQL = {
    "op2_minhash_near_dedup": minhash.SQL,
    "op4_benchmark_decontamination": decontam.SQL,
    "op7_secret_scan": secrets.SQL,
    "op9_embedding_near_dedup": embed_dedup.SQL,
    "op8_warc_round_trip": warc.SQL,
    "embedding_copies": embed_dedup.COPIES_SQL,
    "op11_periodic_runs": periodic.SQL,
    "op12_substring_dedup": substring_dedup.SQL,
    "op13_collocations": collocations.SQL,
}
